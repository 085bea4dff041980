"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed to a fixed number of buckets.  Besides a
weight, each bucket has a short vector, and the product of two buckets' vectors weighs
their standing in one text together, which no sum of single weights can say.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, as_bytes, cut

BUCKETS = 1 << 18
FACTORS = 4
#: Labelled rows that a model is fitted on at most, of each label.
SAMPLE = 6000
#: Buckets with a smaller chi-square statistic against the label have no weights.
LEAST_CHI2 = 16.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: Words a worker remembers the buckets of.
REMEMBERED = 400_000

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_TABLE = LOWER_ASCII.translate(_SPACED)


def buckets_of(word: bytes, buckets: int = BUCKETS) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings of four to six letters."""
    letters = word.decode("utf-8", "ignore")
    terms = [b"=" + word, *(b"<" + letters[:k].encode() for k in PREFIXES if len(letters) >= k)]
    return tuple({zlib.crc32(t) % buckets for t in terms})


_KNOWN: dict[bytes, tuple[int, ...]] = {}


def text_buckets(text: bytes) -> set[int]:
    """The distinct buckets of all words of a text."""
    words = set(text.translate(_TABLE).split())
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    out: set[int] = set()
    for w in words:
        found = _KNOWN.get(w)
        if found is None:
            found = _KNOWN[w] = buckets_of(w)
        out.update(found)
    return out


def text_weights(text: bytes, known: dict[bytes, tuple[int, ...]], slot: dict[int, int]) -> list[int]:
    """Slots of the model that a text's words fall in; ``known`` remembers words' slots."""
    words = set(text.translate(_TABLE).split())
    if len(known) > REMEMBERED:
        known.clear()
    out: set[int] = set()
    for w in words:
        found = known.get(w)
        if found is None:
            found = known[w] = tuple(slot[b] for b in buckets_of(w) if b in slot)
        if found:
            out.update(found)
    return sorted(out)


def bag_table(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``bag``: the distinct term buckets of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = as_bytes(batch.column(batch.num_columns - 1))
            bags = [sorted(text_buckets(flat[at[i] : at[i + 1]].tobytes())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bags, pa.list_(pa.int32()))], names=[*keep, "bag"])

    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep), "bag array<int>"])
    return slim.mapInArrow(run, schema)


def fit(bags: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, least_chi2: float = LEAST_CHI2, seed: int = 5) -> pd.DataFrame:
    """Logistic factorization machine by Adagrad; (bucket, weights) with the bias at bucket -1.

    Only buckets that tell the labels apart by chi-square have weights.  One label
    alone, or none, gives the share of label 1 as bias.
    """
    n, y = len(bags), labels.astype(float)
    rate0 = min(max((y.sum() + 0.5) / (n + 1), 1e-4), 1 - 1e-4) if n else 1e-4
    bias = float(np.log(rate0 / (1 - rate0)))
    empty = pd.DataFrame({"bucket": np.array([-1], np.int32), "weights": [np.array([bias])]})
    if n == 0 or y.min() == y.max():
        return empty
    flat = np.concatenate([np.zeros(0, np.int64), *bags]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(b) for b in bags])
    ids, col = np.unique(flat, return_inverse=True)
    seen = np.bincount(col, minlength=len(ids)).astype(float)
    bad = np.bincount(col, weights=y[row], minlength=len(ids))
    p, q = y.sum(), n - y.sum()
    miss_bad, miss_good, good = p - bad, q - (seen - bad), seen - bad
    bottom = seen * (n - seen) * p * q
    chi2 = np.where(bottom > 0, n * (bad * miss_good - good * miss_bad) ** 2 / np.maximum(bottom, 1), 0)
    use = np.flatnonzero((chi2 >= least_chi2) & (seen >= 3))
    if not len(use):
        return empty
    slot = np.full(len(ids), -1)
    slot[use] = np.arange(len(use))
    hold = slot[col] >= 0
    row, col = row[hold], slot[col[hold]]
    starts = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(use)), rng.normal(0, 0.05, (len(use), factors))
    gb, gw, gv = 1e-6, np.full(len(use), 1e-6), np.full((len(use), factors), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            batch = order[lo : lo + 256]
            sizes = starts[batch + 1] - starts[batch]
            where = np.repeat(starts[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            k, r = col[where], np.repeat(np.arange(len(batch)), sizes)
            total = np.zeros((len(batch), factors))
            np.add.at(total, r, v[k])
            square = np.bincount(r, weights=(v[k] ** 2).sum(1), minlength=len(batch))
            score = bias + np.bincount(r, weights=w[k], minlength=len(batch)) + 0.5 * ((total**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[batch]) / len(batch)
            dw = np.bincount(k, weights=error[r], minlength=len(w))
            dv = np.zeros_like(v)
            np.add.at(dv, k, error[r][:, None] * (total[r] - v[k]))
            touched = np.unique(k)
            dw[touched] += decay * w[touched]
            dv[touched] += decay * v[touched]
            gw += dw**2
            gv += dv**2
            gb += error.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            bias -= rate * error.sum() / np.sqrt(gb)
    weights = [np.array([bias]), *np.column_stack([w, v])]
    return pd.DataFrame({"bucket": np.concatenate([[-1], ids[use]]).astype(np.int32), "weights": weights})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic") -> pd.DataFrame:
    """A model from the labelled rows of ``docs`` and ``labels(doc_id, <label>)``.

    Fitted on ``sample`` ids of each label at most, taken in the order of a hash, with
    the labels' shares kept by a correction of the bias.  The chosen ids go to the texts
    by a broadcast of that bound, so no text is shuffled; only hashed terms reach the one
    task that fits, and only the model, of at most 2**18 rows, reaches the driver.  An id
    with several texts gives one of them; texts of one label that hold the same terms
    count once, and the bias is corrected for the rows that are left.  Terms with both
    labels stay with both.
    """
    present = docs.select(F.col("doc_id").alias("_id"))
    known = cut(labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).join(present, "_id", "left_semi").distinct())
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    zero, one = (known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1))
    chosen = docs.select("doc_id", "text").join(F.broadcast(zero.unionByName(one)), F.col("doc_id") == F.col("_id"))
    rows = bag_table(chosen, "doc_id", "y").groupBy("doc_id", "y").agg(F.min("bag").alias("bag")).select("y", "bag")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        pdf = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"y": [], "bag": []})
        different = sorted({(np.asarray(b, np.int32).tobytes(), int(y)) for b, y in zip(pdf["bag"], pdf["y"], strict=True)})
        y = np.array([y for _, y in different], int)
        model = fit([np.frombuffer(b, np.int32) for b, _ in different], y)
        if shares.get(0) and shares.get(1) and 0 < y.sum() < len(y):
            shift = np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
            model["weights"] = [[w[0] + shift] if b == -1 else list(w) for b, w in zip(model["bucket"], model["weights"], strict=True)]
        yield model

    # two labels' samples: a bounded number of rows in one task
    return rows.repartition(1).mapInPandas(run, "bucket int, weights array<double>").toPandas()


def score(docs: DataFrame, model: pd.DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row by a model of :func:`train`.

    The score looks at the whole text alone.  Null and empty texts score the bias; rows
    may be equal or share a doc_id; other columns are ignored; an empty table gives no
    rows.
    """
    table = {int(b): np.asarray(w, dtype=float) for b, w in zip(model["bucket"], model["weights"], strict=True)}
    bias = float(table.pop(-1)[0])
    slot = {b: i for i, b in enumerate(table)}
    weights = np.stack(list(table.values())) if table else np.zeros((0, 1 + FACTORS))
    shared = docs.sparkSession.sparkContext.broadcast((slot, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, own = shared.value
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            flat, at = as_bytes(batch.column(1))
            out = np.full(batch.num_rows, bias)
            for i in range(batch.num_rows):
                if found := text_weights(flat[at[i] : at[i + 1]].tobytes(), known, slots):
                    part = own[found]
                    total = part[:, 1:].sum(0)
                    out[i] += part[:, 0].sum() + 0.5 * ((total**2).sum() - (part[:, 1:] ** 2).sum())
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
