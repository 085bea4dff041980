"""Substring dedup by content-defined chunks: gear hash, local-minimum cuts, 128-bit digests.

A gear hash of the last 24 bytes is kept at every byte, and a chunk ends where the
hash is the smallest among its neighbours.  Cuts depend on nearby bytes only, so a
passage is cut alike wherever it stands and whatever was inserted before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, as_bytes, bounded, cut, runs_of_rows

GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**24, 256, dtype=np.uint32)
WINDOW = 24
#: A cut is the smallest hash within so many bytes on both sides; chunks are 41 bytes on average, 21 at least.
REACH = 20
#: Chunks without a cut (one byte over and over) end here.
MAX_CHUNK = 1024
#: Adjoining repeated chunks of fewer bytes than this in all are taken for chance, unless they are the whole text.
MIN_RUN = 100


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the table values of the last 24 bytes, each shifted by its age."""

    def aged(sums: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(sums)
        out[by:] = sums[: max(0, len(sums) - by)] << np.uint32(by)
        return out

    sums = GEAR[data]
    halves = {}
    for span in (1, 2, 4, 8):
        sums = sums + aged(sums, span)
        halves[2 * span] = sums
    return (sums + aged(halves[8], 16)) & np.uint32(0xFFFFFF)


def cuts(data: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> np.ndarray:
    """End offsets of all chunks of the rows of ``data``; each row's end is one."""
    top = np.uint32(0xFFFFFFFF)
    h = gear(data)
    # a row's first hashes would take in bytes of the row before; they never cut
    for k in range(max(WINDOW - 1, reach)):
        at = offsets[:-1] + k
        h[at[at < offsets[1:]]] = top
    pad = np.full(reach, top, dtype=np.uint32)
    right = np.concatenate([h, pad])
    span = 1
    low = right
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    # low[i]: smallest of right[i : i + reach]
    n = len(h)
    after = low[1 : n + 1]
    before = np.concatenate([pad, low[: n - reach]])[:n] if n > reach else np.full(n, top)
    ends = np.flatnonzero((h < before) & (h <= after) & (h != top)) + 1
    ends = np.unique(np.concatenate([ends, offsets[1:]]))
    ends = ends[ends > offsets[0]]
    starts = np.concatenate([offsets[:1], ends[:-1]])
    parts = (ends - starts + MAX_CHUNK - 1) // MAX_CHUNK
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        ends = np.minimum(np.repeat(starts, parts) + nth * MAX_CHUNK, np.repeat(ends, parts))
    return ends


def _text(docs: DataFrame) -> DataFrame:
    """(id, key, doc_id, text); rows that differ in id or text differ in id or key."""
    text, ident = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return bounded(docs).select(F.coalesce(ident, F.lit(0)).alias("id"), F.xxhash64(ident.isNull(), text).alias("key"), ident.alias("doc_id"), text.alias("text"))


def chunk_table(docs: DataFrame) -> DataFrame:
    """(id, key, d1, d2, start, size): every chunk of every text with its 128-bit digest; an empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            flat, at = as_bytes(batch.column(2))
            for lo, hi in runs_of_rows(at, SLICE):
                data, own = flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                if not len(data):
                    continue
                ends = cuts(data, own)
                starts = np.concatenate([[0], ends[:-1]])
                row = np.searchsorted(own, starts, side="right") - 1
                raw = data.tobytes()
                both = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)
                which = pa.array(lo + row)
                columns = [ids.take(which), keys.take(which), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array((starts - own[row]).astype(np.int32)), pa.array((ends - starts).astype(np.int16))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "d1", "d2", "start", "size"])

    return _text(docs).select("id", "key", "text").mapInArrow(run, "id long, key long, d1 long, d2 long, start int, size short")


def repeated_runs(parts: list[dict], min_run: int, whole: int) -> list[list[dict]]:
    """Runs of adjoining repeated chunks of at least ``min_run`` bytes, or of all ``whole`` bytes of the text."""
    runs: list[list[dict]] = []
    for p in sorted(parts, key=lambda p: p["start"]):
        if runs and runs[-1][-1]["start"] + runs[-1][-1]["size"] == p["start"]:
            runs[-1].append(p)
        else:
            runs.append([p])
    return [r for r in runs if sum(p["size"] for p in r) >= min(min_run, whole)]


def dedup_chunks(docs: DataFrame, min_run: int = MIN_RUN, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_repeated, n_removed, spans, kept_sha256, and the kept text if asked.

    A chunk is repeated when its 128-bit digest occurs again in this or any other
    document.  Adjoining repeated chunks of ``min_run`` bytes and more count
    (n_repeated), or those that make up a whole text; with ``min_run`` 1 every repeated
    chunk counts.  Of these all but the first occurrence by doc_id and place are removed
    (n_removed, spans).  A passage of 50 words is found whatever stands around it.  Null
    and empty texts give zeros; rows may share a doc_id, and a null one is taken for 0 in
    the order; of equal rows only one counts as first, and all equal rows get one
    result, so a text repeated in equal rows keeps its chunks.  Other columns are
    ignored; an empty table gives no rows.
    """
    every = chunk_table(docs)
    # half of the digest finds what may be repeated; written before it is joined, so that a hot chunk's rows can be split
    again = cut(every.groupBy("d1").agg(F.count("*").alias("seen")).where("seen > 1").select("d1"))
    found = cut(every.join(again, "d1"), again)
    first = cut(found.groupBy("d1", "d2").agg(F.count("*").alias("seen"), F.min(F.struct("id", "key", "start")).alias("first")).where("seen > 1").select("d1", "d2", "first"))
    own = F.struct("id", "key", F.col("found.start").alias("start"))
    parts = found.alias("found").join(first, ["d1", "d2"]).select("id", "key", F.struct("start", "size", (own == F.col("first")).alias("first")).alias("part"))
    per_doc = parts.groupBy("id", "key").agg(F.collect_set("part").alias("parts"))
    schema = "doc_id long, n_bytes long, n_repeated long, n_removed long, spans array<struct<s:int,e:int>>, kept_sha256 string" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        types = [pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.string()][: 5 + with_text]
        names = ["doc_id", "n_bytes", "n_repeated", "n_removed", "spans", "kept_sha256", "text"][: 6 + with_text]
        for batch in batches:
            flat, at = as_bytes(batch.column(1))
            rows = []
            for i, parts in enumerate(batch.column(2).to_pylist()):
                own = flat[at[i] : at[i + 1]].tobytes()
                runs = repeated_runs(parts or [], min_run, len(own))
                gone: list[list[int]] = []
                for p in (p for r in runs for p in r if not p["first"]):
                    if gone and gone[-1][1] == p["start"]:
                        gone[-1][1] += p["size"]
                    else:
                        gone.append([p["start"], p["start"] + p["size"]])
                kept = b"".join(own[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(own)], strict=True))
                rows.append((len(own), sum(p["size"] for r in runs for p in r), len(own) - len(kept), [{"s": s, "e": e} for s, e in gone], hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return _text(docs).join(per_doc, ["id", "key"], "left").select("doc_id", "text", "parts").mapInArrow(run, schema)
