"""Packing by concatenating and cutting, with offsets from a two-pass prefix sum.

Pass one tokenizes every text once and writes the ids, each row with the tokens its
partition holds before it.  A prefix sum over the partitions' totals then gives every
row its place in the one long stream, and pass two cuts the stream into windows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, as_bytes, bounded, cut, runs_of_rows

WINDOW = 2048
END_ID = 1
#: Words a worker remembers the ids of; when it is full, those of the present run of texts are kept.
REMEMBERED = 500_000
#: Bytes of the longest word that is remembered.
LONGEST = 64
#: Bytes of text that are cut into words together.
RUN = 8 << 20


def _cuts() -> tuple[bytes, np.ndarray]:
    """The class of each lower-cased byte, and which pairs of classes a word's end lies between (6 * left + right).

    Blank 0, letter 1, sign 2, digit 3, other 4, apostrophe 5.  Digits are pieces of their own, and so
    is a letter's neighbour that is a sign, but what follows an apostrophe may belong to it.  Bytes
    beyond ASCII may combine with what stands before, so nothing is cut there.
    """
    kind = np.full(256, 4, np.uint8)
    for first, end, k in ((9, 14, 0), (32, 33, 0), (33, 48, 2), (48, 58, 3), (58, 97, 2), (97, 123, 1), (123, 127, 2), (39, 40, 5)):
        kind[first:end] = k
    kind[65:91] = 1
    cut = np.zeros(36, bool)
    for left, right in ((a, b) for a in range(6) for b in range(1, 6)):
        cut[6 * left + right] = left in (0, 3) or right == 3 or (left, right) in ((1, 2), (1, 5), (2, 1))
    return kind.tobytes(), cut


_KIND, _CUT = _cuts()


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What a tokenizer's file says where a text's ids are those of its words in turn.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(spec: dict) -> bool:
    """Whether a tokenizer drops case and white space, never looks across blanks, and takes a run of letters as one piece.

    Added tokens must be looked for in the text as it is, so that they can be found there.
    """
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = (spec.get("normalizer") or {}).get("normalizers")
    level = [{k: s.get(k) for k in ("type", "add_prefix_space", "use_regex")} for s in steps[1:]]
    return (
        normal == _NORMALIZERS
        and (steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", "Removed", True)
        and steps[0]["pattern"] == {"Regex": _PIECES}
        and [s["type"] for s in level] == ["ByteLevel"]
        and not level[0]["add_prefix_space"]
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
        and not any(t["normalized"] for t in spec["added_tokens"])
    )


class WordIds:
    """Token ids of texts, by a memory of the ids of their words.

    Holds for tokenizers of which :func:`by_words` is true: there a text's ids are those
    of its words in turn.  The different words of a run of texts are looked up once.  New
    ones of letters alone go to the tokenizer's model together, all others take its
    whole path, as whole texts do under any other tokenizer, or where an added token may stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = by_words(spec)
        self.added = [t["content"].encode().translate(LOWER_ASCII) for t in spec["added_tokens"]]
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65536
        self.kind = "<u4" if self.wide else "<u2"
        self.known: dict[bytes, bytes] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
        # the ids that end a word, where each word has one
        suffix, vocab = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = None
        if suffix and all(c in vocab and c + suffix in vocab for c in level.alphabet()):
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        """Ids of a text by the tokenizer's whole path."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def of_letters(self, words: list[str]) -> list[bytes] | None:
        """Ids of normalized words of letters, by the model alone; None where their ends can't be told."""
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.kind)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words) or last[-1] != len(ids):
            return None
        raw, at = ids.tobytes(), (last * ids.itemsize).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *at[:-1]], at)]

    def new_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not remembered."""
        texts = {w: w.decode("utf-8", "replace") for w in words}
        letters = {w: x for w, x in texts.items() if x.isalpha()} if self.ends is not None else {}
        beyond = [w for w, x in letters.items() if not x.isascii()]
        if beyond:
            normal = self.tokenizer.normalizer.normalize_str(" ".join([letters[w] for w in beyond])).split(" ")
            letters |= zip(beyond, normal, strict=True)
            letters = {w: x for w, x in letters.items() if x.isalpha()}
        found = (self.of_letters(list(letters.values())) if letters else None) or []
        ids = dict(zip(letters, found))
        return ids | {w: self.whole(x) for w, x in texts.items() if w not in ids}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        found = list(map(self.known.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if not new:
            return found
        learned = self.new_ids(new)
        out = [learned[w] if x is None else x for w, x in zip(words, found)]
        if len(self.known) + len(learned) > REMEMBERED:
            self.known = {w: x for w, x in zip(words, found) if x is not None}
        self.known |= {w: x for w, x in learned.items() if len(w) <= LONGEST}
        return out

    def run(self, low: bytes, at: np.ndarray, end: bytes) -> pa.Array:
        """Ids of the lower-cased rows of ``low``, which begin and end at ``at``, each with ``end`` after it."""
        kind = np.frombuffer(low.translate(_KIND), np.uint8)
        first = np.zeros(len(kind), bool)
        inside = kind != 0
        first[1:] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        edges = at[:-1][at[:-1] < len(kind)]
        first[edges] = inside[edges]
        # without blanks, each word ends where the next one begins
        text = np.frombuffer(low, np.uint8)[inside]
        starts = np.append(np.flatnonzero(first[inside]), len(text)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(text)]).dictionary_encode()
        ids = pa.array([*self.ids(words.dictionary.to_pylist()), end], pa.binary())
        rows = np.searchsorted(np.flatnonzero(first), at)
        turn = np.insert(words.indices.to_numpy(), rows[1:], len(ids) - 1)
        placed = ids.take(pa.array(turn))
        own = np.frombuffer(placed.buffers()[1], np.int32, len(turn) + 1)[rows + np.arange(len(rows))]
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(own), placed.buffers()[2]])

    def encode(self, text: bytes, end: bytes = b"") -> bytes:
        """Ids as packed little-endian integers of ``kind``, with ``end`` after them."""
        low = text.translate(LOWER_ASCII)
        if not self.by_words or any(t in low for t in self.added):
            return self.whole(text.decode("utf-8", "replace")) + end
        parts, lo = [], 0
        while lo < len(low):
            hi = lo + RUN
            if hi < len(low):  # a part goes as far as a blank
                blank = _BLANK.search(low, hi)
                hi = blank.start() if blank else len(low)
            part = low[lo:hi]
            parts.append(self.run(part, np.array([0, len(part)]), b"")[0].as_py())
            lo = hi
        return b"".join([*parts, end])

    def encode_rows(self, flat: np.ndarray, at: np.ndarray, end: bytes) -> Iterator[tuple[int, int, pa.Array]]:
        """(first row, end of rows, their ids each with ``end`` after them) of runs of the rows of ``flat``."""
        for lo, hi in runs_of_rows(at, RUN):
            raw, own = flat[at[lo] : at[hi]].tobytes(), at[lo : hi + 1] - at[lo]
            low = raw.translate(LOWER_ASCII) if self.by_words else b""
            if self.by_words and len(raw) <= 2 * RUN and not any(t in low for t in self.added):
                yield lo, hi, self.run(low, own, end)
            else:
                yield lo, hi, pa.array([self.encode(raw[a:b], end) for a, b in zip(own[:-1].tolist(), own[1:].tolist())], pa.binary())


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The tokenizer and word memory of this Python worker, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs side by side
    return WordIds(path)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, before, n, ids): each row's ids, and the ids before it in its partition.  Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        size = 4 if words.wide else 2
        end = int(end_id).to_bytes(size, "little")
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            flat, at = as_bytes(batch.column(1))
            for lo, hi, ids in words.encode_rows(flat, at, end):
                n = pc.binary_length(ids).to_numpy().astype(np.int64) // size
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(start), pa.array(n), ids], names=["doc_id", "part", "before", "n", "ids"])

    text = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(text.mapInArrow(run, "doc_id long, part int, before long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens: the stream of all documents, cut every ``window`` ids.

    Per piece: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset, and the ids if asked.  Every sequence but the last
    is full, so padding is less than one window.  A null or empty text is one end id;
    a text of any length is cut into as many pieces as it needs.  Rows may share a
    doc_id or be equal, each is packed by itself; other columns are ignored; an empty
    table gives no pieces.  The order is that of the input's partitions and rows.
    """
    tokens = token_table(docs, tokenizer, end_id)
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # one row for each task of pass one, however long the texts are
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first, last = at // window, (at + n - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(batch.num_rows), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + nth
            lo = np.maximum(seq * window, at[row]) - at[row]
            hi = np.minimum((seq + 1) * window, at[row] + n[row]) - at[row]
            crc = np.zeros(len(row), np.int64)
            ids: list[np.ndarray] = []
            own, held = np.zeros(0, "<u4"), -1
            for k, r in enumerate(row):
                if r != held:
                    raw = batch.column(3)[int(r)].as_py()
                    own, held = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n[r] else "<u4").astype("<u4"), r
                piece = own[lo[k] : hi[k]]
                crc[k] = zlib.crc32(piece.tobytes())
                if with_ids:
                    ids.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (lo, hi - lo, crc, n[row], seq, lo + at[row] - seq * window))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, length, pieces): whole sequences with a boundary record of each piece.

    Padded to ``window`` unless the length is a power of two.  A sequence has at most
    ``window`` pieces, so its group is bounded.  ``pieces`` is what :func:`pack` gives
    with ids; null or shared doc_ids stay as they are, other columns are left out, and
    no pieces give no sequences.
    """
    record = F.struct("offset", "doc_id", "start", "length", "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(record)).alias("p"), F.sum("length").alias("length"))
    exact = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    padding = F.when(exact, F.lit(0)).otherwise(window - F.col("length")).cast("int")
    return grouped.select(
        "sequence_id",
        F.concat(F.flatten(F.transform("p", lambda x: x["ids"])), F.array_repeat(F.lit(pad_id), padding)).alias("ids"),
        "length",
        F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
    )
