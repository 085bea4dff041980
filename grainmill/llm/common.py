"""Shared helpers: the cluster's shared folder, Arrow text access, words, 64-bit hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z, everything else unchanged.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_TABLE = np.frombuffer(LOWER_ASCII, dtype=np.uint8)
#: Bytes of an Arrow batch beyond which it ends; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Bytes of text that are worked on together.
SLICE = 1 << 20


def lower_ascii(column):
    """Lower-case A-Z only, leaving all other code points alone."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to ``BATCH_BYTES``, however long its rows are."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = conf.get(key, None)
    if not found or not re.fullmatch(r"\d+b?", found) or not 0 < int(found.rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where that is unset, a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="grainmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to a Parquet table in the shared folder and are read from there.

    ``done``: earlier such tables that only these rows were made of; they are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/grainmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array, with row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if array.null_count:
        array = array.fill_null(b"")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * array.offset) if n else np.zeros(1, np.int64)
    data = array.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def runs_of_rows(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``target`` bytes each, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def split_words(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; ``own``: where the rows of ``data`` begin and end."""
    inside = ~is_blank(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[own] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(own, start, side="right") - 1


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where they stand there."""
    size = end - start
    new = np.cumsum(size + 1) - size - 1
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    out[new[word] + at] = data[start[word] + at]
    return out.tobytes(), new, new + size


def _parts(text: np.ndarray, width: int, size: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(part, whether others stand before it) of one text: each run of ``width`` words lies whole in one part."""
    lo, span = 0, size
    while True:
        part = text[lo : lo + span]
        if lo + span >= len(text):
            yield part, lo > 0
            return
        blanks = np.flatnonzero(is_blank(part))
        part = part[: blanks[-1]] if len(blanks) else part[:0]
        start, _, _ = split_words(part, np.array([0, len(part)]))
        if len(start) < 2 * width:  # very long words: a larger part
            span *= 2
            continue
        yield part, lo > 0
        lo, span = lo + int(start[len(start) - width + 1]) if width > 1 else lo + len(part), size


def shingle_runs(flat: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, end, row) of the shingles of ``width`` words of all rows, A-Z lower-cased, a slice at a time.

    A row of fewer words is one shingle, one without words has none.  Rows ascend within
    a slice; a row longer than a slice comes in several.
    """
    for lo, hi in runs_of_rows(at, SLICE):
        if hi - lo == 1 and at[hi] - at[lo] > 2 * SLICE:
            slices = ((part, np.array([0, len(part)]), more) for part, more in _parts(flat[at[lo] : at[hi]], width, SLICE))
        else:
            slices = ((flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], False),)
        for data, own, more in slices:
            start, end, row = split_words(data, own)
            if not len(start):
                continue
            text, s, e = spaced(LOWER_TABLE[data], start, end)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            count = np.diff(np.append(first, len(row)))
            head = np.arange(len(row)) + width <= np.repeat(first + count, count)
            if not more:
                head[first[count < width]] = True
            head = np.flatnonzero(head)
            tail = np.minimum(head + width, np.repeat(first + count, count)[head]) - 1
            yield text, s[head], e[tail], lo + row[head]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_POWERS.get("base", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, value in (("base", BASE), ("inverse", pow(BASE, -1, 2**64))):
            steps = np.full(size, value, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["base"][:n], _POWERS["inverse"][:n]


class PrefixHash:
    """Polynomial hashes of any substring of ``data`` from one cumulative sum."""

    def __init__(self, data: np.ndarray):
        base, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * base[:-1], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of each window of ``size`` bytes."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.inverse[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each given span, length included."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix64(raw ^ (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
