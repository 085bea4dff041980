"""Reading and writing files: CSV, JSON, Parquet, Excel sheets, change logs."""

from __future__ import annotations

import re
import statistics
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import user_columns, with_ids
from .xlsx import read_xlsx

DELIMITERS = (",", "\t", "|", ";")


def split_line(line: str, delimiter: str = ",") -> list[str]:
    """Fields of a line; quotes protect delimiters, and doubled quotes stand for one."""
    fields, field, quoted, i = [], [], False, 0
    while i < len(line):
        ch = line[i]
        if ch == '"' and quoted and line[i + 1 : i + 2] == '"':
            field.append('"')
            i += 1
        elif ch == '"':
            quoted = not quoted
        elif ch == delimiter and not quoted:
            fields.append("".join(field))
            field = []
        else:
            field.append(ch)
        i += 1
    return [*fields, "".join(field)]


def detect_delimiter(lines: list[str]) -> str:
    """The sign with many and even counts a line; the first of ``, tab | ;`` wins ties."""

    def score(sign: str) -> float:
        counts = [len(split_line(x, sign)) - 1 for x in lines if x.strip()]
        return statistics.fmean(counts) / (1 + statistics.pstdev(counts)) if counts else 0.0

    return max(DELIMITERS, key=score)


def detect_encoding(head: bytes) -> str:
    try:
        head[: len(head) - 3 if len(head) > 3 else len(head)].decode("utf-8")
    except UnicodeDecodeError as e:
        return "utf-8" if e.end >= len(head) - 3 and "unexpected end" in e.reason else "iso-8859-1"
    return "utf-8"


def _listed(spark: SparkSession, path: str) -> tuple:
    """The store of a path, and its file or the files of its folder by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, sorted((s for s in store.listStatus(at) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda s: s.getPath().getName())


def heads_of(spark: SparkSession, path: str, size: int = 65536) -> list[bytes]:
    """The first ``size`` bytes of a file, or of the files of a folder by name, in any store that Spark reads: a text for each file.

    A folder's first file may be empty or hold a header alone, as its first task had no row, so what comes
    after is read as well.
    """
    store, found = _listed(spark, path)
    if not found:
        raise ValueError(f"no file in {path}")
    heads: list[bytes] = []
    for f in found:
        n = int(min(size - sum(map(len, heads)), f.getLen()))
        if not n:
            continue
        stream = store.open(f.getPath())
        try:
            heads.append(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)))
        finally:
            stream.close()
        if sum(map(len, heads)) >= size:
            break
    return heads or [b""]


def head_of(spark: SparkSession, path: str, size: int = 65536) -> bytes:
    """The first bytes of a file, or of the first file of a folder that is not empty."""
    return heads_of(spark, path, size)[0]


def encoding_of(spark: SparkSession, path: str, heads: list[bytes]) -> str:
    """UTF-8 or ISO-8859-1: by the heads, and where they are plain ASCII, by all lines, which a parallel pass reads."""
    raw = b"\n".join(heads)
    if detect_encoding(raw) != "utf-8":
        return "iso-8859-1"
    if sum(map(len, heads)) == sum(s.getLen() for s in _listed(spark, path)[1]):  # nothing is cut off
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return "iso-8859-1"
        return "utf-8"
    if not raw.isascii():
        return "utf-8"
    sound = spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    return "utf-8" if sound else "iso-8859-1"


def preview(spark: SparkSession, path: str, lines: int = 50) -> dict:
    """First lines with delimiter and encoding; 64 kB are read, and the rest where these are plain ASCII (see :func:`encoding_of`)."""
    heads = heads_of(spark, path)
    encoding = encoding_of(spark, path, heads)
    head: list[str] = []
    for raw in heads:
        own = raw.decode(encoding, "replace").splitlines()
        head += own[1:] if head[:1] == own[:1] else own  # each file of a folder may have the header
    head = head[:-1] if sum(map(len, heads)) == 65536 and len(head) > 1 else head  # the last line may go on
    return {"lines": head[:lines], "delimiter": detect_delimiter(head[:lines]), "encoding": encoding}


def inferred(df: DataFrame) -> DataFrame:
    """Texts cast to the first type that takes every value of a column, from one aggregation."""
    kinds = ("int", "bigint", "double", "boolean", "date", "timestamp")
    found = df.agg(*[F.count(F.col(f"`{c}`").try_cast(k) if k else F.col(f"`{c}`")).alias(f"{i}.{k}") for i, c in enumerate(df.columns) for k in ("", *kinds)]).first()
    best = [next((k for k in kinds if found[f"{i}."] and found[f"{i}.{k}"] == found[f"{i}."]), "string") for i in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(df.columns, best, strict=True)])


def lines_are_records(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a CSV is worth splitting and can be: some file has several parts, and no field holds a line break.

    A line break within quotes leaves an odd number of quotes on its line, so when all
    lines, read in parallel, have an even one, every line is a record.
    """
    if encoding.lower() not in ("utf-8", "iso-8859-1", "us-ascii"):
        return False
    _, found = _listed(spark, path)
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if max((s.getLen() for s in found), default=0) <= part:
        return False
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header_row: int = 1, infer: bool = True) -> DataFrame:
    """A CSV whose header stands on the given line; lines before it are left out.

    Delimiter and encoding are found by a look at the head where they are not given (and see :func:`encoding_of`).  Large
    files without line breaks in quotes are split over tasks, others are a task each.
    With lines before the header the rest is read by the same CSV reader, quoted line
    breaks and all, under the header's names, and the records up to it are dropped.
    """
    heads = heads_of(spark, path)
    encoding = encoding or encoding_of(spark, path, heads)
    raw = heads[0]
    lines = raw.decode(encoding, "replace").splitlines()
    delimiter = delimiter or detect_delimiter(lines[header_row - 1 : header_row + 50])
    options = {"multiLine": True, "sep": delimiter, "escape": '"', "encoding": encoding}
    if header_row <= 1:
        options["multiLine"] = not lines_are_records(spark, path, encoding)
        return spark.read.options(header=True, inferSchema=infer, **options).csv(path)
    if len(lines) < header_row:
        raise ValueError(f"no line {header_row} in the first 64 kB")
    names = split_line(lines[header_row - 1], delimiter)
    skipped = sum(bool(x.strip()) for x in lines[:header_row])  # the reader passes over empty lines
    body = spark.read.options(header=False, **options).schema(", ".join(f"_{i} string" for i in range(len(names)))).csv(path)
    # a file with quoted line breaks is one partition, so this number is the record's place in it
    rows = body.withColumn("_at", F.monotonically_increasing_id()).where(F.col("_at") >= skipped).drop("_at").toDF(*names)
    return inferred(rows) if infer else rows


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A table of JSON lines, which are split over tasks, or of one array, which is not; the first head that says something tells which."""
    said = (h.lstrip(b"\xef\xbb\xbf \t\r\n") for h in heads_of(spark, path))
    head = next((h for h in said if h), b"")
    first, more, _ = head.partition(b"\n")
    # a line that is longer than the head is a record of its own
    lines = first.startswith(b"{") and (first.strip().endswith(b"}") or not more)
    return spark.read.json(path, multiLine=not lines)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {".csv": read_csv, ".tsv": read_csv, ".txt": read_csv, ".json": read_json, ".parquet": read_parquet, ".xlsx": read_xlsx}


def table_name(path: str) -> str:
    """A file's name as a table name."""
    name = re.sub(r"\W+", "_", PurePosixPath(path).stem).strip("_") or "table"
    return f"t_{name}" if name[0].isdigit() else name


def load(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    suffix = f".{kind}" if kind else PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or path}")
    return READERS[suffix](spark, path, **options)


def ingest(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A file as a table with row and origin ids, in the order of its rows."""
    return with_ids(load(spark, path, kind, **options), source=table_name(path))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """User columns with a header; nulls are empty."""
    out = df.select(*[F.col(f"`{c}`") for c in user_columns(df)])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").options(header=True, escape='"', nullValue="", emptyValue="").csv(path)


def write_snapshot(df: DataFrame, path: str, rows_a_file: int = 250_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(path)


def append_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").json(path)


def read_changes(spark: SparkSession, path: str, schema: str = "ts timestamp, row_id long, column string, value string") -> DataFrame:
    return spark.read.schema(schema).json(path)
