"""WARC archives that hold equal payloads once, and their records put together again.

``write`` deals records to archives: a ``response`` holds its payload, a ``revisit`` of an
equal payload only names the response (WARC 1.1, identical-payload-digest).  ``read``
takes any such archives to records, and ``store`` keeps these content-addressed: payloads
once, by SHA-256 that is taken from the bytes themselves, and apart from them the exact
bytes of every record's headers.  ``restore`` joins both to the original records.

The digests and the choice among equal payloads are Spark expressions over keys; payloads
are dealt out once, to meet the headers of their response.  Archives are text files of
Spark's writer whose lines end as WARC records do, so they can lie in any store, and
compressed ones are read as a stream, a task for each file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded, cut, discard, shared_dir

END = "\r\n\r\n"
#: Fixed values of the format.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "urn:x-page:"

RECORDS = "file string, place long, headers binary, http binary, payload binary, record_type string, record_id string, refers_to string, declared string, sha256 binary, n_bytes long"


def base32(hex_digest: Column) -> Column:
    """A hex digest of whole tens of digits in upper-case base 32: eight signs for each ten."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def line_safe(c: Column) -> Column:
    """A header's value: without line breaks, a null one empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", "%0A")


def prepared(df: DataFrame, key: str, uri: str, payload: str, least: int) -> DataFrame:
    """(key, uri, sha256, sha1, n_bytes, copies, shared, first, top): different rows, with the key that stands for their payload."""
    body = F.coalesce(F.col(f"`{payload}`").cast("string").cast("binary"), F.lit(b""))
    digests = df.select(F.col(f"`{key}`").cast("long").alias("key"), line_safe(F.col(f"`{uri}`").cast("string")).alias("uri"), body.alias("body"))
    rows = digests.select("key", "uri", F.unhex(F.sha2("body", 256)).alias("sha256"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n_bytes"))
    # rows alike in everything count as copies; the digest of the bytes is written once and never taken again
    alike = cut(rows.groupBy("key", "uri", "sha256", "sha1", "n_bytes").agg(F.count("*").alias("copies")))
    # the payload's key is its length and both digests: bytes unlike under all three are not known to exist
    large = alike.where(F.col("n_bytes") >= least)
    top = cut(large.groupBy("sha256", "sha1", "n_bytes").agg(F.max(F.struct(F.col("key"), F.col("uri"))).alias("top")))
    told = alike.join(top, ["sha256", "sha1", "n_bytes"], "left")
    is_top = F.col("top").isNull() | (F.col("key").eqNullSafe(F.col("top.key")) & (F.col("uri") == F.col("top.uri")))
    return told.select("key", "uri", "sha256", "sha1", "n_bytes", "copies", F.col("top").isNotNull().alias("shared"), is_top.alias("first"), F.col("top.key").alias("top"))


def headers(kind: Column, key: Column, copy: Column, uri: Column, sha1: Column, length: Column, refers_to: Column, date: str) -> Column:
    """The lines of a record's headers, up to the empty one after them."""
    urn = lambda k, n: F.concat(F.lit(f"<{RECORD}"), F.coalesce(k.cast("string"), F.lit("")), F.lit(":"), n.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(refers_to, F.lit(0))))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", urn(key, copy)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(sha1))), F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), F.lit("Content-Length: "), length.cast("string"),
    )


def write(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Archives with a record for each row of ``df``; other columns are of no account, whatever their names.

    Of records with equal payloads of ``least`` bytes and more, that with the largest key
    is a response (of several with that key, the one with the largest address), all others
    revisit it; smaller payloads are all responses.  A null payload is empty, a null key
    comes after all others, and a null address is empty.  Rows alike in everything are records
    of their own, and the first of them stands for the group.  A key that is no whole number fails.
    """
    told = cut(prepared(df, key, uri, payload, least))
    # copies of one row: all alike where small; else the first holds the payload and the rest revisit it
    each = told.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    kind = F.when(~F.col("shared") | (F.col("first") & (F.col("copy") == 0)), "response").otherwise("revisit")
    each = each.withColumn("kind", kind)
    length = F.when(F.col("kind") == "response", F.col("n_bytes")).otherwise(0) + len(HTTP)
    head = headers(F.col("kind"), F.col("key"), F.col("copy"), F.col("uri"), F.col("sha1"), length, F.col("top"), date)
    records = each.select("key", "uri", "sha256", "kind", F.concat(head, F.lit(END + HTTP)).alias("head"))
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("_key"), line_safe(F.col(f"`{uri}`").cast("string")).alias("_uri"), body.alias("_body")).withColumn("_sha256", F.unhex(F.sha2(F.col("_body").cast("binary"), 256)))
    # the rows that hold a response's payload: unlike keys, so a payload of many records is dealt out by them
    wanted = cut(records.where("kind = 'response'"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("uri") == F.col("_uri")) & (F.col("sha256") == F.col("_sha256"))
    if not told.where("copies > 1").isEmpty():  # of rows alike in everything one is enough
        rows = rows.groupBy("_key", "_uri", "_sha256").agg(F.first("_body").alias("_body"))
    full = wanted.join(rows, same).select(F.concat("head", "_body").alias("value"))
    light = records.where("kind = 'revisit'").select(F.col("head").alias("value"))
    full.unionByName(light).write.option("lineSep", END).option("compression", compression).text(path)


FIELD = re.compile(rb"\r\n([!-9;-~]+):[ \t]*([^\r\n]*)")


class Archive:
    """Takes the pieces of one archive's text, in order, and gives its records."""

    def __init__(self, file: str):
        self.file, self.place, self.buffer, self.head, self.length = file, 0, bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[dict]:
        """The records that the next piece, up to an ``END`` that is not in it, brings to their end."""
        self.buffer += piece
        self.buffer += END.encode()
        while True:
            if self.head is None:
                at = self.buffer.find(END.encode())
                if at < 0:
                    return
                self.head = bytes(self.buffer[:at])
                if not self.head.startswith(b"WARC/"):
                    raise ValueError(f"{self.file}: no record begins after record {self.place}; archives must be compressed, so that a task has a whole one")
                del self.buffer[: at + 4]
                self.fields = {k.lower(): v.strip() for k, v in reversed(FIELD.findall(self.head))}
                self.length = int(self.fields[b"content-length"])
            if len(self.buffer) < self.length + 4:
                return
            if self.buffer[self.length : self.length + 4] != END.encode():
                raise ValueError(f"{self.file}: record {self.place} does not end where its length says")
            block = bytes(self.buffer[: self.length])
            del self.buffer[: self.length + 4]
            yield self.record(block)
            self.head, self.place = None, self.place + 1

    def record(self, block: bytes) -> dict:
        http, payload = b"", block
        if self.fields.get(b"content-type", b"").startswith(b"application/http"):
            at = block.find(END.encode())
            http, payload = (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")
        said = lambda name: self.fields[name].decode("utf-8", "replace").strip("<>") if name in self.fields else None
        kind = said(b"warc-type")
        held = kind != "revisit"
        return {
            "file": self.file, "place": self.place, "headers": self.head, "http": http, "payload": payload if held else None, "record_type": kind, "record_id": said(b"warc-record-id"),
            "refers_to": said(b"warc-refers-to"), "declared": said(b"warc-payload-digest"), "sha256": hashlib.sha256(payload).digest() if held else None, "n_bytes": len(payload) if held else None,
        }

    def end(self) -> None:
        if self.head is not None or self.buffer.strip():
            raise ValueError(f"{self.file}: the last record has no end")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of compressed archives, one row each, as ``RECORDS``; a folder without records gives none.

    A payload is what follows the HTTP headers, or the whole block of another content; that
    of a revisit is null.  A text that is no archive fails and names the file.
    """
    pieces = bounded(spark.read.option("lineSep", END).text(path)).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])
        archive, out, size = None, [], 0
        for b in batches:
            for file, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if archive is None or archive.file != file:
                    if archive:
                        archive.end()
                    archive = Archive(file)
                for r in archive.feed(value.as_py()):
                    out.append(r)
                    size += len(r["headers"]) + (r["n_bytes"] or 0)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
        if archive:
            archive.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return pieces.mapInArrow(parse, RECORDS)


def store(records: DataFrame, path: str) -> None:
    """Records of :func:`read`, content-addressed: ``part=headers`` has a row for each, ``part=payloads`` each payload once.

    One pass writes both.  Only where payloads repeat are they written again, those of the
    first record of each kept.
    """
    own = F.struct(F.lit("headers").alias("part"), F.lit(None).cast("binary").alias("payload"))
    body = F.struct(F.lit("payloads").alias("part"), F.col("payload"))
    rows = records.withColumn("_two", F.array(own, body)).drop("payload").select("*", F.inline("_two")).drop("_two").where("part = 'headers' or payload is not null")
    # headers and HTTP lines stand with the record, not with its payload
    slim = rows.select(*[F.when(F.col("part") == "headers", F.col(c)).alias(c) if c in ("headers", "http", "declared", "refers_to") else F.col(c) for c in rows.columns])
    slim.write.partitionBy("part").option("compression", "zstd").mode("overwrite").parquet(path)
    spark = records.sparkSession
    if not _has(spark, f"{path}/part=payloads"):
        return
    held = spark.read.parquet(f"{path}/part=payloads")
    if held.groupBy("sha256", "n_bytes").count().where("count > 1").isEmpty():
        return
    first = cut(held.groupBy("sha256", "n_bytes").agg(F.min(F.struct("file", "place")).alias("at")).select("at.*"))
    once = held.join(first, ["file", "place"], "left_semi").select(held.columns)
    target = f"{path}/part=payloads"
    once.write.option("compression", "zstd").parquet(f"{path}-once")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(target), True)
    fs.rename(at(f"{path}-once"), at(target))
    discard(first)


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The original records of a :func:`store`, each with its payload again, that of a revisit too.

    Columns: file, place, headers, http, payload, record_type, record_id, refers_to,
    payload_bytes, payload_digest.  Lengths and digests are taken from the stored bytes; a
    payload that is not what its SHA-256 or the record's own digest says fails.  Where the
    payload is not selected, only its facts are joined.  A revisit of a record that the
    store has not keeps null in the columns of the payload.
    """
    schema = RECORDS.replace("payload binary, ", "")
    found = _has(spark, f"{path}/part=headers")
    heads = spark.read.schema(schema).parquet(f"{path}/part=headers") if found else spark.createDataFrame([], schema)
    has = _has(spark, f"{path}/part=payloads")
    held = spark.read.parquet(f"{path}/part=payloads") if has else spark.createDataFrame([], RECORDS)
    intact = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    sha1 = F.when(intact, base32(F.sha1("payload"))).otherwise(F.raise_error(F.lit("a stored payload is not what its digest says")))
    payloads = held.select("sha256", "n_bytes", "payload", sha1.alias("payload_digest"))
    # what a revisit names is told by the record id; ids given to several records stand for the first
    named = heads.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct("file", "place", "sha256", "n_bytes")).alias("of"))
    keep = [c for c in heads.columns if c not in ("sha256", "n_bytes")]
    revisits = heads.where("record_type = 'revisit'").drop("sha256", "n_bytes").join(named, "refers_to", "left").select(*keep, "of.sha256", "of.n_bytes")
    full = heads.where("record_type <> 'revisit' or record_type is null").select(*keep, "sha256", "n_bytes").unionByName(revisits).join(payloads, ["sha256", "n_bytes"], "left")
    agrees = F.col("declared").isNull() | F.col("payload_digest").isNull() | ~F.col("declared").startswith("sha1:") | (F.col("declared") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    digest = F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest of record "), F.coalesce("record_id", F.lit("?")))))
    return full.select("file", "place", "headers", "http", "payload", "record_type", "record_id", "refers_to", F.col("n_bytes").alias("payload_bytes"), digest.alias("payload_digest"))


def original(records: DataFrame) -> DataFrame:
    """(file, place, record): the bytes of each record of :func:`restore` as they stood in its archive."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))
    end = F.lit(END.encode())
    return records.select("file", "place", F.concat("headers", end, F.coalesce("http", F.lit(b"")), body, end).alias("record"))


def page_of(urn: Column) -> Column:
    """The key in a record's name; null for a record without one."""
    return F.nullif(F.regexp_extract(urn, f"^{RECORD}(-?[0-9]*):[0-9]+$", 1), F.lit("")).cast("long")


def pages(df: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``df(page_id, url, html)``, by way of archives.

    The archives are written, read, stored by content and put together again; see
    :func:`write` for nulls and ties.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(df, f"{at}/archives", least=least)
    store(read(spark, f"{at}/archives"), f"{at}/store")
    found = restore(spark, f"{at}/store")
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


#: Base 32 from the hex digest: eight signs for each ten digits.
ORACLE_SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha256(body)) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', (((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""
