"""Queries for diffs as files, chunks taken up again and one JSON document, and for workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import stored
from ..session import scratch
from ..sources import xlsx
from ..sources.exports import ChunkedExport, write_document
from . import catalogue
from .catalogue import DIFF, add, table

#: A chunk holds a thirtieth of the orders, so about seven hold the changed ones.
CHUNKS = 30


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """All chunks of a diff, of which a first run left every second one; the second run has no tables to join."""
    path = scratch(s)
    found = catalogue._diff(s, d)
    size = table(s, d, "orders").count() // CHUNKS + 1
    first = ChunkedExport(s, path)
    first.prepare(found, size)
    for chunk in first.missing()[::2]:
        first.write(chunk)
    ChunkedExport(s, path).run(found, size)
    rows = s.read.option("header", True).csv(f"{path}/chunks/*")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"chunks/(\d+)/", 1).cast("long").alias("chunk"), "Status", "o_orderkey", "o_orderstatus")


EXPORTED = f"""{DIFF} SELECT (row_number() OVER (ORDER BY b_o_orderkey NULLS LAST, a_o_orderkey NULLS LAST) - 1) // ((SELECT count(*) FROM orders) // {CHUNKS} + 1) AS chunk, diff_status AS "Status",
  coalesce(b_o_orderkey, a_o_orderkey)::VARCHAR AS o_orderkey, coalesce(b_o_orderstatus, a_o_orderstatus) AS o_orderstatus FROM x WHERE diff_status <> 'unchanged'"""
add("diff_export_chunks", _chunks, EXPORTED)


def _document(s: SparkSession, d: str) -> DataFrame:
    """The document's results, read from its lines as a file of JSON lines; ends have no status."""
    path = scratch(s)
    write_document(catalogue._diff(s, d), path)
    row = F.from_json(F.rtrim(F.col("value"), F.lit(",")), "status string, rowA struct<o_orderkey:long>, rowB struct<o_orderkey:long, o_orderstatus:string>, modifiedColumns array<string>").alias("r")
    return s.read.text(path).select(row).where("r.status IS NOT NULL").select("r.status", F.col("r.rowA.o_orderkey").alias("a"), F.col("r.rowB.o_orderkey").alias("b"), F.col("r.rowB.o_orderstatus").alias("value"), F.array_join("r.modifiedColumns", ",").alias("names"))


add("diff_document", _document, f"{DIFF} SELECT diff_status AS status, a_o_orderkey AS a, b_o_orderkey AS b, b_o_orderstatus AS value, CASE WHEN diff_status = 'modified' THEN 'o_orderstatus' ELSE '' END AS names FROM x WHERE diff_status <> 'unchanged'")


# --- workbooks ----------------------------------------------------------------------------------


def _sheets(s: SparkSession, d: str) -> DataFrame:
    """All orders as workbooks, and the rows of their first sheets."""
    rows = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.concat(F.lit("<a> & _x0041_ \n"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("note"))
    return xlsx.sheets(stored(xlsx.workbooks(rows, 4000)))


add("source_xlsx", _sheets, "SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, '<a> & _x0041_ ' || chr(10) || o_custkey || ' ' AS note FROM orders")
