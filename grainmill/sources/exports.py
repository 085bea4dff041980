"""Diffs as files: chunks that a later run can go on with, and one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import Diff, export_values, json_row
from ..operators.ids import discard, numbered, stored
from . import files

STATUSES = ("added", "removed", "modified", "unchanged")


def _order(d: Diff) -> list[str]:
    """The order of the pages, and by the keys where rows have no ids."""
    return ["sort_key", "row_id", *[f"{p}_{k}" for p in ("b", "a") for k in d.keys]]


def _rows(d: Diff, value: Column, unchanged: bool) -> tuple[DataFrame, dict[str, int]]:
    """``value`` of each exported row with its place from 1 on, and the number of rows of each status.

    The tables are joined once: rows that are not exported leave only their status in
    the written table that both come from.
    """
    wanted = F.lit(True) if unchanged else F.col("diff_status") != "unchanged"
    order = [F.when(wanted, F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(_order(d))]
    rows = d.with_modified_columns().select(F.col("diff_status").alias("status"), F.when(wanted, value).alias("value"), *order)
    every = stored(rows)
    counts = {r["status"]: r["count"] for r in every.groupBy("status").count().collect()}  # four rows at most
    placed = numbered(every.where("value IS NOT NULL"), "place", [f"_{i}" for i in range(len(order))])
    discard(every)
    return placed.select("place", "value"), {s: counts.get(s, 0) for s in STATUSES}


class ChunkedExport:
    """A diff as CSV chunks of ``rows_a_chunk`` rows in the order of the pages, in one folder.

    The first run joins the tables once and writes the exported rows by chunk under
    ``rows``, then ``manifest.json`` with meta, summary and the number of chunks.  Each
    chunk under ``chunks`` is a Spark job of its own over its own rows, in files of
    ``rows_a_file`` whose names are in order; it counts when its ``_SUCCESS`` is there.
    A later run finds the manifest, joins nothing and writes the chunks that are missing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, chunk: int) -> str:
        return f"{self.path}/chunks/{chunk:08d}"

    def manifest(self) -> dict | None:
        at = self._at(f"{self.path}/manifest.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def prepare(self, d: Diff, rows_a_chunk: int = 10_000_000, unchanged: bool = False) -> dict:
        """The manifest, after writing the rows of ``d`` by chunk where there is none yet."""
        if rows_a_chunk < 1:
            raise ValueError("a chunk has at least one row")
        meta = {"keyColumns": d.keys, "newColumns": d.new_columns, "removedColumns": d.removed_columns, "rowsAChunk": rows_a_chunk, "unchanged": unchanged}
        if found := self.manifest():
            if found["meta"] != meta:
                raise ValueError("the folder holds the export of another diff or of other chunks")
            return found
        rows, summary = _rows(d, F.struct(*export_values(d)), unchanged)
        chunk = F.floor((F.col("place") - 1) / rows_a_chunk)
        # a range shuffle by place gives a task the rows of a few chunks, not of all
        placed = rows.withColumn("chunk", chunk.cast("long")).repartitionByRange("place")
        placed.write.mode("overwrite").partitionBy("chunk").parquet(f"{self.path}/rows")
        total = sum(summary.values()) - (0 if unchanged else summary["unchanged"])
        made = {"meta": meta, "summary": summary, "rows": total, "chunks": -(-total // rows_a_chunk)}
        self._put("manifest.json", json.dumps(made))
        return made

    def _put(self, name: str, text: str) -> None:
        """A small file, whole or not there at all."""
        half = self._at(f"{self.path}/_{name}.part")
        stream = self._fs.create(half, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(half, self._at(f"{self.path}/{name}")):
            raise OSError(f"could not write {self.path}/{name}")

    def missing(self) -> list[int]:
        """Chunks that no run has finished, in order."""
        made = self.manifest()
        if made is None:
            raise ValueError("nothing was prepared in this folder")
        return [c for c in range(made["chunks"]) if not self._fs.exists(self._at(f"{self.folder(c)}/_SUCCESS"))]

    def write(self, chunk: int, rows_a_file: int = 250_000) -> None:
        made = self.manifest()
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("chunk") == chunk)
        files_needed = -(-min(made["meta"]["rowsAChunk"], made["rows"]) // rows_a_file)
        ordered = rows.repartitionByRange(files_needed, "place").sortWithinPartitions("place").select("value.*")
        files.write_csv(ordered, self.folder(chunk))

    def run(self, d: Diff, rows_a_chunk: int = 10_000_000, unchanged: bool = False) -> list[int]:
        """Write all chunks that are missing; their numbers."""
        self.prepare(d, rows_a_chunk, unchanged)
        todo = self.missing()
        for chunk in todo:
            self.write(chunk)
        return todo


def write_document(d: Diff, path: str, unchanged: bool = False, one_file: bool = False) -> dict[str, int]:
    """One JSON document of a diff: meta, summary and results; gives the summary.

    Its text files in the order of their names, one behind the other, are the document,
    a row of the diff in each line; ``one_file`` writes it from one task, row by row.
    """
    rows, summary = _rows(d, json_row(d), unchanged)
    total = sum(summary.values()) - (0 if unchanged else summary["unchanged"])
    meta = {"keyColumns": d.keys, "newColumns": d.new_columns, "removedColumns": d.removed_columns}
    head = f'{{"meta": {json.dumps(meta)}, "summary": {json.dumps(summary)}, "results": ['
    lines = rows.select("place", F.concat("value", F.when(F.col("place") < total, ",").otherwise("")).alias("value"))
    ends = d.rows.sparkSession.createDataFrame([(0, head), (total + 1, "]}")], "place long, value string")
    every = lines.unionByName(ends)
    every = every.repartitionByRange(*([1] if one_file else []), "place")
    every.sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
    return summary
