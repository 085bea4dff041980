"""Change logs: edits, inserted and deleted rows, folded into the table that they are of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commands import CommandError
from ..operators.ids import ORIGIN_ID, ROW_ID, fresh
from ..sources.files import append_changes
from ..sources.versions import Versions

#: An entry: its place in the log, what it did, the rows that it did it to, and for edits the cell and its text.
LOG = "seq long, ts timestamp, kind string, row_ids array<long>, column string, value string, origin_id string"
KINDS = ("cell_edit", "insert_row", "delete_row")
#: Entries from which a log is worth folding.
ENOUGH = 1000


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a folder of JSON lines; those without a kind are edits."""
    return spark.read.schema(LOG).json(path).withColumn("kind", F.coalesce("kind", F.lit("cell_edit")))


def folded(log: DataFrame) -> DataFrame:
    """(row, last, cells): of each row that a log names, its last insert or delete, and the cells written after that.

    Entries count in the order of ``ts`` and ``seq``; equal ones by value.  A cell keeps one entry of its log before rows
    are put together, so a row or a cell that is written over and over costs one row of each task.
    """
    each = log.select("kind", "ts", "seq", "column", "value", "origin_id", F.explode(F.array_distinct("row_ids")).alias("row"))
    order = F.struct("ts", "seq")
    structural = F.col("kind").isin("insert_row", "delete_row")
    write = F.struct("ts", "seq", "value")
    # one entry for each cell, and one for the row's last insert or delete
    cells = each.withColumn("cell", F.when(~structural, F.col("column"))).groupBy("row", "cell").agg(
        F.max(F.when(structural, F.struct(order.alias("at"), "kind", "origin_id"))).alias("last"), F.max(F.when(~structural, write)).alias("write")
    )
    written = F.struct(F.col("cell"), F.col("write.value").alias("value"), F.struct("write.ts", "write.seq").alias("at"))
    rows = cells.groupBy("row").agg(F.max("last").alias("last"), F.collect_list(F.when(F.col("write").isNotNull(), written)).alias("cells"))
    after = F.filter("cells", lambda c: F.col("last").isNull() | (c["at"] > F.col("last.at")))
    return rows.select("row", "last", F.map_from_entries(F.transform(after, lambda c: F.struct(c["cell"], F.struct(c["value"].alias("value"))))).alias("cells"))


def fold(table: DataFrame, log: DataFrame) -> DataFrame:
    """``table`` after all entries of ``log``, with its columns and their types.

    A deleted row goes, and what was written to it before or afterwards with it, unless it is inserted
    again: an inserted row is empty but for what is written to it later, even where
    the id was there before.  An edit of a row that is not there does nothing, nor does one of a column that
    is not there; a text that does not fit a column's type gives null.  Rows no entry names stay as they are.
    """
    if ROW_ID not in table.columns:
        raise CommandError("COLUMN_NOT_FOUND", f"no column {ROW_ID}")
    names = {c: fresh(f"_{c}", table) for c in ("row", "last", "cells")}
    row, last, cells = names.values()
    changes = folded(log).withColumnsRenamed(names)
    there = fresh("_there", table)
    joined = table.withColumn(there, F.lit(True)).join(changes, F.col(ROW_ID) == F.col(row), "full")
    inserted, deleted = F.col(f"{last}.kind") == "insert_row", F.col(f"{last}.kind") == "delete_row"
    stays = F.coalesce(inserted, F.lit(False)) | (F.col(there) & ~F.coalesce(deleted, F.lit(False)))

    def value(c: str) -> Column:
        if c == ROW_ID:
            return F.coalesce(F.col(ROW_ID), F.col(row).cast(table.schema[ROW_ID].dataType))
        kind = table.schema[c].dataType
        if c == ORIGIN_ID:
            made = F.coalesce(f"{last}.origin_id", F.sha2(F.concat(F.lit("insert:"), F.col(row).cast("string")), 256).substr(1, 32))
            return F.when(inserted, made).otherwise(F.col(f"`{c}`"))
        cell = F.try_element_at(cells, F.lit(c))
        old = F.when(inserted, F.lit(None).cast(kind)).otherwise(F.col(f"`{c}`"))
        return F.when(cell.isNotNull(), cell["value"].try_cast(kind)).otherwise(old)

    return joined.where(stays).select(*[value(c).alias(c) for c in table.columns])


class EditedTable:
    """A table with its change log, in one folder: whole states, and the entries since the last of them.

    A state's number is the place in the log up to which it was folded.  So folding
    twice, or again after a crash, does the same once, and entries that stay in
    the log after they were folded are passed over.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.log_path, self.keep = spark, f"{path.rstrip('/')}/log", keep
        self.states = Versions(spark, f"{path.rstrip('/')}/states")

    def create(self, table: DataFrame) -> None:
        self.states.write(table, 0)

    def append(self, entries: DataFrame) -> None:
        """Add entries of ``LOG``; their ``seq`` must be above those before, from 1 on."""
        append_changes(entries, self.log_path)

    def pending(self, after: int | None = None) -> DataFrame:
        """Entries that no state holds, or those after a place."""
        after = self.states.latest() if after is None else after
        if not self.states._fs.exists(self.states._at(self.log_path)):
            return self.spark.createDataFrame([], LOG)
        return read_log(self.spark, self.log_path).where(F.col("seq") > after)

    def current(self) -> DataFrame:
        at = self.states.latest()
        return fold(self.states.read(at), self.pending(at))

    def compact(self, force: bool = False, enough: int = ENOUGH) -> int:
        """Write a new state if ``enough`` entries wait, or any with ``force``; returns how many were folded."""
        at = self.states.latest()
        waiting = self.pending(at)
        found = waiting.agg(F.count("*").alias("n"), F.max("seq").alias("top")).first()
        if not found["n"] or (found["n"] < enough and not force):
            return 0
        # entries that come meanwhile have higher places and wait for the next state
        self.states.write(fold(self.states.read(at), waiting.where(F.col("seq") <= found["top"])), found["top"])
        for old in self.states.numbers()[: -self.keep]:
            self.states.drop(old)
        return found["n"]
