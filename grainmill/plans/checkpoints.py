"""Checkpoints: the state of a timeline as a table of its own, beside the lineage that it came by."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation
from ..operators.commands import CommandError
from ..sources.files import write_snapshot
from .history import ROW_COMMANDS, Timeline
from .recipe import Step

LINEAGE = "generation int, step int, source string, action string, details string, rows_affected long, checkpointed_at timestamp"
#: Parameters that no lineage tells.
HIDDEN = ("secret",)


def details(step: Step) -> str:
    """A step's parameters as JSON, without secrets; tables among them by their columns."""
    told = {k: v for k, v in step.params.items() if k not in HIDDEN}
    return json.dumps(told, sort_keys=True, default=lambda v: v.columns if isinstance(v, DataFrame) else str(v))


def rows_affected(line: Timeline) -> DataFrame:
    """(step, rows_affected) of each command up to the position, from one job: rows that it touches, or by which a table
    grows or shrinks; no row for commands that work on columns as wholes."""
    counts = []
    for i, step in enumerate(line.steps[: line.position]):
        before = line.at(i)
        if step.command in ROW_COMMANDS and step.command != "delete_row":
            sizes = before.agg(F.count("*").alias("n")).unionByName(line.at(i + 1).agg((-F.count("*")).alias("n")))
            counts.append(sizes.agg(F.abs(F.sum("n")).alias("rows_affected")).select(F.lit(i + 1).alias("step"), "rows_affected"))
        elif (rows := validation.affected(before, step.command, **step.params)) is not None:
            counts.append(rows.agg(F.count("*").alias("rows_affected")).select(F.lit(i + 1).alias("step"), "rows_affected"))
    if not counts:
        return line.source.sparkSession.createDataFrame([], "step int, rows_affected long")
    return reduce(DataFrame.unionByName, counts)


def checkpoint(line: Timeline, path: str, source: str, parent: str | None = None, counted: bool = True) -> Timeline:
    """The current state written to ``path``, and a new timeline that starts there.

    ``source`` names the table the timeline began with, and ``parent`` is the checkpoint it was read from, if any: its
    lineage comes first, generation by generation.  ``counted`` says whether the rows that each command touched are counted.
    The lineage is written after the rows, so a checkpoint whose writer was lost has none and may be written
    again; one that is whole is refused.
    """
    spark = line.source.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lineage/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise CommandError("CHECKPOINT_EXISTS", f"a checkpoint is there already: {path}")
    earlier = lineage(spark, parent) if parent else spark.createDataFrame([], LINEAGE)
    generation = (earlier.agg(F.max("generation")).first()[0] or 0) + 1
    done = [(generation, i + 1, source, s.command, details(s)) for i, s in enumerate(line.steps[: line.position])]
    own = spark.createDataFrame(done, "generation int, step int, source string, action string, details string")
    counts = rows_affected(line) if counted else spark.createDataFrame([], "step int, rows_affected long")
    told = own.join(counts, "step", "left").withColumn("checkpointed_at", F.current_timestamp())
    write_snapshot(line.current(), f"{path}/table")
    names = [c.split()[0] for c in LINEAGE.split(", ")]
    earlier.select(names).unionByName(told.select(names)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/lineage")
    return Timeline(read(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a checkpoint."""
    return spark.read.parquet(f"{path}/table")


def lineage(spark: SparkSession, path: str) -> DataFrame:
    """The commands that made a checkpoint, its parents' first: generation, step, source, action, details, rows_affected, checkpointed_at."""
    return spark.read.schema(LINEAGE).json(f"{path}/lineage").orderBy("generation", "step")
