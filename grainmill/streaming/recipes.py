"""Recipes on streams: steps that work row by row run unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..operators.commands import CommandError
from ..plans.recipe import Recipe, is_streamable, run


def run_stream(stream: DataFrame, recipe: Recipe, secret: str | None = None) -> DataFrame:
    if not is_streamable(recipe):
        raise CommandError("NOT_STREAMABLE", "a step needs the whole table")
    return run(stream, recipe, secret)


def drop_duplicates(stream: DataFrame, time: str, delay: str, columns: list[str]) -> DataFrame:
    """The first of equal rows that come within ``delay`` of each other; state is bounded by the watermark.

    A time without a zone becomes a timestamp in the session's zone, as watermarks take no other.
    """
    if isinstance(stream.schema[time].dataType, TimestampNTZType):
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(columns)
