"""Column profiles from states that can be kept for each file and merged later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .commands import require
from .ids import user_columns

#: Log of the buckets of a distinct count (its error is about 1 %), and values that are watched for the commonest.
BUCKETS, WATCHED = 14, 1000
#: Columns whose states are made in one pass; wider tables take one more for each so many.
TOGETHER = 64
#: All texts that a cast takes for a double.  The others are kept from it, as it throws an exception inside for each.
NUMERAL = r"^[\x00-\x20]*+[+-]?(?:(?:[0-9]++(?:[.][0-9]*+)?|[.][0-9]++)(?:[eE][+-]?[0-9]++)?[dDfF]?|0[xX][0-9a-fA-F.]++[pP][+-]?[0-9]++[dDfF]?|(?i:nan|inf|infinity))[\x00-\x20]*$"


def _number(df: DataFrame, name: str, value: Column) -> Column:
    """The number that a cell's text is, or null."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)):
        return F.col(f"`{name}`").cast("double")
    if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    return F.when(value.rlike(NUMERAL), value.try_cast("double"))


def states(df: DataFrame, columns: list[str] | None = None, part: str | None = None) -> DataFrame:
    """One row for each column, and each value of ``part`` where it is given: counts and sketches of its values.

    Columns: column_name, part, n_rows, n_nulls, n_blank, least, greatest, number_sum, n_numbers,
    distinct_state, quantile_state, common_state.  Each column is read once, rows are aggregated where they are
    read, and no row is made for a cell; states have a fixed size at most, however many rows they are of.
    ``part`` may be a column such as the file's name, so that a file that changes is looked at alone.
    """
    names = columns or [c for c in user_columns(df) if c != part]
    require(df, *names)
    return reduce(DataFrame.unionByName, [_states(df, names[k : k + TOGETHER], part) for k in range(0, len(names), TOGETHER)])


def _states(df: DataFrame, names: list[str], part: str | None) -> DataFrame:
    where = (F.col(f"`{part}`").cast("string") if part else F.lit(None).cast("string")).alias("part")
    cells = df.select(where, F.spark_partition_id().alias("task"), *[x for k, c in enumerate(names) for x in (F.col(f"`{c}`").cast("string").alias(f"value{k}"), _number(df, c, F.col(f"`{c}`").cast("string")).alias(f"number{k}"))])
    kept = []
    for k, c in enumerate(names):
        value, number = F.col(f"value{k}"), F.col(f"number{k}")
        sound = F.when(~F.isnan(number), number)
        kept.append(F.struct(
            F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(value.isNull()).alias("n_nulls"), F.count_if(text.is_blank(value) & value.isNotNull()).alias("n_blank"),
            F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(sound).alias("number_sum"), F.count(sound).alias("n_numbers"),
            F.hll_sketch_agg(value, F.lit(BUCKETS)).alias("distinct_state"), F.kll_sketch_agg_double(sound).alias("quantile_state"), F.expr(f"approx_top_k_accumulate(value{k}, {WATCHED})").alias("common_state"),
        ))
    # a row for each task and part, so that the states of a column meet by themselves, those of different columns in different tasks
    found = cells.groupBy("part", "task").agg(F.array(*kept).alias("kept")).select("part", F.inline("kept"))
    return _merged(found, "column_name", "part")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, exact): how many different values each column has, nulls left out; each column is read and counted by itself."""
    names = columns or user_columns(df)
    require(df, *names)
    counts = [df.select(F.col(f"`{c}`").alias("value")).where(F.col("value").isNotNull()).distinct().agg(F.lit(c).alias("column_name"), F.count("*").alias("exact")) for c in names]
    return reduce(DataFrame.unionByName, counts)


def _merged(kept: DataFrame, *keys: str) -> DataFrame:
    return kept.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_nulls", "n_blank")], F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("number_sum").alias("number_sum"), F.sum("n_numbers").alias("n_numbers"),
        F.hll_union_agg("distinct_state").alias("distinct_state"), F.kll_merge_agg_double("quantile_state").alias("quantile_state"), F.expr(f"approx_top_k_combine(common_state, {WATCHED})").alias("common_state"),
    )


def merged(kept: DataFrame) -> DataFrame:
    """States of :func:`states` of several parts or tables as one row for each column, still to be merged with others."""
    found = _merged(kept, "column_name")
    return found.select("column_name", F.lit(None).cast("string").alias("part"), *found.columns[1:])


def profile(kept: DataFrame, common: int = 10) -> DataFrame:
    """What states say of each column: counts, least and greatest text, mean, quartiles, different values and the commonest ones.

    Quartiles and different values are estimates, the former null without numbers; the commonest
    values are exact where a column has no more different ones than are watched.
    """
    kept = merged(kept)
    numbers = F.col("n_numbers") > 0
    quantile = lambda q: F.when(numbers, F.kll_sketch_get_quantile_double(F.col("quantile_state"), F.lit(q)))
    return kept.select(
        "column_name", "n_rows", "n_nulls", "n_blank", F.hll_sketch_estimate("distinct_state").alias("n_distinct"), "least", "greatest",
        F.when(numbers, F.col("number_sum") / F.col("n_numbers")).alias("mean"), quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"),
        F.expr(f"approx_top_k_estimate(common_state, {common})").alias("common"),
    )
