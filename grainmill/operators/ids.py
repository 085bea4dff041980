"""Row ids, user columns and column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

ROW_ID = "_cs_id"
ORIGIN_ID = "_cs_origin_id"
GAP = 100


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, ORIGIN_ID) and not c.endswith("__base") and not c.startswith("duckdb_")]


def fresh(stem: str, *tables: DataFrame) -> str:
    """A column name like ``stem`` that no table has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read from there ever after."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: both sides are shuffled, none is broadcast.

    Spark takes a table for as large as its files, and neither compression nor what an
    explode makes of it counts, so a table that the driver can't hold may look small.
    """
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`stored` that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, order_by: list[str | Column] | None = None) -> DataFrame:
    """``df`` with its rows' numbers from 1 on, in the present order, or in that of ``order_by`` by ranges.

    The rows are written once with the partition and the place in which they came, after
    the range shuffle where there is an order.  Counts and numbers both come from those
    files, so neither another sample of range bounds nor other partitions of a second
    run can lose a row or give a number twice.  Equal rows of an order follow each other
    in any order, and names go upwards, nulls last; columns of nulls only (``void``) come back as such.
    """
    if order_by:
        keys = [c if isinstance(c, Column) else F.col(f"`{c}`").asc_nulls_last() for c in order_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at, part, count, before = (fresh(x, df) for x in ("_at", "_part", "_rows", "_before"))
    empty = [c for c, kind in df.dtypes if kind == "void"]  # no file format holds these
    kept = stored(df.drop(*empty).withColumn(at, F.monotonically_increasing_id()))  # the partition, and 33 bits for the place in it
    counts = kept.groupBy(F.shiftrightunsigned(at, 33).alias(part)).agg(F.count("*").alias(count))
    offsets = counts.select(part, (F.sum(count).over(Window.orderBy(part)) - F.col(count)).alias(before))
    joined = kept.join(F.broadcast(offsets), F.shiftrightunsigned(at, 33) == F.col(part), "left")  # a row for each partition
    known = F.coalesce(before, F.raise_error(F.lit("a row's partition was not counted")).cast("long"))
    number = known + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return joined.select(*[F.lit(None).alias(c) if c in empty else F.col(f"`{c}`") for c in df.columns], number.alias(name))


def with_ids(df: DataFrame, order_by: list[str] | None = None, source: str = "table") -> DataFrame:
    """Dense row ids a gap apart, and a stable origin id; see :func:`numbered` for the order."""
    base = df.drop(ORIGIN_ID) if order_by and ROW_ID in order_by else df.drop(ROW_ID, ORIGIN_ID)
    n = fresh("_n", base)
    row = F.col(n) * GAP
    origin = F.sha2(F.concat_ws(":", F.lit(source), row.cast("string")), 256).substr(1, 32)
    return numbered(base, n, order_by).select(row.alias(ROW_ID), origin.alias(ORIGIN_ID), *[F.col(f"`{c}`") for c in base.columns if c != ROW_ID])


def duplicate(df: DataFrame, keep_ids: bool = True) -> DataFrame:
    """A copy of a table: with its row and origin ids, or with new ones in the order of the old."""
    return df if keep_ids else with_ids(df, [ROW_ID], "copy")


def renumber(df: DataFrame) -> DataFrame:
    """Ids with whole gaps again, in the order of the present ones."""
    return with_ids(df, [ROW_ID]).drop(ORIGIN_ID)


def insert_id(df: DataFrame, after: int | None = None, at_end: bool = False) -> int:
    """Id of a new row: half the least at the start, the midpoint after a row, a gap beyond the last."""
    if at_end or after is None:
        edge = df.agg(F.min(ROW_ID).alias("lo"), F.max(ROW_ID).alias("hi")).first()
        if edge["lo"] is None:
            return GAP
        return edge["hi"] + GAP if at_end else edge["lo"] // 2
    following = df.where(F.col(ROW_ID) > after).agg(F.min(ROW_ID)).first()[0]
    if following is None:
        return after + GAP
    return (after + following) // 2 if following - after > 1 else after + 1


def rebalance(df: DataFrame, center: int, reach: int = 500) -> DataFrame:
    """Ids of the rows around ``center`` spaced out again, the others shifted behind them."""
    near = df.where(F.abs(F.col(ROW_ID) - center) <= reach * GAP).select(ROW_ID)
    lowest = near.agg(F.min(ROW_ID)).first()[0]
    placed = near.withColumn("_new", F.lit(lowest) + (F.row_number().over(Window.orderBy(ROW_ID)) - 1) * GAP)
    top = placed.agg(F.max(ROW_ID).alias("old"), F.max("_new").alias("new")).first()
    shift = max(0, top["new"] - top["old"])
    joined = df.join(placed, ROW_ID, "left")
    moved = F.coalesce("_new", F.when(F.col(ROW_ID) > top["old"], F.col(ROW_ID) + shift).otherwise(F.col(ROW_ID)))
    return joined.select(*[moved.alias(c) if c == ROW_ID else F.col(c) for c in df.columns])


def reorder(df: DataFrame, order: list[str]) -> DataFrame:
    """Columns in ``order``, the others after them."""
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])
