"""Differences of two tables: by keys, or by row identity of two states of one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commands import CommandError
from .ids import ORIGIN_ID, ROW_ID, user_columns

_FAMILIES = ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType), (T.StringType, T.VarcharType, T.CharType))
FAR = 1_000_000_000


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether values compare as they are; other kinds compare as text."""
    return a == b or any(isinstance(a, f) and isinstance(b, f) for f in _FAMILIES)


@dataclass(frozen=True)
class Diff:
    """``rows`` has a_ and b_ columns of all shared and own columns, ids and diff_status."""

    rows: DataFrame
    keys: list[str]
    shared: list[str]
    new_columns: list[str]  # in a, not in b
    removed_columns: list[str]  # in b, not in a

    def changed(self) -> DataFrame:
        return self.rows.where("diff_status != 'unchanged'")

    def narrow(self) -> DataFrame:
        """Ids and statuses without values."""
        return self.rows.select("row_id", "a_row_id", "b_row_id", "a_origin_id", "b_origin_id", "b_row_num", "sort_key", "diff_status")

    def summary(self) -> DataFrame:
        return self.rows.groupBy("diff_status").count()

    def page(self, size: int = 500, offset: int = 0, after: int | None = None) -> DataFrame:
        rows = self.changed() if after is None else self.changed().where(F.col("sort_key") > after)
        return rows.orderBy("sort_key", "row_id").offset(offset).limit(size)

    def modified_in(self, column: str) -> DataFrame:
        return self.rows.where((F.col("diff_status") == "modified") & ~F.col(f"a_{column}").cast("string").eqNullSafe(F.col(f"b_{column}").cast("string")))

    def with_modified_columns(self) -> DataFrame:
        """``modified_columns`` of each row: shared columns whose texts differ, a null like an empty one."""
        names = [F.when(F.coalesce(F.col(f"a_{c}").cast("string"), F.lit("")) != F.coalesce(F.col(f"b_{c}").cast("string"), F.lit("")), F.lit(c)) for c in self.shared if c not in self.keys]
        found = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
        return self.rows.withColumn("modified_columns", F.when(F.col("diff_status") == "modified", found).otherwise(F.array().cast("array<string>")))


def _same(a: Column, b: Column, kinds: tuple[T.DataType, T.DataType]) -> Column:
    return a == b if comparable(*kinds) else a.cast("string") == b.cast("string")


def diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> Diff:
    """Full outer join on ``keys``, or without keys on the rows' origin or row ids.

    A key that is null matches nothing: its row is added or removed.  Columns of one
    table alone make a row modified where they hold a value.
    """
    own, other = user_columns(a), user_columns(b)
    keys = list(keys or [])
    for k in keys:
        if k in (ROW_ID, ORIGIN_ID):
            raise CommandError("INTERNAL_KEY", f"{k} is internal")
        if k not in own or k not in other:
            raise CommandError("KEY_NOT_FOUND", f"no key {k} in both tables")
    if not keys:
        on = ORIGIN_ID if ORIGIN_ID in a.columns and ORIGIN_ID in b.columns and not a.join(b, ORIGIN_ID, "left_semi").isEmpty() else ROW_ID
        if on not in a.columns or on not in b.columns:
            raise CommandError("NO_KEY", "tables without row ids need keys")
    shared = [c for c in own if c in other]
    new, removed = [c for c in own if c not in other], [c for c in other if c not in own]

    def side(df: DataFrame, p: str, columns: list[str]) -> DataFrame:
        ids = [(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(n) for c, t, n in ((ROW_ID, "long", f"{p}_row_id"), (ORIGIN_ID, "string", f"{p}_origin_id"))]
        return df.select(*[F.col(c).alias(f"{p}_{c}") for c in columns], *ids, F.lit(True).alias(f"_{p}"))

    x, y = side(a, "a", own), side(b, "b", other)
    if keys:
        tests = [_same(F.col(f"a_{k}"), F.col(f"b_{k}"), (a.schema[k].dataType, b.schema[k].dataType)) for k in keys]
    else:
        tests = [F.col("a_origin_id") == F.col("b_origin_id") if on == ORIGIN_ID else F.col("a_row_id") == F.col("b_row_id")]
    cond = tests[0]
    for t in tests[1:]:
        cond = cond & t
    joined = x.join(y, cond, "full_outer")
    changed = F.lit(False)
    for c in shared:
        if c in keys:
            continue
        kinds = (a.schema[c].dataType, b.schema[c].dataType)
        changed = changed | (~F.col(f"a_{c}").cast("string").eqNullSafe(F.col(f"b_{c}").cast("string")) if comparable(*kinds) else F.lit(True))
    for c in new:
        changed = changed | F.col(f"a_{c}").isNotNull()
    for c in removed:
        changed = changed | F.col(f"b_{c}").isNotNull()
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(changed, "modified").otherwise("unchanged")
    number = F.floor(F.col("b_row_id") / 100)
    rows = joined.select(
        F.coalesce("b_row_id", "a_row_id").alias("row_id"), "a_row_id", "b_row_id", "a_origin_id", "b_origin_id",
        number.alias("b_row_num"), F.coalesce(number, F.floor(F.col("a_row_id") / 100) + FAR).alias("sort_key"), status.alias("diff_status"),
        *[f"a_{c}" for c in own], *[f"b_{c}" for c in other],
    )
    return Diff(rows, keys, shared, new, removed)


def highlight(df: DataFrame, changed: Column) -> DataFrame:
    return df.withColumn("_highlight", F.when(changed, 1).otherwise(0))


def export_rows(d: Diff, unchanged: bool = False) -> DataFrame:
    """Status and values for a CSV: the new value, or the old one of a removed row."""
    return _exported(d, d.rows if unchanged else d.changed())


def export_values(d: Diff) -> list[Column]:
    """Status and values as texts: the new value, or the old one of a removed row."""
    columns = d.shared + d.new_columns + d.removed_columns
    value = {c: F.coalesce(*[F.col(f"{p}_{c}").cast("string") for p in ("b", "a") if f"{p}_{c}" in d.rows.columns]).alias(c) for c in columns}
    return [F.col("diff_status").alias("Status"), *value.values()]


def _exported(d: Diff, rows: DataFrame) -> DataFrame:
    return rows.select(*export_values(d))


def json_row(d: Diff) -> Column:
    """A row with its modified columns as JSON: status, both sides, and modified columns."""
    sides = [F.struct(*[F.col(f"{p}_{c}").alias(c) for c in d.shared + extra]).alias(n) for p, n, extra in (("a", "rowA", d.new_columns), ("b", "rowB", d.removed_columns))]
    return F.to_json(F.struct(F.col("diff_status").alias("status"), *sides, F.col("modified_columns").alias("modifiedColumns")))


def export_json(d: Diff) -> DataFrame:
    """One JSON text a changed row: status, both sides, and modified columns."""
    rows = d.with_modified_columns().where("diff_status != 'unchanged'")
    return rows.select(json_row(d).alias("json"))


def export_report(d: Diff) -> dict:
    """What a JSON file of a diff begins with: meta and summary; the rows follow from :func:`export_json`."""
    counts = {r["diff_status"]: r["count"] for r in d.summary().collect()}
    names = ("added", "removed", "modified", "unchanged")
    return {"meta": {"keyColumns": d.keys, "newColumns": d.new_columns, "removedColumns": d.removed_columns}, "summary": {n: counts.get(n, 0) for n in names}}


def clipboard(d: Diff, size: int = 100) -> DataFrame:
    """The first changed rows in the order of the pages."""
    return _exported(d, d.page(size))
