"""Commands by name: pure functions of a DataFrame and parameters."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, privacy, text
from ..functions.formula import FormulaError, columns_of, compile_formula, parse
from .ids import ORIGIN_ID, ROW_ID, insert_id, user_columns

CAST_TARGETS = {"VARCHAR": "string", "INTEGER": "int", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


class CommandError(ValueError):
    """A command that can't be applied; ``code`` says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class Command:
    """``apply(df, **params)``; stateless ones work row by row and so on streams too."""

    name: str
    apply: Callable[..., DataFrame]
    stateless: bool = True
    in_recipes: bool = True


REGISTRY: dict[str, Command] = {}


def command(name: str, stateless: bool = True, in_recipes: bool = True):
    def add(function):
        REGISTRY[name] = Command(name, function, stateless, in_recipes)
        return function

    return add


def apply(df: DataFrame, name: str, **params) -> DataFrame:
    if name not in REGISTRY:
        raise CommandError("UNKNOWN_COMMAND", f"unknown command: {name}")
    return REGISTRY[name].apply(df, **params)


def require(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise CommandError("COLUMN_NOT_FOUND", f"no column {c}")


def put(df: DataFrame, column: str, expr: Column) -> DataFrame:
    """``expr`` in place of a column."""
    require(df, column)
    return df.select(*[expr.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def _simple(name: str, function: Callable[..., Column]) -> None:
    @command(name)
    def run(df: DataFrame, column: str, **params) -> DataFrame:
        return put(df, column, function(F.col(f"`{column}`"), **params))


_simple("trim", lambda c: F.trim(text.text(c)))
_simple("lowercase", lambda c: F.lower(text.text(c)))
_simple("uppercase", lambda c: F.upper(text.text(c)))
_simple("title_case", text.title_case)
_simple("sentence_case", text.sentence_case)
_simple("remove_accents", text.remove_accents)
_simple("collapse_spaces", text.collapse_spaces)
_simple("remove_non_printable", text.remove_non_printable)
_simple("replace", text.replace)
_simple("replace_empty", text.replace_empty)
_simple("pad_zeros", text.pad_zeros)
_simple("unformat_currency", text.unformat_currency)
_simple("fix_negatives", text.fix_negatives)
_simple("hash", privacy.hashed)
_simple("mask", privacy.mask)
_simple("redact", privacy.redact)
_simple("last4", privacy.last4)
_simple("zero", privacy.zero)
_simple("scramble", privacy.scramble)


@command("year_only")
def year_only(df: DataFrame, column: str) -> DataFrame:
    """The column moves to the end, as the single command has it; a batch keeps its place."""
    require(df, column)
    return df.select(*[c for c in df.columns if c != column], privacy.year_only(F.col(column)).alias(column))


@command("scrub_batch")
def scrub_batch(df: DataFrame, rules: list[dict], secret: str | None = None) -> DataFrame:
    return privacy.scrub(df, rules, secret)


@command("rename_column")
def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    require(df, column)
    if not new_name.strip():
        raise CommandError("EMPTY_NAME")
    if new_name == column:
        raise CommandError("SAME_NAME")
    if new_name in df.columns:
        raise CommandError("COLUMN_EXISTS")
    return df.withColumnRenamed(column, new_name)


@command("remove_duplicates", stateless=False)
def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal user columns: that with the least row id."""
    keys = user_columns(df)
    if ROW_ID not in df.columns:
        return df.dropDuplicates(keys)
    hidden = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*hidden), F.col(ROW_ID)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in hidden else F.col(c) for c in df.columns])


@command("cast_type", stateless=False)
def cast_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """Null where a value does not fit; integers round, dates go by epoch or the formats."""
    require(df, column)
    if target not in CAST_TARGETS:
        raise CommandError("BAD_TYPE", f"unknown type: {target}")
    return put(df, column, cast_column(F.col(column), target, dates.detect_epoch(df, column) if target in ("DATE", "TIMESTAMP") else None))


def cast_column(c: Column, target: str, unit: str | None = None) -> Column:
    if target == "INTEGER":
        return F.round(c.cast("string").try_cast("double")).try_cast("int")
    if target == "DATE":
        return dates.parse_date(c, unit)
    if target == "TIMESTAMP":
        return dates.from_epoch(c, unit).cast("timestamp_ntz") if unit else F.coalesce(c.cast("string").try_cast("timestamp_ntz"), dates.parse_text(c).cast("timestamp_ntz"))
    return c.cast("string").try_cast(CAST_TARGETS[target])


@command("split_column", stateless=False)
def split_column(df: DataFrame, column: str, mode: str = "delimiter", delimiter: str = " ", position: int = 3, length: int = 2) -> DataFrame:
    """New columns ``column_1`` and on; at most 10 by delimiter, 2 by position, 50 by length."""
    require(df, column)
    s = F.col(f"`{column}`").cast("string")
    prefix = f"{column}_split" if any(c.startswith(f"{column}_1") for c in df.columns) else column
    if mode == "delimiter":
        parts = F.split(s, text.quote_pattern(delimiter), -1)
        n = min(df.agg(F.max(F.size(parts))).first()[0] or 2, 10)
        new = [F.get(parts, F.lit(i)) for i in range(max(n, 0))]
    elif mode == "position":
        new = [F.substring(s, 1, position), F.substring(s, position + 1, 2**31 - 1)]
    elif mode == "length":
        longest = df.agg(F.max(F.length(s))).first()[0] or 0
        new = [F.substring(s, i * length + 1, length) for i in range(min(-(-longest // length), 50))]
    else:
        raise CommandError("BAD_MODE", f"unknown mode: {mode}")
    return df.select("*", *[c.alias(f"{prefix}_{i + 1}") for i, c in enumerate(new)])


@command("combine_columns")
def combine_columns(df: DataFrame, columns: list[str] | str, delimiter: str = "", new_name: str = "combined", ignore_empty: bool = True) -> DataFrame:
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    require(df, *names)
    if len(names) < 2:
        raise CommandError("TOO_FEW_COLUMNS")
    values = [F.col(c).cast("string") for c in names]
    if ignore_empty:
        values = [F.nullif(F.trim(v), F.lit("")) for v in values]
    return df.withColumn(new_name, F.concat_ws(delimiter, *values))


@command("fill_down", stateless=False)
def fill_down(df: DataFrame, column: str, order: str = ROW_ID, bucket: int = 1_000_000) -> DataFrame:
    """Blanks take the last value above them, by ``order`` (an increasing number).

    Rows are filled within buckets of ``bucket`` order values; the last value of each
    bucket is carried on over the buckets alone, one row each.
    """
    require(df, column, order)
    value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    # a row without an order has no row above it and is left as it is
    marked = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / bucket).cast("long"))
    last = marked.where("_b is not null").groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
    carry = last.select("_b", F.last("_last", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    filled = marked.join(carry, "_b", "left").withColumn("_f", F.coalesce("_v", F.when(F.col("_b").isNotNull(), F.coalesce(inside, "_carry"))))
    return filled.select(*[F.col("_f").alias(c) if c == column else F.col(c) for c in df.columns])


@command("standardize_date", stateless=False)
def standardize_date(df: DataFrame, column: str, format: str = "YYYY-MM-DD") -> DataFrame:
    require(df, column)
    if format not in dates.OUTPUT:
        raise CommandError("BAD_FORMAT")
    return put(df, column, F.date_format(dates.parse_date(F.col(column), dates.detect_epoch(df, column)), dates.OUTPUT[format]))


@command("calculate_age", stateless=False)
def calculate_age(df: DataFrame, column: str, new_name: str = "age", precision: str = "years", on: str | None = None) -> DataFrame:
    require(df, column)
    day = F.lit(on).cast("date") if on else None
    return df.withColumn(new_name, dates.age(F.col(column), day, precision, dates.detect_epoch(df, column)))


FORBIDDEN = ("drop database", "drop schema", "truncate", "create database")


@command("custom_sql", stateless=False, in_recipes=False)
def custom_sql(df: DataFrame, sql: str, table: str = "input") -> DataFrame:
    """A SELECT, or the body of CREATE TABLE … AS, over the table as a temporary view."""
    low = sql.lower()
    if any(x in low for x in FORBIDDEN):
        raise CommandError("FORBIDDEN_SQL")
    body = re.sub(r"(?is)^\s*create\s+(or\s+replace\s+)?table\s+\S+\s+as\s+", "", sql).strip().rstrip(";")
    if not re.match(r"(?is)^(select|with|values)\b", body):
        raise CommandError("NOT_A_QUERY", "only SELECT and CREATE TABLE AS are supported")
    df.createOrReplaceTempView(table)
    return df.sparkSession.sql(body)


@command("excel_formula")
def excel_formula(df: DataFrame, formula: str, output: str = "new", output_column: str | None = None, target_column: str | None = None) -> DataFrame:
    if not formula.strip():
        raise CommandError("EMPTY_FORMULA")
    try:
        names = columns_of(parse(formula))
    except FormulaError as e:
        raise CommandError("INVALID_FORMULA", str(e)) from e
    if missing := [c for c in names if c not in df.columns]:
        raise CommandError("COLUMN_NOT_FOUND", f"no column {missing[0]}")
    try:
        expr = compile_formula(formula, df.columns)
    except FormulaError as e:
        raise CommandError("INVALID_FORMULA", str(e)) from e
    if output == "replace":
        if not target_column:
            raise CommandError("MISSING_TARGET_COLUMN")
        return put(df, target_column, expr)
    if not output_column:
        raise CommandError("MISSING_OUTPUT_COLUMN")
    if output_column in df.columns:
        raise CommandError("COLUMN_EXISTS")
    return df.withColumn(output_column, expr)


@command("add_column")
def add_column(df: DataFrame, column: str, type: str = "VARCHAR", after: str | None = "") -> DataFrame:
    """A column of nulls: at the end, after a column, or with ``after`` None first."""
    if column in df.columns:
        raise CommandError("COLUMN_EXISTS")
    new = F.lit(None).cast(CAST_TARGETS.get(type, type)).alias(column)
    if after:
        require(df, after)
    at = 0 if after is None else df.columns.index(after) + 1 if after else len(df.columns)
    return df.select(*df.columns[:at], new, *df.columns[at:])


@command("delete_column")
def delete_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    if column == ROW_ID:
        raise CommandError("PROTECTED_COLUMN")
    return df.drop(column)


@command("edit_cell", in_recipes=False)
def edit_cell(df: DataFrame, row_id: int, column: str, value) -> DataFrame:
    require(df, column)
    c = F.col(column)
    return put(df, column, F.when(F.col(ROW_ID) == row_id, F.lit(value).cast(df.schema[column].dataType)).otherwise(c))


@command("edit_batch", stateless=False, in_recipes=False)
def edit_batch(df: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(row_id, column, value)`` with text values; each pair once."""
    names = [r["column"] for r in changes.select("column").distinct().collect()]
    require(df, *names)
    wide = changes.groupBy("row_id").agg(*[F.max_by(F.struct(F.lit(True).alias("set"), "value"), F.lit(1)).alias(f"_{c}") if len(names) == 1 else F.first(F.when(F.col("column") == c, F.struct(F.lit(True).alias("set"), "value")), ignorenulls=True).alias(f"_{c}") for c in names])
    joined = df.join(wide, df[ROW_ID] == wide["row_id"], "left")
    return joined.select(*[F.when(F.col(f"_{c}.set"), F.col(f"_{c}.value").try_cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


@command("insert_row", stateless=False, in_recipes=False)
def insert_row(df: DataFrame, after: int | None = None, at_end: bool = False, forced_id: int | None = None) -> DataFrame:
    """An empty row: at the start, after a row id, or at the end."""
    new = forced_id if forced_id is not None else insert_id(df, after, at_end)
    row = df.sparkSession.range(1).select(*[F.lit(new).cast("long").alias(c) if c == ROW_ID else (F.sha2(F.lit(f"insert:{new}"), 256).substr(1, 32) if c == ORIGIN_ID else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns])
    return df.unionByName(row)


@command("delete_row", stateless=False, in_recipes=False)
def delete_row(df: DataFrame, row_ids: list[int]) -> DataFrame:
    if not row_ids:
        raise CommandError("NO_ROWS_SELECTED")
    ids = df.sparkSession.createDataFrame([(int(i),) for i in row_ids], f"{ROW_ID} long")
    if df.join(F.broadcast(ids), ROW_ID, "left_semi").isEmpty():
        raise CommandError("ROWS_NOT_FOUND")
    return df.join(F.broadcast(ids), ROW_ID, "left_anti")
