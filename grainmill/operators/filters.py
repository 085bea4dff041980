"""View filters, sorting and paging; nothing here changes a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ids import ROW_ID, fresh, numbered, user_columns

OPERATORS = {
    "text": ("contains", "equals", "starts_with", "ends_with", "is_empty", "is_not_empty"),
    "numeric": ("eq", "gt", "lt", "gte", "lte", "between", "is_empty", "is_not_empty"),
    "date": ("date_eq", "date_before", "date_after", "date_between", "last_n_days", "is_empty", "is_not_empty"),
    "boolean": ("is_true", "is_false", "is_empty", "is_not_empty"),
    "unknown": ("contains", "equals", "is_empty", "is_not_empty"),
}


def category(kind: T.DataType) -> str:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return "text"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "date"
    return "boolean" if isinstance(kind, T.BooleanType) else "unknown"


def condition(column: str, operator: str, value=None, value2=None, today: Column | None = None) -> Column:
    c = F.col(f"`{column}`")
    s = c.cast("string")
    low = F.lower(s)
    day = c.try_cast("date")
    if operator == "is_empty":
        return c.isNull() | (s == "")
    if operator == "is_not_empty":
        return c.isNotNull() & (s != "")
    if operator in ("is_true", "is_false"):
        return c == (operator == "is_true")
    if value is None:
        return F.lit(True)
    if operator == "contains":
        return low.contains(str(value).lower())
    if operator == "equals":
        return s.ilike(str(value).replace("\\", "\\\\"))
    if operator == "starts_with":
        return low.startswith(str(value).lower())
    if operator == "ends_with":
        return low.endswith(str(value).lower())
    if operator in ("eq", "gt", "lt", "gte", "lte"):
        n = float(value)
        return {"eq": c == n, "gt": c > n, "lt": c < n, "gte": c >= n, "lte": c <= n}[operator]
    if operator == "between":
        return c.between(float(value), float(value2))
    if operator == "last_n_days":
        return day >= F.date_sub(F.current_date() if today is None else today, int(value))
    if operator.startswith("date_"):
        a = F.lit(str(value)).cast("date")
        if operator == "date_between":
            return day.between(a, F.lit(str(value2)).cast("date"))
        return {"date_eq": day == a, "date_before": day < a, "date_after": day > a}[operator]
    return s.ilike(str(value).replace("\\", "\\\\"))


def where(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that meet all filters ``{column, operator, value, value2}``; none: all rows."""
    for f in filters:
        df = df.where(condition(f["column"], f["operator"], f.get("value"), f.get("value2")))
    return df


def describe(f: dict) -> str:
    value = "" if f.get("value") is None else f" {f['value']}"
    return f"{f['column']} {f['operator'].replace('_', ' ')}{value}" + (f" and {f['value2']}" if f.get("value2") is not None else "")


def sort(df: DataFrame, column: str | None = None, descending: bool = False) -> DataFrame:
    tie = [ROW_ID] if ROW_ID in df.columns else []
    if column is None:
        return df.orderBy(*tie) if tie else df
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last(), *tie)


def page(df: DataFrame, offset: int, size: int) -> DataFrame:
    return sort(df).offset(offset).limit(size)


def keyset_page(df: DataFrame, size: int, cursor: int | None = None, backward: bool = False, filters: list[dict] | None = None) -> DataFrame:
    """The ``size`` rows after (or before) a row id and one more, which tells that there are more."""
    df = where(df, filters or [])
    if cursor is not None:
        df = df.where(F.col(ROW_ID) < cursor if backward else F.col(ROW_ID) > cursor)
    return df.orderBy(F.col(ROW_ID).desc() if backward else F.col(ROW_ID)).limit(size + 1)


#: Rows of a page that one task puts in order; larger pages are numbered over ranges.
PAGE = 10_000


def cursor_of(row, column: str) -> tuple:
    """Where a row stands under a sort by ``column``: (whether it is null, the value, the row id)."""
    return row[column] is None, row[column], row[ROW_ID]


def sorted_page(df: DataFrame, size: int, column: str, descending: bool = False, cursor: tuple | None = None, backward: bool = False, filters: list[dict] | None = None) -> DataFrame:
    """The ``size`` rows after (or before) a cursor of :func:`cursor_of` under a sort by ``column`` then row id, and one more, which tells that there are more.

    The order is that of :func:`sort`, nulls last either way; equal values go by row id.
    Pages backward come in reverse order, the row nearest to the cursor first.  Only rows on
    that side of the cursor are kept, and of these the first ones of each partition are compared, or
    where a page has more than ``PAGE`` rows, all of them are put in order by ranges and numbered.
    """
    return _first(*_beyond(df, column, descending, cursor, backward, filters), size + 1)[0]


def page_and_cursor(df: DataFrame, size: int, column: str, descending: bool = False, cursor: tuple | None = None, backward: bool = False, filters: list[dict] | None = None) -> tuple[DataFrame, tuple | None]:
    """The ``size`` rows of :func:`sorted_page` and the cursor of the last of them, None where the page is not full."""
    rows, at = _first(*_beyond(df, column, descending, cursor, backward, filters), size)
    last = at(size).select(column, ROW_ID).first()
    return rows, last and cursor_of(last, column)


def _first(df: DataFrame, order: list[Column], n: int):
    """The first ``n`` rows, in order, and a function that gives the row at a place."""
    if n <= PAGE + 1:
        rows = df.orderBy(*order).limit(n)
        return rows, lambda i: df.orderBy(*order).offset(i - 1).limit(1)
    place = fresh("_place", df)
    placed = numbered(df, place, order)
    return placed.where(F.col(place) <= n).orderBy(place).drop(place), lambda i: placed.where(F.col(place) == i)


def _beyond(df: DataFrame, column: str, descending: bool, cursor: tuple | None, backward: bool, filters: list[dict] | None) -> tuple[DataFrame, list[Column]]:
    """The rows after (or before) a cursor, and the order of their pages."""
    df = where(df, filters or [])
    c, row = F.col(f"`{column}`"), F.col(ROW_ID)
    if cursor is not None:
        empty, value, at = cursor
        further = row < at if backward else row > at
        if empty:
            keep = c.isNotNull() | (c.isNull() & further) if backward else c.isNull() & further
        else:
            value = F.lit(value).cast(df.schema[column].dataType)
            beyond = c > value if descending == backward else c < value
            keep = beyond | ((c == value) & further)
            keep = keep if backward else keep | c.isNull()
        df = df.where(keep)
    if backward:
        order = [c.asc_nulls_first() if descending else c.desc_nulls_first(), row.desc()]
    else:
        order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), row.asc()]
    return df, order


def arrow_page(df: DataFrame, size: int, cursor: int | None = None, backward: bool = False, filters: list[dict] | None = None) -> pa.Table:
    """A :func:`keyset_page` as an Arrow table."""
    return keyset_page(df, size, cursor, backward, filters).toArrow()


def row_at(df: DataFrame, index: int) -> int | None:
    found = df.select(ROW_ID).orderBy(ROW_ID).offset(index).limit(1).first()
    return found and found[0]


def count(df: DataFrame, filters: list[dict]) -> int:
    return where(df, filters).count()


def project(df: DataFrame) -> DataFrame:
    return df.select(*user_columns(df))


def cluster_records(df: DataFrame, column: str, values: list[str], master: str, size: int = 100) -> DataFrame:
    """Rows of a cluster's values, those of the master last."""
    return df.where(F.col(column).isin(values)).orderBy((F.col(column) == master), column, *([ROW_ID] if ROW_ID in df.columns else [])).limit(size)
