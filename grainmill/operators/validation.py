"""Checks before a command, previews of it, and details of what it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from .commands import REGISTRY, CommandError, apply, cast_column, require
from .ids import ROW_ID, spread, user_columns

#: Texts that a cell of each type may hold, and the bits of whole numbers.
PATTERNS = {
    "INTEGER": r"^-?\d+$",
    "UINTEGER": r"^\d+$",
    "DOUBLE": r"^-?\d*\.?\d+([eE][+-]?\d+)?$",
    "DECIMAL": r"^-?\d*\.?\d+$",
    "BOOLEAN": r"(?i)^(true|false|1|0|yes|no|t|f|y|n)$",
    "DATE": r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4})$",
    "TIMESTAMP": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?)?$",
    "TIME": r"^\d{2}:\d{2}(:\d{2})?(\.\d+)?$",
}
RANGES = {"TINYINT": 7, "SMALLINT": 15, "INTEGER": 31, "BIGINT": 63}
UNSIGNED = {"UTINYINT": 8, "USMALLINT": 16, "UINTEGER": 32, "UBIGINT": 64}
SAME = {"HUGEINT": "INTEGER", "FLOAT": "DOUBLE", "REAL": "DOUBLE", "NUMERIC": "DECIMAL"}


def value_fits(column, kind: str):
    """Whether texts are values of a type, blanks around them left aside; nulls and empty ones always are.

    Parameters of a type do not matter, and a type without a pattern takes any text.
    """
    kind = kind.split("(")[0].strip().upper()
    s = F.trim(F.col(column).cast("string"))
    pattern = PATTERNS.get("INTEGER" if kind in RANGES else "UINTEGER" if kind in UNSIGNED else SAME.get(kind, kind))
    fits = s.rlike(pattern) if pattern else F.lit(True)
    if kind in RANGES or kind in UNSIGNED:
        n = s.try_cast("decimal(38,0)")
        low, high = (0, 2 ** UNSIGNED[kind] - 1) if kind in UNSIGNED else (-(2 ** RANGES[kind]), 2 ** RANGES[kind] - 1)
        fits = fits & n.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
    return s.isNull() | (s == "") | F.coalesce(fits, F.lit(False))


def _said(status: str, code: str, **figures) -> dict:
    return {"status": status, "code": code, **figures}


def validate(df: DataFrame, name: str, **p) -> dict:
    """{status, code, figures} of a command; those without a check are valid."""
    if name == "remove_duplicates":
        names = user_columns(df)
        if not names:
            return _said("invalid", "NO_COLUMNS")
        r = df.select(*names).groupBy(*names).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("kinds")).first()
        extra = (r["rows"] or 0) - r["kinds"]
        return _said("valid" if extra else "no_op", "HAS_DUPLICATES" if extra else "NO_DUPLICATES", duplicates=extra)
    if name in ("standardize_date", "calculate_age", "year_only"):
        c = F.col(p["column"])
        r = df.agg(F.count_if(~text.is_blank(c)).alias("total"), F.count_if(dates.parse_date(c, dates.detect_epoch(df, p["column"])).isNotNull()).alias("good")).first()
        if not r["total"]:
            return _said("no_op", "EMPTY_COLUMN")
        code = "NO_PARSEABLE_DATES" if not r["good"] else "ALL_PARSEABLE" if r["good"] == r["total"] else "PARTIAL_PARSE"
        return _said({"NO_PARSEABLE_DATES": "invalid", "PARTIAL_PARSE": "warning"}.get(code, "valid"), code, total=r["total"], parseable=r["good"])
    if name == "fill_down":
        r = df.agg(F.count("*").alias("n"), F.count_if(text.is_blank(F.col(p["column"]))).alias("blank")).first()
        code = "EMPTY_TABLE" if not r["n"] else "HAS_EMPTY_VALUES" if r["blank"] else "NO_EMPTY_VALUES"
        return _said("valid" if r["blank"] else "no_op", code, blank=r["blank"])
    if name == "replace":
        if not p.get("find"):
            return _said("invalid", "NO_FIND_VALUE")
        s = F.col(p["column"]).cast("string")
        sensitive = p.get("case_sensitive", True) not in (False, "false")
        a, b = (s, p["find"]) if sensitive else (F.lower(s), p["find"].lower())
        n = df.where(a == b if p.get("match") == "exact" else a.contains(b)).count()
        return _said("valid" if n else "no_op", "HAS_MATCHES" if n else "NO_MATCHES", matches=n)
    if name == "cast_type":
        c = F.col(p["column"])
        cast = cast_column(c, p["target"], dates.detect_epoch(df, p["column"]) if p["target"] in ("DATE", "TIMESTAMP") else None)
        r = df.agg(F.count(c).alias("total"), F.count(cast).alias("good")).first()
        if not r["total"]:
            return _said("no_op", "EMPTY_COLUMN")
        failed = r["total"] - r["good"]
        samples = [x[0] for x in df.where(c.isNotNull() & cast.isNull()).select(c.cast("string")).limit(5).collect()] if failed else []
        return _said("warning" if failed else "valid", "PARTIAL_CAST" if failed else "ALL_CASTABLE", total=r["total"], failed=failed, percent=100.0 * r["good"] / r["total"], samples=samples)
    return _said("valid", "NOT_CHECKED")


def changes(df: DataFrame, name: str, column: str, **params) -> DataFrame:
    """(row id, original, result) of the rows that a one-column command changes."""
    after = apply(df.withColumn("_was", F.col(column)), name, column=column, **params)
    ids = [ROW_ID] if ROW_ID in df.columns else []
    return after.select(*ids, F.col("_was").cast("string").alias("original"), F.col(column).cast("string").alias("result")).where(~F.col("original").eqNullSafe(F.col("result")))


#: Which values of its column a command touches; commands that compare before and after are not here.
TOUCHED = {
    "replace_empty": lambda c, p: c.isNull() | (F.trim(c) == ""),
    "fill_down": lambda c, p: c.isNull() | (F.trim(c) == ""),
    "split_column": lambda c, p: ~text.is_blank(c),
    "pad_zeros": lambda c, p: F.length(c) < p.get("length", 5),
    "unformat_currency": lambda c, p: c.rlike("[$,€£¥]") | (c.startswith("(") & c.endswith(")")),
    "fix_negatives": lambda c, p: F.trim(c).rlike(r"(?s)\(.*\)$"),
    "cast_type": lambda c, p: c.isNotNull(),
    "mask": lambda c, p: c != "",
    **{name: lambda c, p: c.isNotNull() for name in ("hash", "redact", "last4", "zero", "scramble", "year_only")},
}


#: Commands that change columns, or the rows of a table as a whole, so that no row of it is touched by itself.
WHOLE_TABLE = ("rename_column", "add_column", "delete_column", "remove_duplicates", "insert_row", "custom_sql", "excel_formula")


def affected(df: DataFrame, name: str, column: str | None = None, **params) -> DataFrame | None:
    """Row ids of the rows that a command touches, read from the table before it.

    Text commands touch the rows whose value they change, others those that
    ``TOUCHED`` tells, dates those that can be read.  None for commands of
    ``WHOLE_TABLE``, of which no row can be said.
    """
    if name not in REGISTRY:
        raise CommandError("UNKNOWN_COMMAND", f"unknown command: {name}")
    if name in WHOLE_TABLE:
        return None
    if column is not None:
        require(df, column)
    if name == "delete_row":
        found = F.col(ROW_ID).isin([int(i) for i in params["row_ids"]])
    elif name == "edit_batch":
        return df.join(params["changes"].select(F.col("row_id").alias(ROW_ID)).distinct(), ROW_ID, "left_semi").select(ROW_ID)
    elif name == "edit_cell":
        found = F.col(ROW_ID) == params["row_id"]
    elif name == "combine_columns":
        names = [c.strip() for c in params["columns"].split(",")] if isinstance(params["columns"], str) else params["columns"]
        require(df, *names)
        found = F.exists(F.array(*[~text.is_blank(F.col(f"`{c}`")) for c in names]), lambda x: x)
    elif name == "scrub_batch":
        found = F.exists(F.array(*[F.col(f"`{r['column']}`").isNotNull() for r in params["rules"]]), lambda x: x)
    elif name in ("calculate_age", "standardize_date"):
        found = dates.parse_date(F.col(f"`{column}`"), dates.detect_epoch(df, column)).isNotNull()
    elif name in TOUCHED:
        found = TOUCHED[name](F.col(f"`{column}`").cast("string"), params)
    else:
        return changes(df, name, column, **params).select(ROW_ID)
    return df.where(found).select(ROW_ID)


def highlighted(df: DataFrame, name: str, most: int = 1000, **params) -> DataFrame:
    """``df`` with ``_highlight`` 1 in the rows that a command touches, the first ``most`` of them by row id, else 0."""
    found = affected(df, name, **params)
    if found is None:
        return df.withColumn("_highlight", F.lit(0))
    first = found.orderBy(ROW_ID).limit(most).withColumn("_highlight", F.lit(1))
    return df.join(F.broadcast(first), ROW_ID, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_highlight", F.lit(0)).alias("_highlight"))


def preview_split(df: DataFrame, column: str, sample: int = 10, **params) -> DataFrame:
    """The first rows' value of a column and the parts that splitting it gives."""
    head = df.where(~text.is_blank(F.col(f"`{column}`"))).limit(sample)
    out = apply(head, "split_column", column=column, **params)
    parts = [c for c in out.columns if c not in df.columns]
    return out.select(F.col(f"`{column}`").cast("string").alias("original"), F.array(*[F.col(f"`{c}`") for c in parts]).alias("parts"))


def preview_combine(df: DataFrame, columns: list[str], sample: int = 10, **params) -> DataFrame:
    """The first rows' values of some columns and what combining them gives."""
    out = apply(df.limit(sample), "combine_columns", columns=columns, **{**params, "new_name": "_result"})
    return out.select(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]).alias("original"), F.col("_result").alias("result"))


def row_changes(before: DataFrame, after: DataFrame, entry: str) -> DataFrame:
    """(audit_entry_id, row_id, change, row) of rows that a command added or removed, with their values as JSON."""
    told = []
    for one, other, change in ((after, before, "added"), (before, after, "removed")):
        alone = one.join(spread(other.select(ROW_ID)), ROW_ID, "left_anti")
        told.append(alone.select(F.lit(entry).alias("audit_entry_id"), F.col(ROW_ID).alias("row_id"), F.lit(change).alias("change"), F.to_json(F.struct(*user_columns(one)), {"ignoreNullFields": "false"}).alias("row")))
    return told[0].unionByName(told[1])


def audit_all(before: DataFrame, after: DataFrame, entry: str, most: int | None = None) -> DataFrame:
    """What any command did, custom SQL included: changed cells as in :func:`audit`, and whole rows, as JSON, that came or went.

    Columns: audit_entry_id, row_id, change (modified, added or removed), column_name
    (null for rows), previous_value and new_value; all of them by row id, or the first ``most`` for a report.
    """
    both = [c for c in user_columns(before) if c in after.columns]
    cells = _changed_cells(before, after, both, entry).withColumn("change", F.lit("modified"))
    rows = row_changes(before, after, entry)
    gone, nothing = F.col("change") == "removed", F.lit(None).cast("string")
    rows = rows.select("audit_entry_id", "row_id", nothing.alias("column_name"), F.when(gone, F.col("row")).alias("previous_value"), F.when(~gone, F.col("row")).alias("new_value"), "change")
    order = ["audit_entry_id", "row_id", "change", "column_name", "previous_value", "new_value"]
    return _first(cells.unionByName(rows).select(*order), most)


def audit_page(details: DataFrame, size: int = 100, offset: int = 0) -> DataFrame:
    """A page of the details of an audit entry, by row and column."""
    order = [c for c in ("row_id", "pair_index", "column_name") if c in details.columns]
    return details.orderBy(*order).offset(offset).limit(size)


def preview(df: DataFrame, name: str, column: str, sample: int = 10, **params) -> dict:
    found = changes(df, name, column, **params)
    return {"rows": found.limit(sample).collect(), "matching": found.count(), "nulls": df.where(F.col(column).isNull()).count()}


def audit(before: DataFrame, after: DataFrame, columns: list[str], entry: str, most: int | None = None) -> DataFrame:
    """(audit_entry_id, row_id, column_name, previous_value, new_value) of changed cells, all of them by row id, or the first ``most`` for a report."""
    return _first(_changed_cells(before, after, columns, entry), most)


def _first(details: DataFrame, most: int | None) -> DataFrame:
    ordered = details.orderBy("row_id", "column_name")
    return ordered if most is None else ordered.limit(most)


def _changed_cells(before: DataFrame, after: DataFrame, columns: list[str], entry: str) -> DataFrame:
    x = before.select(F.col(ROW_ID).alias("_id"), *[F.col(c).cast("string").alias(f"_{i}a") for i, c in enumerate(columns)])
    y = after.select(F.col(ROW_ID).alias("_id"), *[F.col(c).cast("string").alias(f"_{i}b") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}a").alias("previous_value"), F.col(f"_{i}b").alias("new_value")) for i, c in enumerate(columns)])
    each = x.join(spread(y), "_id").select("_id", F.explode(F.filter(cells, lambda z: ~z["previous_value"].eqNullSafe(z["new_value"]))).alias("z"))
    return each.select(F.lit(entry).alias("audit_entry_id"), F.col("_id").alias("row_id"), "z.*")


def audit_chain(before: DataFrame, steps: list, first: int = 1, most: int | None = None) -> DataFrame:
    """The details of :func:`audit` for every command of a chain, from one scan of ``before``.

    ``steps``: each with ``command`` and ``params``; entries are named by their number, from ``first`` on.
    Each row goes through the commands with its earlier values beside it, so nothing is
    joined.  Commands must work row by row and keep rows (``REGISTRY`` says which do);
    a new column counts from the command after the one that made it, a renamed one keeps
    its values, a removed one is no change.  All details, or the first ``most`` of each command by row id.
    """
    kept, df = [], before
    for i, step in enumerate(steps):
        if not REGISTRY[step.command].stateless:
            raise CommandError("NOT_ROW_BY_ROW", f"{step.command} needs more than a row")
        # what the columns hold before the command, under names no command knows
        names = {c: f"__was_{i}_{j}" for j, c in enumerate(user_columns(df)) if not c.startswith("__told_")}
        was = df.select("*", *[F.col(f"`{c}`").cast("string").alias(n) for c, n in names.items()])
        after = apply(was, step.command, **step.params)
        moved = {step.params["column"]: step.params["new_name"]} if step.command == "rename_column" else {}
        pairs = [(c, n) for c, n in names.items() if moved.get(c, c) in after.columns]
        cells = [F.struct(F.lit(str(first + i)).alias("audit_entry_id"), F.lit(moved.get(c, c)).alias("column_name"), F.col(n).alias("previous_value"), F.col(f"`{moved.get(c, c)}`").cast("string").alias("new_value")) for c, n in pairs]
        changed = F.filter(F.array(*cells), lambda z: ~z["previous_value"].eqNullSafe(z["new_value"])).alias(f"__told_{i}")
        kept.append(f"__told_{i}")
        told = [c for c in after.columns if c.startswith("__told_")]
        df = after.select(*[F.col(f"`{c}`") for c in after.columns if not c.startswith("__was_") and c not in told], *told, changed)
    if not kept:
        return before.sparkSession.createDataFrame([], "audit_entry_id string, row_id long, column_name string, previous_value string, new_value string")
    each = df.select(F.col(ROW_ID).alias("row_id"), F.explode(F.flatten(F.array(*kept))).alias("z"))
    rows = each.select("z.audit_entry_id", "row_id", "z.column_name", "z.previous_value", "z.new_value")
    if most is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("audit_entry_id").orderBy("row_id", "column_name"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
