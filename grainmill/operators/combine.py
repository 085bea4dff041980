"""Joins and stacks of two tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commands import CommandError
from .ids import user_columns

KINDS = {"inner": "inner", "left": "left", "full_outer": "full", "right": "right", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, key: str, kind: str = "inner") -> DataFrame:
    """All left columns and the right ones that left has not.

    Only the left key stands in the result, so rows of the right alone have a null key.
    """
    if not key:
        raise CommandError("MISSING_KEY")
    if kind not in KINDS:
        raise CommandError("BAD_JOIN", f"unknown join: {kind}")
    own, other = user_columns(left), user_columns(right)
    if key not in own or key not in other:
        raise CommandError("KEY_NOT_FOUND", f"no key {key} in both tables")
    more = [c for c in other if c not in own]
    name = f"_key_{uuid.uuid4().hex}"
    r = right.select(F.col(key).alias(name), *more)
    joined = left.select(*own).join(r, F.col(key) == F.col(name), KINDS[kind])
    return joined.select(*own) if kind in ("semi", "anti") else joined.select(*own, *more)


def validate_join(left: DataFrame, right: DataFrame, key: str) -> dict:
    if key not in left.columns or key not in right.columns:
        return {"valid": False, "warnings": [], "error": "KEY_NOT_FOUND"}
    warnings = []
    kinds = [dict(x.dtypes)[key] for x in (left, right)]
    if kinds[0] != kinds[1]:
        warnings.append(f"key types differ: {kinds[0]} and {kinds[1]}")
    for name, x, kind in (("left", left, kinds[0]), ("right", right, kinds[1])):
        if kind == "string" and (n := x.where(F.col(key) != F.trim(key)).count()):
            warnings.append(f"{n} {name} keys have blanks around them")
    return {"valid": True, "warnings": warnings, "error": None}


def clean_keys(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, F.trim(F.col(key)))


def clean_both_keys(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Both tables with the key's blanks taken off, and how many keys of each had some."""
    counts = []
    for x in (left, right):
        if key not in x.columns:
            raise CommandError("KEY_NOT_FOUND", f"no key {key} in both tables")
        counts.append(x.where(F.col(key).cast("string") != F.trim(F.col(key).cast("string"))).count())
    return clean_keys(left, key), clean_keys(right, key), {"left": counts[0], "right": counts[1]}


def stack(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name, a's columns first, missing ones null, duplicates kept."""
    x, y = a.select(*user_columns(a)), b.select(*user_columns(b))
    kinds = dict(x.dtypes)
    for c, kind in y.dtypes:
        if c in kinds and kinds[c] != kind:
            x, y = x.withColumn(c, F.col(c).cast("string")), y.withColumn(c, F.col(c).cast("string"))
    return x.unionByName(y, allowMissingColumns=True)


def validate_stack(a: DataFrame, b: DataFrame) -> dict:
    x, y = dict(a.select(*user_columns(a)).dtypes), dict(b.select(*user_columns(b)).dtypes)
    warnings = [f"only in the first: {c}" for c in x if c not in y] + [f"only in the second: {c}" for c in y if c not in x]
    return {"valid": True, "warnings": warnings + [f"types of {c} differ: {x[c]} and {y[c]}" for c in x if c in y and x[c] != y[c]]}


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*user_columns(a)).intersect(b.select(*user_columns(a)))


def subtract(a: DataFrame, b: DataFrame, duplicates: bool = False) -> DataFrame:
    x, y = a.select(*user_columns(a)), b.select(*user_columns(a))
    return x.exceptAll(y) if duplicates else x.subtract(y)
