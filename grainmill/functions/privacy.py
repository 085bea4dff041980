"""Deterministic scrubbing of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text


def hashed(c: Column, secret: str) -> Column:
    """MD5 of value and secret; a null hashes as an empty value."""
    if not secret:
        raise ValueError("a secret is required")
    return F.md5(F.concat(F.coalesce(text(c), F.lit("")), F.lit(secret)).cast("binary"))


def mask(c: Column, first: int = 1, last: int = 1, most: int | None = None) -> Column:
    """Stars but for both ends; short values become stars. ``most`` caps the stars."""
    s, n = text(c), F.length(text(c))
    stars = n - (first + last)
    stars = F.least(stars, F.lit(most)) if most else stars
    return F.when(n <= first + last, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(s, F.lit(first)), F.repeat(F.lit("*"), F.greatest(stars, F.lit(0))), F.right(s, F.lit(last))))


def redact(c: Column, value: str = "[REDACTED]", nulls: bool = False) -> Column:
    return F.lit(value) if nulls else F.when(c.isNotNull(), F.lit(value))


def last4(c: Column) -> Column:
    digits = F.regexp_replace(text(c), "[^0-9]", "")
    return F.when(F.length(digits) <= 4, digits).otherwise(F.concat(F.repeat(F.lit("*"), F.length(digits) - 4), F.right(digits, F.lit(4))))


def zero(c: Column) -> Column:
    return F.regexp_replace(text(c), "[0-9]", "0")


def scramble(c: Column) -> Column:
    """Digits reversed; in mixed values each run of digits becomes all digits reversed."""
    s = text(c)
    backwards = F.reverse(F.regexp_replace(s, "[^0-9]", ""))
    return F.when(s.rlike("^[0-9]+$"), F.reverse(s)).otherwise(F.regexp_replace(s, F.lit("[0-9]+"), backwards))


def year_only(c: Column) -> Column:
    s = text(c)
    iso = F.when(s.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), s.try_cast("date"))
    return F.when(iso.isNotNull(), F.concat(F.date_format(iso, "yyyy"), F.lit("-01-01"))).otherwise(s)


def method(c: Column, rule: dict, secret: str | None = None) -> Column:
    """A rule of a batch: constants also replace nulls, and masks have five stars at most."""
    kind, params = rule["method"], rule.get("params", {})
    if kind == "hash":
        if len(secret or "") < 5:
            raise ValueError("a secret of five characters or more is required")
        return hashed(c, secret)
    if kind == "mask":
        return mask(c, params.get("first", 1), params.get("last", 1), 5)
    if kind == "redact":
        return redact(c, params.get("value", "[REDACTED]"), nulls=True)
    plain = {"last4": last4, "zero": zero, "scramble": scramble, "year_only": year_only}
    if kind not in plain:
        raise ValueError(f"unknown method: {kind}")
    return plain[kind](c)


def scrub(df: DataFrame, rules: list[dict], secret: str | None = None) -> DataFrame:
    """All rules in one projection; a column's last rule holds, columns keep their places."""
    by_column = {r["column"]: r for r in rules}
    if missing := [c for c in by_column if c not in df.columns]:
        raise ValueError(f"unknown columns: {missing}")
    return df.select(*[method(F.col(c), by_column[c], secret).alias(c) if c in by_column else F.col(c) for c in df.columns])


def key_map(df: DataFrame, rules: list[dict], secret: str | None = None) -> DataFrame:
    """(column_name, original, obfuscated): the different non-null values of every rule's column, in one pass."""
    by_column = {r["column"]: r for r in rules}
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("original"), method(F.col(c), r, secret).cast("string").alias("obfuscated")) for c, r in by_column.items()])
    return df.select(F.explode(each).alias("x")).select("x.*").where("original is not null").distinct()


def legacy(c: Column, kind: str, secret: str = "") -> Column:
    """The older scrubbing of single values; a null becomes an empty text.

    It differs from :func:`method`: hashes are 16 digits of SHA-256, scrambling keeps
    only the digits, backwards, masks keep one sign at each end and have five stars at
    most, and a whole number is milliseconds to ``year_only``.
    """
    s = text(c)
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "redact":
        out = F.lit("[REDACTED]")
    elif kind == "mask":
        out = mask(c, 1, 1, 5)
    elif kind == "hash":
        out = F.left(F.sha2(F.concat(s, F.lit(secret)).cast("binary"), 256), F.lit(16))
    elif kind == "scramble":
        out = F.reverse(digits)
    elif kind == "last4":
        out = last4(c)
    elif kind == "zero":
        out = zero(c)
    elif kind == "year_only":
        whole = F.when(s.rlike("^(0|-?[1-9][0-9]{0,15})$"), s.try_cast("bigint"))
        out = F.coalesce(F.concat(F.date_format(F.timestamp_millis(whole), "yyyy"), F.lit("-01-01")), year_only(c))
    else:
        out = s
    return F.when(c.isNull(), "").otherwise(out)


def legacy_scrub(df: DataFrame, rules: list[dict], secret: str = "", known: DataFrame | None = None) -> DataFrame:
    """Rules of :func:`legacy` in one projection; nulls stay.

    ``known(original, obfuscated)``, each original once, is a key map from before: its
    values hold in every rule's column, whatever the rule.
    """
    by_column = {r["column"]: r["method"] for r in rules}
    out = df
    for i, (column, kind) in enumerate(by_column.items()):
        c = F.col(f"`{column}`")
        if known is not None:
            pairs = known.select(F.col("original").alias(f"_from_{i}"), F.col("obfuscated").alias(f"_to_{i}"))
            out = out.join(pairs, c.cast("string") == F.col(f"_from_{i}"), "left")

    def scrubbed(column: str, i: int) -> Column:
        c = F.col(f"`{column}`")
        plain = F.when(c.isNotNull(), legacy(c, by_column[column], secret))
        return plain if known is None else F.when(F.col(f"_from_{i}").isNotNull(), F.col(f"_to_{i}")).otherwise(plain)

    place = {c: i for i, c in enumerate(by_column)}
    return out.select(*[scrubbed(c, place[c]).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])
