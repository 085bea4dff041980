"""Dates out of text: epochs, a cascade of formats, then a plain cast."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order they are tried; slashes read month first, dashes day first.
FORMATS = ("yyyy-M-d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "yyyy.M.d", "d.M.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
#: Least digits of an epoch in each unit.
EPOCH_DIGITS = (("ns", 18), ("us", 15), ("ms", 12), ("s", 9))
OUTPUT = {"YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy", "DD/MM/YYYY": "dd/MM/yyyy"}


def epoch_unit(c: Column) -> Column:
    """Unit of an all-digit value by its number of digits, else null."""
    s = F.trim(c.cast("string"))
    plain = F.when(s.rlike(r"^[0-9]+(\.0*)?$"), F.regexp_extract(s, r"^([0-9]+)", 1)).when(s.rlike(r"^[0-9](\.[0-9]+)?[eE]\+?[0-9]+$"), s.try_cast("decimal(38,0)").cast("string"))
    out = None
    for unit, digits in EPOCH_DIGITS:
        test = F.length(plain) >= digits
        out = F.when(test, unit) if out is None else out.when(test, unit)
    return out


def from_epoch(c: Column, unit: str) -> Column:
    value = F.trim(c.cast("string")).try_cast("decimal(38,0)").try_cast("bigint")
    scaled = {"ns": F.timestamp_micros(F.floor(value / 1000)), "us": F.timestamp_micros(value), "ms": F.timestamp_millis(value), "s": F.timestamp_seconds(value)}
    return F.when(c.isNotNull(), scaled[unit])


def shape(format_: str) -> str:
    """A pattern of all texts that a format may take: digits for numbers, anything but digits for names of months."""
    letters = {"yyyy": "[+-]?[0-9]{4,}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "MMMM": "[^0-9]+", "MMM": "[^0-9]+", "M": "[0-9]+", "d": "[0-9]+"}
    return "^" + "".join(letters.get(m[0]) or re.escape(m[0]) for m in re.finditer(r"([A-Za-z])\1*|.", format_)) + r"\z"


def parse_text(c: Column) -> Column:
    """The first format that fits; then ISO dates with a time; else null.

    A format is only tried on texts of its shape: a parser that fails costs an exception.
    """
    s = F.ltrim(c.cast("string"))
    tried = [F.when(s.rlike(shape(f)), F.try_to_timestamp(s, F.lit(f)).cast("date")) for f in FORMATS]
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"), s.try_cast("date"))
    return F.coalesce(*tried, iso)


def parse_date(c: Column, unit: str | None = None) -> Column:
    return from_epoch(c, unit).cast("date") if unit else parse_text(c)


def detect_epoch(df, column: str, sample: int = 100) -> str | None:
    """The unit that half of the first ``sample`` values or more look like: the first by row id where there is one."""
    rows = df.where(F.col(column).isNotNull())
    rows = rows.orderBy("_cs_id") if "_cs_id" in df.columns and not df.isStreaming else rows
    found = rows.select(epoch_unit(F.col(column)).alias("u")).limit(sample).groupBy("u").count().collect()
    total = sum(r["count"] for r in found)
    best = max((r for r in found if r["u"]), key=lambda r: r["count"], default=None)
    return best["u"] if best and 2 * best["count"] >= total else None


def age(c: Column, on: Column | None = None, precision: str = "years", unit: str | None = None) -> Column:
    """Calendar years between, or days by 365.25 to one decimal."""
    today, born = (F.current_date() if on is None else on), parse_date(c, unit)
    return F.year(today) - F.year(born) if precision == "years" else F.round(F.datediff(today, born) / 365.25, 1)
