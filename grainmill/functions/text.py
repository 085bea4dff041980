"""Text transforms as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    return c.cast("string")


def is_blank(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return c.isNull() | (F.trim(text(c)) == "")


def title_case(c: Column) -> Column:
    """Each space-separated word with a capital; runs of spaces stay, blank values too."""
    words = F.split(F.lower(text(c)), " ", -1)
    cased = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")
    return F.when(is_blank(c), text(c)).otherwise(cased)


def sentence_case(c: Column) -> Column:
    s = text(c)
    return F.when(is_blank(c), s).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1))))


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """All letters that decompose to a base letter and combining marks, and their bases."""
    source, target = [], []
    for code in range(0xA0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def remove_accents(c: Column) -> Column:
    """Base letters, combining marks dropped; letters that do not decompose stay."""
    source, target = accent_map()
    marks = "".join(map(chr, range(0x300, 0x370)))
    return F.translate(text(c), source + marks, target)


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[ \t\n\r]+", " ")


def remove_non_printable(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[\x00-\x1F\x7F]", "")


def quote_replacement(value: str) -> str:
    """A replacement that a regular expression takes literally."""
    return value.replace("\\", "\\\\").replace("$", "\\$")


def quote_pattern(value: str) -> str:
    return "\\Q" + value.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def replace(c: Column, find: str, to: str = "", case_sensitive: bool | str = True, match: str = "contains") -> Column:
    """All occurrences (``contains``) or whole values (``exact``), with or without case."""
    if not find:
        raise ValueError("find is required")
    if match not in ("contains", "exact"):
        raise ValueError(f"unknown match type: {match}")
    sensitive = case_sensitive not in (False, "false")
    s = text(c)
    if match == "exact":
        same = s == find if sensitive else F.lower(s) == find.lower()
        return F.when(same, to).otherwise(s)
    if sensitive:
        return F.replace(s, F.lit(find), F.lit(to))
    return F.regexp_replace(s, "(?iu)" + quote_pattern(find), quote_replacement(to))


def replace_empty(c: Column, to: str = "") -> Column:
    return F.when(is_blank(c), F.lit(to)).otherwise(text(c))


def pad_zeros(c: Column, length: int = 5) -> Column:
    """Zeros on the left up to ``length``; longer values are cut to it."""
    if not 1 <= length <= 100:
        raise ValueError("length must be from 1 to 100")
    return F.lpad(text(c), length, "0")


def unformat_currency(c: Column) -> Column:
    """Numbers out of ``$1,234.50`` or ``(500)``; null where none is left."""
    s = text(c)
    negative = F.concat(F.lit("-"), F.regexp_replace(s, r"[()$, €]", ""))
    return F.when(s.rlike(r"^\(.*\)$"), negative).otherwise(F.regexp_replace(s, r"[$, €£¥+]", "")).try_cast("double")


def fix_negatives(c: Column) -> Column:
    """Numbers in parentheses as negative ones."""
    s = text(c)
    negative = F.concat(F.lit("-"), F.regexp_replace(s, r"[$(),]", ""))
    return F.when(F.trim(s).rlike(r"\(.*\)"), F.trim(negative)).otherwise(F.regexp_replace(s, ",", "")).try_cast("double")


def fingerprint(c: Column) -> Column:
    """Lower case, no accents, letters, digits and blanks only, words sorted."""
    plain = F.regexp_replace(remove_accents(F.lower(text(c))), r"[^a-z0-9\s]", "")
    return F.array_join(F.array_sort(F.filter(F.split(plain, r"\s+", -1), lambda w: w != "")), " ")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters of the lower-cased text."""
    s = F.lower(F.trim(text(c)))
    at = F.when(F.length(s) >= 2, F.sequence(F.lit(1), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(s, i, F.lit(2))))


def literal_pattern(value: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", value)
