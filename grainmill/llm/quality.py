"""Quality rules over words and lines, and line frequency across the documents of a host.

DataFrame functions only: word and window hashes are arrays beside each text, so that
no text and no word leaves its row; only hashed lines are exploded and shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

BLANKS = r"[\x20\x09-\x0D]+"
#: A line in more distinct texts of one host than this is boilerplate.
MAX_DOCS = 50
#: A document that keeps less than this share of its word characters is depleted.
MIN_LEFT = 0.1
MIN_WORDS = 10
MAX_REPEATED = 20
SYMBOLS = "#*$%&|<>"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS, -1), "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """A line for comparison: lower case, runs of blanks as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, BLANKS, " ")))


def identity() -> list[Column]:
    """Tell rows apart that differ in id or text; equal rows share both columns."""
    ident = F.col("doc_id").cast("long")
    return [F.coalesce(ident, F.lit(0)), F.xxhash64(ident.isNull(), _text())]


def hashed_lines(host: Column) -> Column:
    """(h, chars) of each line with a word: a hash of it and its host, and its word characters."""
    line = lambda x: F.struct(F.xxhash64(host.isNull(), host, normalised(x)).alias("h"), F.length(F.regexp_replace(x, BLANKS, "")).alias("chars"))
    return F.transform(lines(_text()), line)


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words.  Windows of five words are compared by 64-bit hashes.
    Most texts have no window twice, which a hash set tells; only the others are sorted.
    """
    text = _text()
    names = docs.columns
    step = docs.withColumn("_w", words(text)).withColumn("_l", lines(text))
    step = step.select(
        *names,
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    at = F.when(F.col("_n") >= 5, F.sequence(F.lit(0), F.col("_n") - 5)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("_win", F.transform(at, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(5)])))
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    ordered = F.when(twice, F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    step = step.withColumn("_s", ordered)
    equal = F.filter("_s", lambda e, k: (F.get("_s", k - 1)["x"] == e["x"]) | F.coalesce(F.get("_s", k + 1)["x"] == e["x"], F.lit(False)))
    step = step.withColumn("_p", F.array_sort(F.transform(equal, lambda e: e["i"])))
    # a window covers five words, or as many as stand before the next such window
    reach = F.transform("_p", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - i, F.lit(5))))
    step = step.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x))
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("_n"))
    return step.select(*names, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base rules and hashed lines of each row, from one scan of the texts: id, key, doc_id, body, lines and the measures."""
    ident, key = identity()
    slim = docs.select(ident.alias("id"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("body"), hashed_lines(F.col(f"`{host}`").cast("string")).alias("lines"), _text().alias("text"))
    return cut(base_rules(slim).drop("text"))


def frequent_lines(table: DataFrame, max_docs: int = MAX_DOCS, copies_once: bool = True) -> DataFrame:
    """(id, key, removed, removed_chars): per row of :func:`measured` the hashes and word characters of its lines above the limit.

    The limit is on distinct texts of one host that hold the line, so exact copies count
    once, or on distinct documents (by doc_id and text) without ``copies_once``.  The text, or the
    document, with the smallest doc_id of each host keeps the line.  Rows with a
    null host form one host.
    """
    one = F.struct("body") if copies_once else F.struct("body", "id", "key")
    rows = table.select("id", "key", "doc_id", "body", one.alias("one"), F.posexplode("lines").alias("place", "x")).select("id", "key", "doc_id", "one", "place", "x.*")
    once = rows.groupBy("h", "one").agg(F.min("doc_id").alias("doc_id"))
    common = once.groupBy("h").agg(F.count("*").alias("texts"), F.min_by("one", F.struct("doc_id", "one")).alias("keeper")).where(F.col("texts") > max_docs)
    # written before it is joined, so that a hot line's rows can be split
    gone = rows.join(cut(common.select("h", "keeper")), "h").where("one != keeper")
    lost = gone.groupBy("id", "key", "place").agg(F.first("h").alias("h"), F.first("chars").alias("chars"))  # equal rows have one key
    return lost.groupBy("id", "key").agg(F.collect_set("h").alias("removed"), F.sum("chars").alias("removed_chars"))


def _verdicts(docs: DataFrame, host: str, max_docs: int, min_left: float, copies_once: bool) -> DataFrame:
    """Base rules of each row with its id and key, the hashes of the lines it loses, and the verdict."""
    table = measured(docs, host)
    gone = F.coalesce("removed_chars", F.lit(0))
    kept = ~F.col("base_failed") & (F.col("word_chars") - gone >= min_left * F.col("word_chars"))
    return table.drop("lines").join(frequent_lines(table, max_docs, copies_once), ["id", "key"], "left").withColumn("removed_chars", gone).withColumn("kept", kept)


def quality(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, copies_once: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_chars.

    ``kept`` is false where the base rules fail or where lines above the limit leave
    less than ``min_left`` of the word characters; without ``copies_once`` exact copies
    count each in that limit (see :func:`frequent_lines`).  Empty and null texts have no words
    and fail.  Rows may be equal or share a doc_id, other columns may have any names,
    and an empty table gives no rows.
    """
    return _verdicts(docs, host, max_docs, min_left, copies_once).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, copies_once: bool = True) -> DataFrame:
    """The documents that :func:`quality` keeps, without their lines above the limit; columns as they were.

    Empty lines stay where they stood.  n_chars, where there is one, follows the text.
    Null and empty texts fail the base rules and go.  Equal rows have one verdict and
    all stay or go; rows may share a doc_id or have none; a null host is a host; columns
    may have any names; an empty table gives no rows.
    """
    names = docs.columns
    ident, key, removed = fresh(docs, "id", "key", "removed")
    # written first: a filter on the verdict would be pushed into the array expressions and repeat them
    verdicts = cut(_verdicts(docs, host, max_docs, min_left, copies_once).select("id", "key", "kept", "removed"))
    good = verdicts.where("kept").groupBy(F.col("id").alias(ident), F.col("key").alias(key)).agg(F.first("removed").alias(removed))
    given = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(n) for c, n in zip(identity(), (ident, key), strict=True)])
    joined = given.join(good, [ident, key])
    own = F.col(f"`{host}`").cast("string")
    stays = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(removed, F.xxhash64(own.isNull(), own, normalised(x))) | ~x.rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
