"""Mixing sources to target weights by capped water-filling, with seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .quality import words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Leading hexadecimal digits of a document's seeded digest that name its bucket, and its bucket within that.
BUCKET_DIGITS = (3, 6)


def digest(seed: str = SEED) -> Column:
    """The seeded order of documents within a source; rows without an id go by their texts."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64(F.col("text").cast("string")).cast("string")))
    return F.md5(F.concat_ws(":", F.lit(seed), own).cast("binary"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals(source, source_size)`` with each source's target words.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum
    of all sizes.  A target stops at ``max_epochs`` times its source's size and the
    excess goes to the others by weight.  Taking sources from the soonest full on, the
    water level is that of the first source that stays below its cap, which is what
    repeated redistribution converges to.  One row a source; an empty source gets 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights)) + 1)
    weighed = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / rest
    levelled = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)
    # the level falls from the first source that fits on, so the largest that fits is the first
    target = F.least(F.col("cap").cast("double"), F.coalesce(water, F.lit(0.0)) * F.col("weight"))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def size_of(text: Column) -> Column:
    return F.size(words(F.coalesce(text.cast("string"), F.lit("")))).cast("long")


def goals(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row a source: source, source_size, target, whole (copies of all its documents), and last_digest and last_tie,
    up to which documents are taken once more; null where none is.
    """
    sized = cut(sizes(docs, seed))
    out = _goals(sized, weights, max_epochs)
    discard(sized)
    return out


def sizes(docs: DataFrame, seed: str = SEED, *kept: Column) -> DataFrame:
    """(source, digest, tie, size) of each row, and the columns ``kept``: the one reading of the texts."""
    text = F.col("text").cast("string")
    return docs.select("source", digest(seed).alias("digest"), F.xxhash64(text).alias("tie"), size_of(text).alias("size"), *kept)


def _goals(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    same = lambda a, b: a.eqNullSafe(b)
    # sums by all digits are written once; those by fewer, and by source, are sums of them
    sums = cut(sized.groupBy("source", F.substring("digest", 1, BUCKET_DIGITS[-1]).alias("bucket")).agg(F.sum("size").alias("size")))
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    # the bucket in which the rest of a target ends, then the bucket in it; only documents in that one are put in order
    edge = goal.select(F.col("source").alias("s"), F.lit("").alias("at"), F.col("more").alias("rest")).where("rest > 0")
    known = 0
    for digits in BUCKET_DIGITS:
        level = sums.groupBy("source", F.substring("bucket", 1, known).alias("under"), F.substring("bucket", 1, digits).alias("here")).agg(F.sum("size").alias("size"))
        inside = level.join(edge, same(F.col("source"), F.col("s")) & (F.col("under") == F.col("at")))
        placed = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("s").orderBy("here")))
        ends = placed.where(F.col("upto") - F.col("size") <= F.col("rest"))
        last = ends.groupBy("s").agg(F.max_by(F.struct(F.col("here").alias("at"), (F.col("rest") - F.col("upto") + F.col("size")).alias("rest")), "here").alias("x"))
        edge, known = last.select("s", "x.*"), digits
    goal = cut(goal.join(edge, same(F.col("source"), F.col("s")), "left").select("source", "source_size", "target", "whole", "s", "at", "rest"), sums)
    edge = goal.where("at is not null").select("s", "at", "rest")
    inside = sized.join(edge, same(F.col("source"), F.col("s")) & (F.substring("digest", 1, BUCKET_DIGITS[-1]) == F.col("at")))
    ranked = inside.groupBy("s", "rest", "digest", "tie").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("digest", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = ranked.withColumn("before", before).where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))
    inner = taken.groupBy("s").agg(F.max(F.struct("digest", "tie")).alias("last"))
    # where no document of the last bucket is taken, those of all buckets before it are
    bounds = edge.join(inner.withColumnRenamed("s", "t"), same(F.col("s"), F.col("t")), "left").select("s", F.coalesce("last.digest", "at").alias("last_digest"), F.col("last.tie").alias("last_tie"))
    out = goal.drop("s").join(bounds, same(F.col("source"), F.col("s")), "left").select("source", "source_size", "target", "whole", "last_digest", "last_tie")
    return cut(out, goal)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words the mix takes).

    Size is the number of words, 0 for null and empty texts.  Every document is taken
    as often as its source's target holds the source whole, and the rest of the target
    is filled by documents in the order of a seeded digest, up to the one whose middle
    passes it.  So a source's taken words differ from its target by half a document at
    most, no document exceeds ``max_epochs``, and reruns agree.  Sums by leading digits
    of the digests find the place where a target ends; only the documents there are put
    in order, and no text is shuffled.  Rows that share a doc_id or have none go by
    their texts; rows equal in id and text are taken alike, and the difference is then
    half of all of them at most.  A null source is a source.  Extra columns stay, with
    clashing names replaced; an empty table gives no rows.  Without ``keep_text`` the text is
    left out, and texts are read once instead of twice.
    """
    left_out = ("size", "source_size", "target", "copies", "taken", *(() if keep_text else ("text",)))
    names = [c for c in docs.columns if c.lower() not in left_out]
    rows = sizes(docs, seed, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    if keep_text:
        goal = goals(docs, weights, max_epochs, seed)
    else:
        rows = cut(rows)
        goal = _goals(rows, weights, max_epochs)
    goal = goal.withColumnRenamed("source", "own")
    once_more = (F.col("digest") < F.col("last_digest")) | ((F.col("digest") == F.col("last_digest")) & (F.col("tie") <= F.col("last_tie")))
    copies = F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("long")
    joined = rows.join(goal, F.col("source").eqNullSafe(F.col("own"))).withColumn("copies", copies)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, columns as they were; see :func:`mix` for odd rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = mix(docs.select("doc_id", "text", "source", whole.alias("kept")), **options)
    each = mixed.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])


#: The same rows in DuckDB SQL, over ``documents``.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || doc_id::VARCHAR) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap
  FROM totals),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0) * weight) AS target
  FROM levels),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS w FROM goals),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.w, g.target - g.w * g.source_size AS more,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN whole g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (w + CASE WHEN 2 * start + size <= 2 * more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
