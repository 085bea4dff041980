"""All pairs of values of one block above a Jaro-Winkler similarity, without comparing each with each.

A pair of similarity ``t`` with a common beginning of ``l`` characters (4 at most) needs a Jaro similarity of
``(t - l / 10) / (1 - l / 10)``, and that needs a number of characters in common which
the two lengths give.  So each value is a set of tokens (a character and how often it
has come already), in order of rarity, and pairs of enough common tokens meet in one of the
rarest few of both: an inverted index of those, by common beginning, gives the candidates.
The tokens of a candidate then bound its similarity before the similarity itself is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from .ids import spread, stored

#: Characters at the beginning that raise a similarity, and the Jaro similarity above which they do.
PREFIX, RAISED = 4, 0.7


def jaro_needed(least: float, common: int) -> float:
    """The Jaro similarity without which a common beginning can't lift a pair to ``least``."""
    return least if least <= RAISED else max(RAISED, (least - 0.1 * common) / (1 - 0.1 * common))


def tokens(value: Column) -> Column:
    """Characters with their running number: ``anna`` has a1 a2 n1 n2."""
    signs = F.array_sort(F.split(value, "", -1))
    held = F.filter(signs, lambda x: x != "")
    return F.transform(held, lambda x, i: F.concat(x, (i - F.array_position(held, x) + 2).cast("string")))


def overlap_needed(m: Column, n: Column, jaro: float) -> Column:
    """How many common characters two values of ``m`` and ``n`` need: one at least."""
    return F.greatest(F.lit(1), F.ceil((3 * jaro - 1) * m * n / (m + n) - 1e-9))


def ranked(values: DataFrame) -> DataFrame:
    """(block, value, n, toks): tokens from the rarest of all values to the commonest."""
    each = values.select("block", "value", F.explode(tokens(F.col("value"))).alias("token"))
    counts = stored(each.groupBy("token").agg(F.count("*").alias("often")))
    order = F.array_sort(F.collect_list(F.struct("often", "token")))
    toks = F.transform(order, lambda x: x["token"])
    return each.join(counts, "token").groupBy("block", "value").agg(toks.alias("toks")).withColumn("n", F.size("toks"))


def candidates(values: DataFrame, least: float) -> DataFrame:
    """(block, u, v), each pair once with u < v: all pairs of ``values(block, value)`` that may reach ``least``, and few others."""
    if least <= 0:
        raise ValueError("the least similarity must be above 0")
    known = stored(ranked(values))
    n = F.col("n")
    shorter, longer = [], []
    for common in range(PREFIX + 1):
        jaro = jaro_needed(least, common)
        shortest = F.greatest(F.lit(1), F.ceil((3 * jaro - 2) * n - 1e-9))
        rows = known.where(F.length("value") >= common)
        facts = [F.lit(common).alias("common"), F.substring("value", 1, common).alias("head")]
        shorter.append(rows.select("*", *facts, (n - overlap_needed(n, n, jaro) + 1).alias("reach")))
        longer.append(rows.select("*", *facts, (n - overlap_needed(n, shortest, jaro) + 1).alias("reach"), shortest.alias("shortest")))

    def posted(parts: list[DataFrame], side: str) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        rare = F.slice("toks", 1, F.greatest(F.col("reach").cast("int"), F.lit(1)))
        out = whole.withColumn("rare", rare).withColumn("token", F.explode("rare"))
        keys = ("block", "common", "head", "token")
        return out.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in out.columns if c not in (*keys, "reach")])

    joined = posted(shorter, "a").join(spread(posted(longer, "b")), ["block", "common", "head", "token"])
    ordered = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_value") < F.col("b_value")))
    # a pair counts once: by its whole common beginning, and by the rarest of the tokens that both are listed under
    following = [F.substring(c, F.col("common") + 1, F.lit(1)) for c in ("a_value", "b_value")]
    whole_head = (F.col("common") == PREFIX) | (following[0] != following[1]) | (F.length("a_value") == F.col("common"))
    first = F.get(F.array_intersect("a_rare", "b_rare"), F.lit(0)) == F.col("token")
    needed = F.lit(None)
    for common in range(PREFIX + 1):
        needed = F.when(F.col("common") == common, overlap_needed(F.col("a_n"), F.col("b_n"), jaro_needed(least, common))).otherwise(needed)
    near = joined.where(ordered & (F.col("a_n") >= F.col("b_shortest")) & whole_head & first).where(F.size(F.array_intersect("a_toks", "b_toks")) >= needed)
    return near.select("block", F.least("a_value", "b_value").alias("u"), F.greatest("a_value", "b_value").alias("v"))


def similar_pairs(values: DataFrame, least: float) -> DataFrame:
    """(block, u, v, similarity) of all pairs of different ``values(block, value)``, each value once, that reach ``least``.

    Empty values are like none.  The work grows with the values that share a rare token
    and with the pairs found; one token of very many values is split by adaptive execution, as
    both sides of the join are plain exchanges.
    """
    scored = candidates(values, least).withColumn("similarity", similarity.jaro_winkler_column("u", "v"))
    return scored.where(F.col("similarity") >= least)
