"""URL filter: rules by host and path, and a ratio of character language models for the rest.

Only DataFrame functions: grams are exploded, counted and looked up in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4
#: Pseudo-count that a gram's context gives to the shorter gram.
MASS = 2.0
ALPHABET = 256.0
#: Characters of a URL that are cut into grams together.
PIECE = 512
#: Grams that are looked up in a broadcast table.
COMMON = 10000


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules=RULES, value: int | None = None) -> Column:
    """The longest rule that fits, as text or (``value`` 2) its verdict; else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        said = F.lit(verdict if value == 2 else h + p)
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return F.lit(None).cast("string") if out is None else out


def shape(url: Column) -> Column:
    """What the models read: the URL after ``://``, lower case, digits alike, with an end on both sides."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.concat(F.lit("^"), F.regexp_replace(lower_ascii(rest), "[0-9]", "0"), F.lit("$"))


def grams(df: DataFrame, *keep: str, order: int = ORDER) -> DataFrame:
    """A row for each gram of one to ``order`` characters of ``shape``, which itself goes no further.

    A shape is cut into pieces of ``PIECE`` characters first, each with the few before it, as a
    substring is looked for from the start of its text: so the work is in proportion to a URL's length.
    """
    starts = F.explode(F.sequence(F.lit(1), F.length("shape"), F.lit(PIECE))).alias("start")
    lap = F.least(F.lit(order - 1), F.col("start") - 1)
    pieces = df.select(*keep, "shape", starts).withColumn("lap", lap).select(*keep, "lap", F.expr(f"substring(shape, start - lap, {PIECE} + lap)").alias("piece"))
    ends = F.explode(F.sequence(F.col("lap") + 1, F.length("piece"))).alias("end")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("end")))).alias("size")
    each = pieces.select(*keep, "piece", ends).select(*keep, "piece", "end", sizes)
    return each.select(*keep, F.expr("substring(piece, end - size + 1, size)").alias("gram"))


def fit(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, delta, seen): how often each gram stands in the sample, and what it adds to the log ratio of its last character.

    A character's probability after a context mixes its count there with its
    probability after the context shortened by one, down to a flat one.  Grams of
    either model are kept, so every shorter end of a gram has a row too, and the deltas
    of all grams that end at a character add up to the ratio of the longest one known.
    """
    counts = grams(sample, "good", order=order).groupBy("gram").agg(F.sum(F.col("good").cast("long")).alias("a"), F.sum((~F.col("good")).cast("long")).alias("r"))
    sized = counts.withColumn("size", F.length("gram")).withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    by = Window.partitionBy("context", "size")
    sized = cut(sized.withColumn("na", F.sum("a").over(by)).withColumn("nr", F.sum("r").over(by)))
    known = None
    for k in range(1, order + 1):
        own = sized.where(F.col("size") == k)
        if known is None:
            own = own.withColumn("pa0", F.lit(1 / ALPHABET)).withColumn("pr0", F.lit(1 / ALPHABET))
        else:
            shorter = known.select(F.col("gram").alias("tail"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
            own = own.withColumn("tail", F.expr("substring(gram, 2)")).join(shorter, "tail")
        mixed = own.select(
            "gram",
            (F.col("a") + F.col("r")).alias("seen"),
            ((F.col("a") + MASS * F.col("pa0")) / (F.col("na") + MASS)).alias("pa"),
            ((F.col("r") + MASS * F.col("pr0")) / (F.col("nr") + MASS)).alias("pr"),
            F.log(F.col("pa0") / F.col("pr0")).alias("shorter"),
        )
        level = mixed.select("gram", (F.log(F.col("pa") / F.col("pr")) - F.col("shorter")).alias("delta"), "seen", "pa", "pr")
        known = level
        out = level.select("gram", "delta", "seen") if k == 1 else out.unionByName(level.select("gram", "delta", "seen"))
    return out


def score(df: DataFrame, model: DataFrame, key: str, order: int = ORDER) -> DataFrame:
    """(key, score): log-likelihood difference of the two models by character of ``df(key, shape)``, a row for each key."""
    # equal grams of a text count once, with how often they stand there
    each = grams(df.withColumn("n", F.length("shape")), key, "n", order=order).groupBy(key, "n", "gram").agg(F.count("*").alias("times"))
    # the model grows with the pages; its commonest grams alone are broadcast, so no gram's rows crowd one task of the join
    common = cut(model.orderBy(F.desc("seen"), "gram").limit(COMMON).select("gram", F.col("delta").alias("known")))
    tried = each.join(F.broadcast(common), "gram", "left")
    rare = tried.where("known is null").join(model.join(F.broadcast(common), "gram", "left_anti").hint("merge"), "gram")
    hits = tried.where("known is not null").select(key, "n", "times", F.col("known").alias("delta")).unionByName(rare.select(key, "n", "times", "delta"))
    return hits.groupBy(key).agg((F.sum(F.col("delta") * F.col("times")) / F.first("n")).alias("score"))


def _across(known: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(good, score) of all known URLs, each by the models of the other half."""
    halves = known.groupBy("good", "even").agg(F.count("*").alias("n")).collect()  # four rows at most
    if len(halves) < 4:
        return _scored(known, model, order)
    own = [_scored(known.where(F.col("even") == even), cut(fit(known.where(F.col("even") != even), order)), order) for even in (True, False)]
    return own[0].unionByName(own[1])


def _scored(known: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(good, score) of known URLs by a model."""
    return score(known.select("id", "shape").distinct(), model, "id", order).join(known.select("id", "good").hint("merge"), "id").select("good", "score")


def _held_out(known: DataFrame, sample: int, order: int) -> tuple[DataFrame, DataFrame]:
    """The model of all but ``sample`` URLs of each verdict, and (good, score) of these."""
    held = None
    for good in (True, False):
        # a verdict without odd hashes is measured on URLs that the models saw
        one = known.where(F.col("good") == good).orderBy("even", F.md5(F.col("shape").cast("binary")), "shape").limit(sample)
        held = one if held is None else held.unionByName(one)
    held = cut(held)
    seen = known.join(held.where(~F.col("even")).select("id", "good"), ["id", "good"], "left_anti")
    model = cut(fit(seen, order))
    scored = score(held.select("id", "shape").distinct(), model, "id", order).join(held.drop("shape"), "id")
    odd = scored.groupBy("good").agg(F.bool_or(~F.col("even")).alias("odd"))
    return model, scored.join(odd, "good").where(~F.col("even") | ~F.col("odd")).select("good", "score")


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, sample: int | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and score.

    A rule that fits decides.  Other URLs are scored by two smoothed variable-order
    Markov models, of URLs that the rules accept and that they reject, and allowed when
    the difference per character reaches the threshold.  The models count the grams of
    all different URLs of each verdict, whole.  The threshold stands on all of them as well: each is
    scored by models of the other half, told by a hash (by the whole models, where a half lacks a verdict).
    With ``sample`` it stands on URLs that are held out of the models: of
    the odd hashes the first ``sample`` of each verdict, in the order of another hash.
    The threshold stands as many standard deviations from the one mean as from the other.  Without both verdicts the
    score is 0 and all are allowed.  A null URL, or one without ``://``, has an empty
    host and path, and is scored as an empty text.  Rows may be equal or share a
    page_id; other columns are ignored; an empty table gives no rows.  URLs may be of any
    length: digests stand for them from the grams on, and pieces of them are cut into grams.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), shape(F.col("url")).alias("shape")).withColumn("id", F.sha2(F.col("shape").cast("binary"), 256))
    ruled = base.withColumn("rule", first_rule(F.col("host"), F.col("path"), rules)).withColumn("said", first_rule(F.col("host"), F.col("path"), rules, 2))
    known = cut(ruled.where("said is not null").select("id", "shape", (F.col("said") == "allow").alias("good")).distinct().withColumn("even", F.crc32(F.col("shape").cast("binary")) % 2 == 0))
    if sample is None:
        model = cut(fit(known, order))
        held = _across(known, model, order)
    else:
        model, held = _held_out(known, sample, order)
    figures = [(n, g, f) for n, g, f in (("ma", True, F.mean), ("sa", True, F.stddev_pop), ("mr", False, F.mean), ("sr", False, F.stddev_pop))]
    stats = held.groupBy().agg(*[f(F.when(F.col("good") == g, F.col("score"))).alias(n) for n, g, f in figures])
    middle = (F.col("ma") + F.col("mr")) / 2
    apart = (F.col("ma") * F.col("sr") + F.col("mr") * F.col("sa")) / (F.col("sr") + F.col("sa"))
    limit = stats.select(F.when(F.col("sr") + F.col("sa") > 0, apart).otherwise(middle).alias("limit")).first()["limit"]
    # rules' own pages pass by the join; written scores are a plain side of it, so a URL of many pages is split
    open_, decided = ruled.where("rule is null"), ruled.where("rule is not null")
    scores = cut(score(open_.select("id", "shape").distinct(), model, "id", order))
    points = F.coalesce("score", F.lit(0.0))
    by_model = F.lit("allow") if limit is None else F.when(points >= limit, "allow").otherwise("block")
    columns = ["page_id", "host", "path", "rule"]
    judged = open_.join(scores, "id", "left").select(*columns, by_model.alias("verdict"), points.alias("score"))
    return decided.select(*columns, F.col("said").alias("verdict"), F.lit(None).cast("double").alias("score")).unionByName(judged)
