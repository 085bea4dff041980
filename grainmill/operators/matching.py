"""Fuzzy duplicates within blocks, merging them, and clusters of spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from . import fuzzy
from .graph import connected_components
from .commands import command, require
from .ids import ROW_ID, numbered, spread, stored, user_columns

STRICT_FROM, SAMPLED_FROM, SAMPLE = 500, 2000, 500
PER_BLOCK, MOST_PAIRS = 1000, 10_000


def block_key(df: DataFrame, column: str, strategy: str) -> DataFrame:
    """``df`` with ``_block``; rows without a key drop out. Phonetic keys are made once for each value."""
    c = F.col(column).cast("string")
    native: dict[str, Column] = {
        "first_letter": F.upper(F.substring(c, 1, 1)),
        "first_2_chars": F.upper(F.substring(F.regexp_replace(c, "[^a-zA-Z0-9]", ""), 1, 2)),
        "none": F.lit("ALL"),
        "fingerprint": text.fingerprint(c),
    }
    if strategy in native:
        out = df.withColumn("_block", native[strategy])
    else:
        make = {"metaphone": similarity.metaphone_column, "token_phonetic": similarity.token_phonetic_column}[strategy]
        values = df.select(c.alias("_value")).where("_value is not null").distinct().withColumn("_block", make("_value"))
        out = df.join(spread(values), c == F.col("_value")).drop("_value")
    return out.where(F.col("_block") != "")


def find_duplicates(df: DataFrame, column: str, strategy: str = "first_letter", definite: float = 85.0, maybe: float = 60.0, limited: bool = False) -> DataFrame:
    """Pairs of rows of one block with a similarity of ``maybe`` percent or more.

    Different values are paired through an index of their rare characters (see
    :mod:`.fuzzy`), so a block may hold all rows; every pair is found.  With ``limited``, blocks above 500 rows need five points more and blocks of
    2000 and more are sampled to 500 rows by hash, 1000 pairs a block and 10000 in all
    at most, as an interactive report wants it.
    """
    rows = df.where(~text.is_blank(F.col(column)))
    keyed = block_key(rows, column, strategy).select("*", F.lower(F.col(column).cast("string")).alias("_low"))
    least = F.lit(maybe / 100)
    if limited:
        sizes = keyed.groupBy("_block").agg(F.count("*").alias("_size"))
        sized = keyed.join(spread(sizes), "_block")
        # of a large block's ids only the first by hash leave each partition
        ids = sized.where(F.col("_size") >= SAMPLED_FROM).select("_block", ROW_ID)
        rank = F.row_number().over(Window.partitionBy("_block").orderBy(F.md5(F.col(ROW_ID).cast("string").cast("binary")), ROW_ID))
        chosen = ids.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE).select(ROW_ID)
        keyed = sized.where(F.col("_size") < SAMPLED_FROM).unionByName(sized.where(F.col("_size") >= SAMPLED_FROM).join(spread(chosen), ROW_ID, "left_semi").select(sized.columns))
        least = F.when((F.col("_size") >= STRICT_FROM) & (F.col("_size") < SAMPLED_FROM), F.least(F.lit(0.95), F.lit(maybe / 100 + 0.05))).otherwise(maybe / 100)
    keyed = keyed.withColumn("_least", least)
    names = user_columns(df)
    values = keyed.select("_block", "_low").distinct()
    near = fuzzy.similar_pairs(values.select(F.col("_block").alias("block"), F.col("_low").alias("value")), maybe / 100)
    scored = near.select(F.col("block").alias("_block"), F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("similarity").alias("_jw"))
    if limited:
        scored = scored.join(keyed.groupBy("_block").agg(F.first("_least").alias("_least")), "_block").where("_jw >= _least")
    # each pair of values both ways from one search, and each value with itself
    ways = F.inline(F.array(F.struct(F.col("_u"), F.col("_v")), F.struct(F.col("_v").alias("_u"), F.col("_u").alias("_v"))))
    both = scored.select("_block", "_jw", ways).select("_block", "_u", "_v", "_jw").unionByName(values.select("_block", F.col("_low").alias("_u"), F.col("_low").alias("_v"), F.lit(1.0).alias("_jw")))
    a = keyed.select("_block", F.col("_low").alias("_u"), F.col(ROW_ID).alias("a_row_id"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = keyed.select("_block", F.col("_low").alias("_v"), F.col(ROW_ID).alias("b_row_id"), *[F.col(c).alias(f"b_{c}") for c in names])
    pairs = a.join(spread(both), ["_block", "_u"]).join(spread(b), ["_block", "_v"]).where("a_row_id < b_row_id")
    found = pairs.withColumn("similarity", F.round(F.col("_jw") * 100, 1)).withColumn("score", F.round(100 - F.col("_jw") * 100).cast("int"))
    found = found.withColumn("class", F.when(F.col("similarity") >= definite, "definite").when(F.col("similarity") >= maybe, "maybe").otherwise("not_match"))
    if limited:
        top = Window.partitionBy("_block").orderBy(F.col("similarity").desc(), "a_row_id", "b_row_id")
        found = found.withColumn("_top", F.row_number().over(top)).where(F.col("_top") <= PER_BLOCK).drop("_top")
        found = found.orderBy(F.col("similarity").desc(), "a_row_id", "b_row_id").limit(MOST_PAIRS)
    return found.drop("_u", "_v", "_jw").withColumnRenamed("_block", "block")


def field_similarities(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``field_similarities``: column, both values, percentage and exact, similar or different."""
    fields = []
    for c in columns:
        a, b = F.coalesce(F.col(f"a_{c}").cast("string"), F.lit("")), F.coalesce(F.col(f"b_{c}").cast("string"), F.lit(""))
        pairs = pairs.withColumn(f"_s_{c}", similarity.field_similarity_column(a, b))
        status = F.when(F.col(f"_s_{c}") == 100, "exact").when(F.col(f"_s_{c}") >= 70, "similar").otherwise("different")
        fields.append(F.struct(F.lit(c).alias("column"), a.alias("value_a"), b.alias("value_b"), F.col(f"_s_{c}").alias("similarity"), status.alias("status")))
    return pairs.withColumn("field_similarities", F.array(*fields)).drop(*[f"_s_{c}" for c in columns])


def stratified(pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Fuzzy pairs first, best ones before others, and exact ones evenly over the rest."""
    exact = F.col("similarity") == 100
    fuzzy = pairs.where(~exact).orderBy(F.col("similarity").desc(), "a_row_id", "b_row_id").limit(most)
    even = pairs.where(exact).orderBy(F.xxhash64("a_row_id", "b_row_id"), "a_row_id", "b_row_id").limit(most)
    ordered = fuzzy.unionByName(even).withColumn("_exact", exact)  # twice ``most`` rows, however many pairs there are
    rank = F.row_number().over(Window.partitionBy("_exact").orderBy(F.when(F.col("_exact"), F.xxhash64("a_row_id", "b_row_id")).otherwise(F.lit(0)), F.col("similarity").desc(), "a_row_id", "b_row_id"))
    return ordered.withColumn("_rank", rank).orderBy("_exact", "_rank").limit(most).drop("_exact", "_rank")


def groups(pairs: DataFrame) -> DataFrame:
    """(row_id, group) of all rows that ``pairs(a_row_id, b_row_id)`` join, directly or by way of others; the group is its smallest row id."""
    links = pairs.select(F.col("a_row_id").cast("long").alias("a"), F.col("b_row_id").cast("long").alias("b"))
    others = stored(connected_components(links))  # (id, component) of all but the smallest
    return others.select(F.col("id").alias("row_id"), F.col("component").alias("group")).unionByName(others.select(F.col("component").alias("row_id"), F.col("component").alias("group")).distinct())


def survivors(df: DataFrame, grouped: DataFrame, keep: str = "first") -> DataFrame:
    """(group, kept_id, n) for each group: its ``first`` row by id, or the ``fullest``, with most values that are not blank (ties: first)."""
    if keep not in ("first", "fullest"):
        raise ValueError(f"unknown choice: {keep}")
    blank = [F.when(text.is_blank(F.col(f"`{c}`")), 1).otherwise(0) for c in user_columns(df)] if keep == "fullest" else []
    rows = grouped.join(spread(df.select(F.col(ROW_ID).alias("row_id"), sum(blank, F.lit(0)).alias("blank"))), "row_id")
    rank = F.struct("blank", "row_id")
    return rows.groupBy("group").agg(F.min(rank)["row_id"].alias("kept_id"), F.count("*").alias("n"))


def merge_groups(df: DataFrame, pairs: DataFrame, keep: str = "first", match_column: str = "", audit_id: str = "merge") -> tuple[DataFrame, DataFrame]:
    """``df`` with one row of each group of ``pairs(a_row_id, b_row_id, similarity)``, and the details of the merge.

    Chains count: where a is like b and b like c, one of the three stays, however unlike a
    and c are.  A deleted row's similarity is the best that any pair gives it.
    """
    pairs = stored(pairs)  # matched once
    grouped = stored(groups(pairs))
    kept = stored(survivors(df, grouped, keep))
    best = pairs.select(F.explode(F.array("a_row_id", "b_row_id")).alias("deleted_id"), "similarity").groupBy("deleted_id").agg(F.max("similarity").alias("similarity"))
    gone = grouped.join(spread(kept), "group").where("row_id <> kept_id").select("kept_id", F.col("row_id").alias("deleted_id"))
    chosen = stored(gone.join(spread(best), "deleted_id").withColumn("match_column", F.lit(match_column)))
    return merge_duplicates(df, chosen, audit_id)


def resolved(pairs: DataFrame) -> DataFrame:
    """``pairs(kept_id, deleted_id, …)`` of merges one after the other, each deleted row once, with the row that is left at last.

    A row that one pair keeps and another deletes is deleted; its own deleted rows go
    to the smallest row of the group that no pair deletes, or the smallest of all where each is deleted.
    """
    pairs = stored(pairs)  # matched once
    grouped = stored(groups(pairs.select(F.col("kept_id").alias("a_row_id"), F.col("deleted_id").alias("b_row_id"))))
    first = Window.partitionBy("deleted_id").orderBy(F.col("similarity").desc_nulls_last(), "kept_id")
    once = pairs.where("kept_id <> deleted_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "kept_id")
    told = grouped.join(spread(once.select(F.col("deleted_id").alias("row_id"), F.lit(True).alias("_gone"))), "row_id", "left")
    roots = told.groupBy("group").agg(F.min(F.struct(F.coalesce("_gone", F.lit(False)).alias("gone"), "row_id"))["row_id"].alias("kept_id"))
    named = once.join(spread(grouped.withColumnRenamed("row_id", "deleted_id")), "deleted_id").join(spread(roots), "group").where("kept_id <> deleted_id")
    return named.select("kept_id", "deleted_id", *[c for c in once.columns if c != "deleted_id"])


def merge_duplicates(df: DataFrame, pairs: DataFrame, audit_id: str = "merge") -> tuple[DataFrame, DataFrame]:
    """Rows without the ones that ``pairs(kept_id, deleted_id, similarity, match_column)`` merge, and the details.

    Pairs may form chains; see :func:`resolved`.
    """
    pairs = stored(resolved(pairs))
    gone = pairs.select(F.col("deleted_id").alias(ROW_ID)).distinct()
    as_json = df.select(F.col(ROW_ID).alias("_id"), F.to_json(F.struct(*user_columns(df)), {"ignoreNullFields": "false"}).alias("_json"))
    kept = as_json.select(F.col("_id").alias("kept_id"), F.col("_json").alias("kept_row_data"))
    dropped = as_json.select(F.col("_id").alias("deleted_id"), F.col("_json").alias("deleted_row_data"))
    details = pairs.join(spread(kept), "kept_id").join(spread(dropped), "deleted_id")
    index = numbered(pairs.select("kept_id", "deleted_id").distinct(), "_n", ["kept_id", "deleted_id"])
    details = details.join(spread(index), ["kept_id", "deleted_id"])
    audit = details.select(F.lit(audit_id).alias("audit_entry_id"), (F.col("_n") - 1).alias("pair_index"), F.round("similarity").cast("int").alias("similarity"), "match_column", "kept_row_data", "deleted_row_data")
    return df.join(spread(gone), ROW_ID, "left_anti"), audit


def build_clusters(df: DataFrame, column: str, algorithm: str = "fingerprint") -> DataFrame:
    """(cluster_key, master, values, size, row_count): spellings by key, the most frequent one first."""
    c = F.col(column).cast("string")
    values = df.where(~text.is_blank(c)).groupBy(c.alias("value")).agg(F.count("*").alias("count"))
    keys = {"fingerprint": text.fingerprint(F.col("value")), "metaphone": similarity.metaphone_column("value"), "token_phonetic": similarity.token_phonetic_column("value")}
    if algorithm not in keys:
        raise ValueError(f"unknown algorithm: {algorithm}")
    keyed = values.withColumn("cluster_key", keys[algorithm]).where("cluster_key != ''")
    one = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "value", "count")))
    return keyed.groupBy("cluster_key").agg(one.alias("v"), F.count("*").alias("size"), F.sum("count").alias("row_count")).select(
        "cluster_key", F.get("v", F.lit(0))["value"].alias("master"), F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("values"), "size", "row_count"
    )


def validate_clustering(df: DataFrame, column: str, most: int | None = 50_000) -> dict:
    n = df.where(~text.is_blank(F.col(column))).agg(F.countDistinct(F.col(column).cast("string"))).first()[0]
    return {"valid": n > 0 and (most is None or n <= most), "distinct": n}


def mappings(clusters: DataFrame, chosen: dict[str, str | None] | None = None, left_out: list[str] = ()) -> DataFrame:
    """(from_value, to_value): the other spellings of each cluster of two and more to its master.

    ``chosen``: cluster keys, with a value of one's own instead of the master or None; all
    clusters where it is not given.  ``left_out``: spellings that stay as they are.
    """
    goal = F.col("master")
    used = clusters.where("size > 1")
    if chosen is not None:
        used = used.where(F.col("cluster_key").isin(list(chosen)))
        for key, value in chosen.items():
            goal = F.when(F.col("cluster_key") == key, F.lit(value)).otherwise(goal) if value is not None else goal
    each = used.select(goal.alias("to_value"), F.explode("values").alias("v")).where("v.value != to_value")
    each = each.where(~F.col("v.value").isin(list(left_out))) if left_out else each
    return each.select(F.col("v.value").alias("from_value"), "to_value")


def apply_mappings(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("from_value").alias("_from"), F.col("to_value").alias("_to"))
    joined = df.join(m, F.col(column).cast("string") == F.col("_from"), "left")
    return joined.select(*[F.coalesce("_to", F.col(c).cast("string")).alias(c) if c == column else F.col(c) for c in df.columns])


@command("standardize", stateless=False, in_recipes=False)
def standardize(df: DataFrame, column: str, mapping: DataFrame | dict[str, str | None] | None = None, algorithm: str = "fingerprint", chosen: dict[str, str | None] | None = None, left_out: list[str] = ()) -> DataFrame:
    """Spellings replaced by ``mapping`` (a goal of None leaves its value as it is), else by the masters of the column's own clusters, or of ``chosen`` ones."""
    require(df, column)
    if mapping is None:
        mapping = mappings(build_clusters(df, column, algorithm), chosen, left_out)
    elif isinstance(mapping, dict):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), "from_value string, to_value string")
    return apply_mappings(df, column, mapping)


@command("merge", stateless=False, in_recipes=False)
def merge(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows without the ones that ``pairs`` merge; :func:`merge_duplicates` gives the details as well."""
    require(df, ROW_ID)
    return merge_duplicates(df, pairs)[0]


def mapping_audit(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    hits = df.groupBy(F.col(column).cast("string").alias("from_value")).agg(F.count("*").alias("row_count"))
    return mapping.join(hits, "from_value").select("from_value", "to_value", "row_count").orderBy(F.col("row_count").desc(), "from_value")
