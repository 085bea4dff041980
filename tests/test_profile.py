"""Profiles from states by part, merged, against exact figures."""

from pyspark.sql import functions as F

from grainmill.operators import profile


def test_states_merge_to_the_profile_of_the_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("file"), F.concat(F.lit("k"), F.col("id") % 5000).alias("k"), F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("v"), F.when(F.col("id") % 10 < 3, " ").otherwise("x").alias("b"))
    whole = {r["column_name"]: r for r in profile.profile(profile.states(df.drop("file"))).collect()}
    parts = profile.states(df, part="file")
    assert parts.count() == 21
    later = profile.merged(parts.where("part < '3'")).unionByName(profile.merged(parts.where("part >= '3'")))
    joined = {r["column_name"]: r for r in profile.profile(later).collect()}
    for name, exact in (("k", 5000), ("v", 15_000), ("b", 2)):
        for p in (whole[name], joined[name]):
            assert abs(p["n_distinct"] - exact) <= 0.03 * exact and p["n_rows"] == 20_000
    for p in (whole, joined):
        assert (p["v"]["n_nulls"], p["b"]["n_blank"], p["k"]["n_nulls"]) == (5000, 6000, 0)
        assert abs(p["v"]["median"] - 10_000) < 500 and abs(p["v"]["q1"] - 5_000) < 500 and p["k"]["median"] is None
        assert [(c["item"], c["count"]) for c in p["b"]["common"]] == [("x", 14_000), (" ", 6_000)]
        assert p["v"]["mean"] == sum(i for i in range(20_000) if i % 4) / 15_000


def test_columns_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "n int, s string")
    found = {r["column_name"]: r for r in profile.profile(profile.states(df)).collect()}
    assert (found["n"]["n_nulls"], found["n"]["n_distinct"], found["n"]["median"], found["n"]["least"]) == (2, 0, None, None)
    assert profile.profile(profile.states(df.limit(0))).count() == 0


def test_rows_are_aggregated_as_they_are(spark):
    df = spark.range(100).select(*[(F.col("id") % (k + 1)).cast("string").alias(f"c{k}") for k in range(profile.TOGETHER + 2)])
    found = profile.states(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made, read = (max(k for k, line in enumerate(plan) if word in line) for word in ("Generate", "Aggregate"))
    assert made < read  # a plan's last lines are what is done first
    rows = {r["column_name"]: r for r in profile.profile(found).collect()}
    assert len(rows) == profile.TOGETHER + 2 and all(rows[f"c{k}"]["n_rows"] == 100 and abs(rows[f"c{k}"]["n_distinct"] - k - 1) <= 1 for k in range(profile.TOGETHER + 2))
    counts = profile.distinct_counts(df)
    assert "Expand" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column_name"]: r["exact"] for r in counts.collect()} == {f"c{k}": k + 1 for k in range(profile.TOGETHER + 2)}
    odd = spark.createDataFrame([(None, float("nan")), ("a", -0.0), ("a", 0.0), ("", float("nan"))], "s string, d double")
    assert {r["column_name"]: r["exact"] for r in profile.distinct_counts(odd).collect()} == {"s": 2, "d": 2}


def test_numbers_are_what_a_cast_takes(spark):
    texts = ["1", " 1", "1 ", "\t-1.5\n", "+.5", "5.", ".", "", " ", "1e3", "1E+3", "1e", "e1", "1d", "2F", "1df", "0x1p3", "0X1.8p1", "0x.8P-1d", "0x1", "NaN", "nan", "-NaN", "INF", "-inf", "+Infinity", "infinit", "1_0", "1,5", "1 2", "\x001\x1f", "\x85" + "1", "٣", "1 ", "1996-09-13", "9" * 400, "1\n\n", "1\nx", "--1", "abc", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    value = F.col("s")
    wrong = df.where(~profile._number(df, "s", value).eqNullSafe(value.try_cast("double"))).collect()
    assert wrong == []
    kinds = spark.sql("SELECT 9007199254740993L AS l, CAST(0.1 AS FLOAT) AS f, 0.1BD AS n, DATE'2024-01-02' AS d, true AS b, CAST(3 AS TINYINT) AS t, CAST('Infinity' AS DOUBLE) AS i")
    for c in kinds.columns:
        text = F.col(c).cast("string")
        assert kinds.select(profile._number(kinds, c, text).eqNullSafe(text.try_cast("double"))).first()[0], c
