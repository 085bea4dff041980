"""Row numbers keep every row and repeat none, however the partitions fall out."""

import pytest
from pyspark.sql import functions as F

from grainmill.operators import ids


@pytest.fixture()
def conf(spark):
    keys = {}

    def put(key, value):
        keys.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in keys.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("partitions", [4, 200])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_wide_rows_are_kept_when_written(spark, conf, tmp_path, partitions, adaptive):
    conf("spark.sql.shuffle.partitions", str(partitions))
    conf("spark.sql.adaptive.enabled", adaptive)
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")  # many ranges, of which some are coalesced
    wide = spark.range(20_000, numPartitions=7).select(((F.col("id") * 7919) % 20_000).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("pad"), (F.col("id") % 3).alias("_at"))
    ids.with_ids(wide, ["k"]).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    r = out.agg(F.count("*").alias("n"), F.countDistinct(ids.ROW_ID).alias("different"), F.min(ids.ROW_ID).alias("lo"), F.max(ids.ROW_ID).alias("hi"), F.count_if(F.col(ids.ROW_ID) != (F.col("k") + 1) * 100).alias("wrong")).first()
    assert tuple(r) == (20_000, 20_000, 100, 2_000_000, 0)


def test_ties_nulls_and_empty_tables(spark):
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (0, None)], "k int, v string")
    assert sorted(r[0] for r in ids.numbered(ties, "n", ["k"]).select("n").collect()) == [1, 2, 3, 4]
    assert {r["v"]: r["n"] for r in ids.numbered(ties, "n", ["k"]).collect() if r["v"] in (None, "c")} == {None: 1, "c": 4}
    assert ids.numbered(ties.limit(0), "n", ["k"]).count() == 0
    assert ids.with_ids(ties.limit(0)).columns[:2] == [ids.ROW_ID, ids.ORIGIN_ID]


def test_present_order_is_that_of_the_rows(spark):
    rows = spark.range(1000, numPartitions=5).select("id")
    assert ids.numbered(rows, "n").where("n != id + 1").count() == 0


def test_copies_and_renumbered_tables_keep_other_columns(spark):
    t = spark.createDataFrame([(5, "x", 1), (3, "y", 2), (900, "z", 3)], f"{ids.ROW_ID} long, _order string, _n int")
    out = ids.duplicate(t, keep_ids=False).orderBy(ids.ROW_ID).collect()
    assert [(r[ids.ROW_ID], r["_order"], r["_n"]) for r in out] == [(100, "y", 2), (200, "x", 1), (300, "z", 3)]
    assert [r["_order"] for r in ids.renumber(t).orderBy(ids.ROW_ID).collect()] == ["y", "x", "z"]


def test_columns_of_nulls_only(spark):
    out = ids.numbered(spark.range(3).select("id", F.lit(None).alias("nothing")), "n", ["id"])
    assert dict(out.dtypes)["nothing"] == "void" and out.count() == 3
