"""Snapshots, chained audits, cursors and groups of matches."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import filters, matching, validation
from grainmill.operators.commands import CommandError
from grainmill.operators.ids import ROW_ID
from grainmill.plans.history import Timeline
from grainmill.plans.recipe import Step
from grainmill.sources.versions import Versions


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_undo_reads_the_nearest_snapshot(spark, tmp_path):
    spark.range(50).select((F.col("id") * 100).alias(ROW_ID), F.concat(F.lit("a"), F.col("id").cast("string")).alias("v")).write.parquet(f"{tmp_path}/source")
    source = spark.read.parquet(f"{tmp_path}/source")
    line, whole = Timeline(source, snapshots=Versions(spark, f"{tmp_path}/snaps"), every=3, most=4), Timeline(source)
    for i in range(30):
        line.run("replace", column="v", find=str(i % 10), to=chr(98 + i % 20))
    whole.steps = list(line.steps)
    assert line.snapshots.numbers()[-1] == 30 and len(line.snapshots.numbers()) == 4
    undone = line.undo()
    start = line.snapshots.latest(29)
    assert start and all(f"/snaps/v{start}/" in f for f in undone.inputFiles())
    assert rows_of(undone) == rows_of(whole.at(29))
    for position in (0, 1, 7, 16, 30):
        assert rows_of(line.at(position)) == rows_of(whole.at(position))
    line.run("uppercase", column="v")  # a new step 30: the old one's snapshot is gone and written anew
    assert rows_of(line.at(30)) == rows_of(whole.at(29).withColumn("v", F.upper("v")))
    assert rows_of(line.undo()) == rows_of(whole.at(29)) and rows_of(line.redo()) == rows_of(line.at(30))


def test_snapshots_stay_spread(spark, tmp_path):
    line = Timeline(spark.range(1).select(F.col("id").alias(ROW_ID), F.lit("x").alias("v")), snapshots=Versions(spark, f"{tmp_path}/s"), every=1, most=3)
    for _ in range(8):
        line.run("trim", column="v")
    kept = line.snapshots.numbers()
    assert len(kept) == 3 and kept[-1] == 8 and kept[0] <= 4


def test_chain_of_commands_is_audited_in_one_scan(spark, tmp_path):
    data = [(i * 100, f" Name {i} ", None if i % 4 == 0 else i, "x") for i in range(1, 40)]
    spark.createDataFrame(data, f"{ROW_ID} long, a string, n int, z string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    steps = [Step("trim", {"column": "a"}), Step("uppercase", {"column": "a"}), Step("rename_column", {"column": "a", "new_name": "b"}), Step("pad_zeros", {"column": "n", "length": 3}), Step("add_column", {"column": "new"}), Step("replace", {"column": "b", "find": "NAME 7", "to": "q"}), Step("delete_column", {"column": "z"})]
    chain = validation.audit_chain(t, steps)
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
    line, want = Timeline(t), []
    for i, s in enumerate(steps, 1):
        line.run(s.command, **s.params)
        if s.command in ("trim", "uppercase", "pad_zeros", "replace"):
            want += [tuple(r) for r in line.details(i).collect()]
    assert rows_of(chain) == sorted(want, key=str)
    assert rows_of(line.chain_details(2, 4)) == sorted([r for r in want if r[0] in "234"], key=str)
    assert validation.audit_chain(t, []).count() == 0
    with pytest.raises(CommandError):
        validation.audit_chain(t, [Step("fill_down", {"column": "a"})])


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "string"])
def test_pages_by_cursor_join_to_the_sorted_table(spark, descending, kind):
    rng = random.Random(4)
    data = [(i, rng.choice([None, 1.5, 2.0, 2.0, -3.0, 7.25, 100.0])) for i in range(60)]
    df = spark.createDataFrame(data, f"{ROW_ID} long, v double").withColumn("v", F.col("v").cast(kind)).cache()
    want = [r[ROW_ID] for r in filters.sort(df, "v", descending).collect()]
    forward, cursor = [], None
    while True:
        page = filters.sorted_page(df, 7, "v", descending, cursor).collect()
        forward += [r[ROW_ID] for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = filters.cursor_of(page[6], "v")
    assert forward == want
    end = df.where(F.col(ROW_ID) == want[-1]).first()
    back, cursor = [want[-1]], filters.cursor_of(end, "v")
    while True:
        page = filters.sorted_page(df, 7, "v", descending, cursor, backward=True).collect()
        back += [r[ROW_ID] for r in page[:7]]
        if len(page) <= 7:
            break
        cursor = filters.cursor_of(page[6], "v")
    assert back == want[::-1]


def test_chains_of_matches(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "ab", "x"), (3, "abc", None), (4, "z", "y"), (5, "zz", "y"), (6, "alone", "q")], f"{ROW_ID} long, v string, row_id string")
    pairs = spark.createDataFrame([(2, 3, 91.0), (1, 2, 95.0), (4, 5, 90.0)], "a_row_id long, b_row_id long, similarity double")
    assert rows_of(matching.groups(pairs)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    kept, audit = matching.merge_groups(df, pairs, match_column="v")
    assert [r[ROW_ID] for r in kept.orderBy(ROW_ID).collect()] == [1, 4, 6]
    assert [(r["pair_index"], r["similarity"]) for r in audit.orderBy("pair_index").collect()] == [(0, 95), (1, 91), (2, 90)]
    kept, _ = matching.merge_groups(df, pairs, keep="fullest")
    assert [r[ROW_ID] for r in kept.orderBy(ROW_ID).collect()] == [2, 4, 6]
    chain = spark.createDataFrame([(2, 3, 91.0, "v"), (1, 2, 95.0, "v"), (1, 2, 90.0, "v")], "kept_id long, deleted_id long, similarity double, match_column string")
    assert rows_of(matching.resolved(chain).select("kept_id", "deleted_id", "similarity")) == [(1, 2, 95.0), (1, 3, 91.0)]
    round_ = spark.createDataFrame([(2, 1, 9.0, "v"), (1, 2, 9.0, "v"), (3, 3, 9.0, "v")], "kept_id long, deleted_id long, similarity double, match_column string")
    assert rows_of(matching.resolved(round_).select("kept_id", "deleted_id")) == [(1, 2)]
    assert matching.merge_groups(df, pairs.limit(0))[0].count() == 6
