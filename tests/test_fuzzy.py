"""The index of rare characters finds every pair that a product finds."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.functions.similarity import jaro_winkler
from grainmill.operators import fuzzy, matching
from grainmill.operators.ids import ROW_ID


def words(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéß漢 1") for _ in range(rng.randrange(1, 14))) for _ in range(n // 5)]
    out = set(stems) | {"a", "aa", "aaa", "aaaa", "aaaaa", "martha", "marhta", "dixon", "dicksonx"}
    while len(out) < n:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "1", "é"])
        out.add("".join(w) or "x")
    return sorted(out)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.7, 0.72, 0.85, 0.9, 0.97, 1.0])
def test_all_pairs_are_found(spark, least):
    values = words(int(least * 100), 150)
    got = fuzzy.similar_pairs(spark.createDataFrame([("ALL", v) for v in values], "block string, value string"), least).collect()
    want = {(u, v): s for i, u in enumerate(values) for v in values[i + 1 :] if (s := jaro_winkler(u, v)) >= least}
    assert len(got) == len(want) and {(r["u"], r["v"]): r["similarity"] for r in got} == want


def test_blocks_stay_apart_and_candidates_are_few(spark):
    values = words(5, 300)
    two = spark.createDataFrame([(b, v) for b in "xy" for v in values], "block string, value string")
    found = fuzzy.similar_pairs(two, 0.9)
    per = {r["block"]: r["count"] for r in found.groupBy("block").count().collect()}
    assert per["x"] == per["y"] > 0
    assert fuzzy.candidates(two, 0.9).count() < 300 * 299 / 8  # of 300 * 299 pairs


def test_rows_of_equal_blank_and_null_values(spark):
    rows = [(1, "Ann"), (2, "ann"), (3, None), (4, " "), (5, "ANN"), (6, "Bob")]
    got = matching.find_duplicates(spark.createDataFrame(rows, f"{ROW_ID} long, v string"), "v", "none", maybe=90.0)
    assert sorted((r["a_row_id"], r["b_row_id"], r["similarity"]) for r in got.collect()) == [(1, 2, 100.0), (1, 5, 100.0), (2, 5, 100.0)]
    assert matching.find_duplicates(spark.createDataFrame([], f"{ROW_ID} long, v string"), "v", "none").where(F.lit(True)).count() == 0
