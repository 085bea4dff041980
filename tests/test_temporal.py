"""As-of and interval joins against products of small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import temporal

L, R = "k string, t int, x int, _row int", "k string, t int, x int, at int"


def asof_plain(left, right, direction, exact, tolerance=None):
    out = []
    for row in left:
        k, t = row[:2]
        best = None
        for r in right:
            if k is None or t is None or r[0] != k or r[1] is None or (r[1] == t and not exact) or (tolerance is not None and abs(r[1] - t) > tolerance):
                continue
            if (direction == "backward" and r[1] > t) or (direction == "forward" and r[1] < t):
                continue
            rank = (-abs(r[1] - t), r[1] <= t, r[2])
            best = max(best, (rank, r)) if best else (rank, r)
        out.append((*row, *(best[1][1:] if best else (None, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", temporal.DIRECTIONS)
@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, direction, exact):
    rng = random.Random(direction)
    pick = lambda n: [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(30)]), i, i * 2) for i in range(n)]
    left, right = pick(150), pick(90)
    for tolerance in (None, 2):
        got = temporal.asof_join(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["k"], "t", direction=direction, exact=exact, tolerance=tolerance, order=["x"])
        assert got.columns == ["k", "t", "x", "_row", "t_right", "x_right", "at"]
        assert sorted([tuple(r) for r in got.collect()], key=str) == asof_plain(left, right, direction, exact, tolerance)


def test_asof_edges(spark):
    left, right = spark.createDataFrame([("a", 1, 1, 1)], L), spark.createDataFrame([("a", 1, 5, 6)], R)
    none = right.limit(0)
    assert [tuple(r) for r in temporal.asof_join(left, none, ["k"], "t").collect()] == [("a", 1, 1, 1, None, None, None)]
    assert temporal.asof_join(left, none, ["k"], "t", how="inner").count() == 0 and temporal.asof_join(left.limit(0), right, ["k"], "t").count() == 0
    assert [r["x_right"] for r in temporal.asof_join(left, right, [], "t").collect()] == [5]
    days = spark.createDataFrame([(dt.datetime(2024, 1, 2), 1)], "t timestamp, x int")
    before = spark.createDataFrame([(dt.datetime(2024, 1, 1), 7)], "t timestamp, y int")
    assert [r["y"] for r in temporal.asof_join(days, before, [], "t", tolerance=86400).collect()] == [7]
    assert [r["y"] for r in temporal.asof_join(days, before, [], "t", tolerance=86399).collect()] == [None]


@pytest.mark.parametrize("closed", [True, False])
def test_intervals(spark, closed):
    rng = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            lo = rng.randrange(-200, 200)
            out.append((rng.choice(["hot", "hot", "b", None]), lo if i % 17 else None, lo + rng.choice([-1, 0, 0, 1, 2, 4, 5, 16, 17, 64, 300, 4000]), i))
        return out

    left, right = some(140), some(140)
    got = temporal.interval_join(spark.createDataFrame(left, "k string, lo int, hi int, i int"), spark.createDataFrame(right, "k string, lo int, hi int, i int"), ["k"], ("lo", "hi"), ("lo", "hi"), closed)
    assert got.columns == ["k", "lo", "hi", "i", "lo_right", "hi_right", "i_right"]
    ok = lambda a: a[0] is not None and a[1] is not None and a[1] <= a[2]
    meet = (lambda a, b: a[1] <= b[2] and b[1] <= a[2]) if closed else (lambda a, b: a[1] < b[2] and b[1] < a[2])
    want = sorted((a[3], b[3]) for a in left for b in right if ok(a) and ok(b) and a[0] == b[0] and meet(a, b))
    assert sorted((r["i"], r["i_right"]) for r in got.collect()) == want


def test_points_in_ranges_of_numbers_and_times(spark):
    points = spark.createDataFrame([(0.5, 1), (1.0, 2), (-3.25, 3), (1e9, 4), (1e308, 5), (float("inf"), 6)], "v double, i int")
    ranges = spark.createDataFrame([(0.25, 1.0, "a"), (-1e10, 1e10, "b"), (1.0, 0.0, "none"), (float("-inf"), float("inf"), "all")], "lo double, hi double, n string")
    got = temporal.range_join(points, ranges, [], "v", ("lo", "hi")).select("i", "n").collect()
    assert sorted(map(tuple, got)) == sorted([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (4, "b")] + [(i, "all") for i in range(1, 7)])
    day = lambda d: dt.datetime(2024, 1, d)
    spans = spark.createDataFrame([(day(1), day(3), 1), (day(5), day(5), 2)], "lo timestamp, hi timestamp, i int")
    times = spark.createDataFrame([(day(3), 1), (day(4), 2), (day(5), 3)], "t timestamp, j int")
    assert sorted((r["j"], r["i"]) for r in temporal.range_join(times, spans, [], "t", ("lo", "hi")).collect()) == [(1, 1), (3, 2)]
    assert temporal.interval_join(spans.limit(0), spans, [], ("lo", "hi"), ("lo", "hi")).count() == 0
    assert spans.select(F.lit(1)).count() == 2
