"""Exponion clustering against plain assignment of every vector to every centroid."""

import hashlib
import math

import numpy as np
import pytest

from grainmill.llm import exponion

SCHEMA = "vec_id long, embedding array<double>, q string, cluster int, label int"


def plain(rows, k, rounds, dims, seed=2):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of each row, with Python's whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centers[j] = [sum(x) // len(g) for x in zip(*g)]
    last = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, j in last:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    whole = sum(sums.values())
    long = lambda x: x if x < 2**63 else None
    return sorted([(i, j, long(d), long(sums[j]) if all(e < 2**63 for _, e, m in last if m == j) else None, long(whole), digest[j]) for i, d, j in last], key=str)


def given(spark, rows):
    return spark.createDataFrame([(i, e, "x", 3, None) for i, e in rows], SCHEMA)


def check(spark, rows, k, rounds, dims):
    got = sorted([tuple(r) for r in exponion.cluster(given(spark, rows), k, rounds, dims).collect()], key=str)
    assert got == plain(rows, k, rounds, dims)
    return got


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(9, 6))
    rows = [(i, [float(x) for x in centers[i % 9] + rng.normal(scale=0.3, size=6)]) for i in range(400)]
    assert len(check(spark, rows, 7, 4, 6)) == 400


def test_ties_repeats_and_unsound_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(60)]  # many equal vectors and equal distances
    bad = [(60, None), (61, []), (62, [1.0]), (63, [1.0, None]), (64, [float("nan"), 0.0]), (65, [float("inf"), 0.0]), (66, [1.0, 2.0, 3.0])]
    twice = [(5, [0.5, 0.5]), (None, [2.5, 0.25]), (None, [-1.0, -2.0])]
    assert len(check(spark, grid + bad + twice, 8, 3, 2)) == 63


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0])], 40, 5, 2)
    check(spark, [(1, [0.25, -1.0])], 40, 5, 2)
    out = exponion.cluster(given(spark, [(1, None)]))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_numbers_beyond_longs(spark):
    rows = [(i, [float(i % 5) * 1e300, 1.0 - i]) for i in range(12)] + [(100 + i, [i * 2.0**24, 1.0]) for i in range(6)]
    got = check(spark, rows, 4, 3, 2)
    assert any(r[3] is None for r in got) and any(r[2] is not None for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_lose_the_nearest(seed):
    """Round after round, the search gives what a look at all centroids gives, and looks at fewer."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 40, size=(3000, 3)) if seed % 2 else (rng.integers(0, 6, size=(3000, 1)) * 60 + rng.integers(-9, 9, size=(3000, 3)))
    x = x.astype(np.int64)
    centers = [list(map(int, c)) for c in x[:25]]
    a, u, l = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    taken = 0
    for _ in range(8):
        ball = exponion.Ball(centers)
        taken += ball.assign(x, a, u, l)
        every = ((x[:, None, :] - np.array(centers)[None]) ** 2).sum(2)
        assert np.array_equal(a, every.argmin(1))
        new = [[int(s) // int((a == j).sum()) for s in x[a == j].sum(0)] if (a == j).any() else c for j, c in enumerate(centers)]
        moved, others = exponion.drift(centers, new)
        u, l, centers = u + moved[a], np.maximum(l - others[a], 0), new
    assert taken < 8 * 3000 * 25 * 0.8


def test_sums_of_digits():
    for n in (0, 1, -1, 2**32, -(2**70) + 5, 10**300):
        assert sum(d << (32 * p) for p, d in exponion.limbs(n)) == n
