"""Centroid clustering of integer vectors by rounds of assignment, each with an exponion search.

A vector carries, from round to round, an upper bound of the distance to its own centroid
and a lower bound of that to any other.  Where the bounds do not settle it, only the
centroids inside a ball around the vector's own centroid are looked at, as the sorted
lists of distances between centroids give them: with radius ``2 u + s`` (``u``: upper
bound, ``s``: distance to the next centroid) the ball holds the nearest and the second
nearest.  The radius is inclusive, so centroids at equal distance are all compared and
the smaller number wins.  Distances are whole numbers; only bounds are floating point,
rounded to the safe side.

The vectors stay on executors: a round is a pass that writes them with their bounds, and
sums by centroid.  The driver holds the centroids alone, ``k`` times the dimension.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Components below this size make squared distances of up to 2**8 dimensions that a long holds.
SMALL = 2**27
LONG = 2**63 - 1
#: How far bounds are moved to the safe side: far more than what rounding can do.
SLACK = 1e-9

STATE = "vec_id long, q array<double>, a int, u double, l double"


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, q): vectors of ``dims`` finite components, each component x as floor(256 * x).

    Null vectors, other lengths, and null or non-finite components are left out, and so is
    a component whose 256-fold no double holds.
    """
    (name,) = fresh(vectors, "q")
    scaled = F.transform(F.col("embedding"), lambda x: x.cast("double") * 256)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias(name)).where(F.size(name) == dims)
    sound = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["vec_id", "q"])

    return rows.where(sound).mapInArrow(floors, "vec_id long, q array<double>")


def matrix(column: pa.Array, dims: int, limit: int) -> np.ndarray:
    """Rows of whole numbers: 64-bit ones where all are below ``SMALL``, else Python's own."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if limit < SMALL and (not flat.size or np.abs(flat).max() < SMALL):
        return flat.astype(np.int64)
    return np.array([[int(x) for x in row] for row in flat], dtype=object).reshape(-1, dims)


def root(n: int) -> float:
    """Square root of a whole number; infinite where no double holds it."""
    if n < 2**1000:
        return math.sqrt(n)
    n = math.isqrt(n)
    return float(n) if n < 2**1023 else math.inf


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) if squares.dtype == np.int64 else np.array([root(n) for n in squares], dtype=np.float64)


class Ball:
    """Centroids with, for each of them, the others in order of their distance."""

    def __init__(self, centers: list[list[int]]):
        self.limit = max((abs(x) for c in centers for x in c), default=0)
        self.centers = np.array(centers, dtype=np.int64 if self.limit < SMALL else object)
        k = len(centers)
        between = np.empty((k, k))
        for j in range(k):
            between[j] = roots(((self.centers - self.centers[j]) ** 2).sum(1))
        order = np.argsort(between, axis=1, kind="stable")
        self.order = np.array([row[row != j] for j, row in enumerate(order)], dtype=np.int64).reshape(k, k - 1)
        self.lists = np.take_along_axis(between, self.order, 1)
        self.nearest = self.lists[:, 0] if k > 1 else np.full(k, np.inf)

    def squares(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Squared distance of each row to its centroid."""
        c = self.centers if x.dtype == self.centers.dtype else self.centers.astype(object)
        return ((x - c[a]) ** 2).sum(1) if len(x) else np.zeros(0, np.int64)

    def assign(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, l: np.ndarray) -> int:
        """Put nearest centroids into ``a`` and bounds into ``u`` and ``l``; returns how many distances were taken."""
        half = self.nearest[a] / 2 * (1 - SLACK)
        open_ = np.flatnonzero(u >= np.maximum(l, half))
        best = self.squares(x[open_], a[open_])
        u[open_] = roots(best) * (1 + SLACK) + SLACK
        taken = len(open_)
        unsettled = u[open_] >= np.maximum(l[open_], half[open_])
        rows, best = open_[unsettled], best[unsettled]
        own = a[rows].copy()
        radius = (2 * u[rows] + self.nearest[own]) * (1 + SLACK) + SLACK
        reach = np.empty(len(rows), dtype=np.int64)
        for j in np.unique(own):
            reach[own == j] = np.searchsorted(self.lists[j], radius[own == j], side="right")
        second = np.full(len(rows), np.inf)
        found = own.copy()
        for step in range(int(reach.max()) if len(rows) else 0):
            at = np.flatnonzero(reach > step)
            other = self.order[own[at], step]
            d = self.squares(x[rows[at]], other)
            taken += len(at)
            wins = (d < best[at]) | ((d == best[at]) & (other < found[at]))
            second[at] = np.minimum(second[at], roots(np.where(wins, best[at], d)))
            best[at[wins]], found[at[wins]] = d[wins], other[wins]
        a[rows] = found
        u[rows] = roots(best) * (1 + SLACK) + SLACK
        l[rows] = np.where(np.isfinite(second), np.maximum(second * (1 - SLACK) - SLACK, 0), 0)
        return taken


def drift(before: list[list[int]], after: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid has moved, and the furthest that any other one has."""
    moved = np.array([root(sum((x - y) ** 2 for x, y in zip(b, c, strict=True))) for b, c in zip(before, after, strict=True)]) * (1 + SLACK)
    others = np.array([max([0.0, *np.delete(moved, j)]) for j in range(len(moved))])
    return moved, others


def _assigned(table: DataFrame, centers: list[list[int]], dims: int, last: list[list[int]] | None) -> DataFrame:
    """``table`` with the nearest of ``centers``; ``last``: the centroids that its bounds are of, None where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centers)
        moved = drift(last, centers) if last else None
        for b in batches:
            x = matrix(b.column("q"), dims, ball.limit)
            if moved:
                a = b.column("a").to_numpy(zero_copy_only=False).astype(np.int64)
                u = (b.column("u").to_numpy(zero_copy_only=False) + moved[0][a]) * (1 + SLACK)
                l = np.maximum((b.column("l").to_numpy(zero_copy_only=False) - moved[1][a]) * (1 - SLACK), 0)
            else:
                a, u, l = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            ball.assign(x, a, u, l)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(a.astype(np.int32)), pa.array(u), pa.array(l)], ["vec_id", "q", "a", "u", "l"])

    return table.mapInArrow(run, STATE)


def limbs(n: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a whole number to the base 2**32, its sign on every digit."""
    sign, n, place = (-1 if n < 0 else 1), abs(n), 0
    while n:
        n, digit = divmod(n, 2**32)
        if digit:
            yield place, sign * digit
        place += 1


def _sums(table: DataFrame, dims: int) -> dict[int, list[int]]:
    """By centroid: the exact sums of the components, and the number of vectors last.

    Each task adds up what it reads; digits are summed by Spark, so no sum overflows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for b in batches:
            x, a = matrix(b.column("q"), dims, 0), b.column("a").to_numpy(zero_copy_only=False)
            for c in np.unique(a):
                own = x[a == c]
                old = totals.get(int(c), [0] * (dims + 1))
                totals[int(c)] = [o + int(s) for o, s in zip(old, [*own.sum(0), len(own)], strict=True)]
        rows = [(c, i, place, digit) for c, t in totals.items() for i, n in enumerate(t) for place, digit in limbs(n)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], ["c", "i", "place", "digit"])

    parts = table.select("a", "q").mapInArrow(run, "c long, i long, place long, digit long").groupBy("c", "i", "place").agg(F.sum("digit").alias("digit"))
    out: dict[int, list[int]] = {}
    for c, i, place, digit in parts.collect():  # centroids times components, however many vectors there are
        out.setdefault(c, [0] * (dims + 1))[i] += digit << (32 * place)
    return out


def first_centers(table: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest digests of ``seed:vec_id``; ties by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = table.select(digest.alias("digest"), "q").orderBy(F.col("digest").asc_nulls_last(), "q").limit(k).collect()
    return [[int(x) for x in r["q"]] for r in rows]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector kept.

    ``vectors(vec_id, embedding)``; other columns are of no account, whatever their names.
    After ``rounds`` of assigning and replacing non-empty centroids by the floors of their
    vectors' means, all vectors are assigned once more.  With fewer vectors than ``k`` each
    starts a cluster, equal ones and repeated or null ids included (equal centroids: the
    smaller number takes the vectors, the other stays empty and where it was); without any
    the result is empty.  A distance or an inertia that a long can't hold is null; sums and
    comparisons are exact even then.
    """
    spark = vectors.sparkSession
    table = cut(kept(vectors, dims))
    centers = first_centers(table, k, seed)
    last = None
    for _ in range(rounds if centers else 0):
        table = cut(_assigned(table, centers, dims, last), table)
        sums = _sums(table, dims)
        last, centers = centers, [[s // sums[j][-1] for s in sums[j][:-1]] if j in sums else c for j, c in enumerate(centers)]

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(centers)
        for b in batches:
            a = b.column("a").to_numpy(zero_copy_only=False).astype(np.int64)
            d = [int(x) if x <= LONG else None for x in ball.squares(matrix(b.column("q"), dims, ball.limit), a)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("a"), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    if not centers:
        found = table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = _assigned(table, centers, dims, last).mapInArrow(distances, "vec_id long, cluster int, distance long")
    found = cut(found, table)
    exact = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}  # at most k rows
    long = lambda x: None if x is None or x > LONG else int(x)
    whole = None if None in each.values() else long(sum(each.values()))
    told = [(j, long(each.get(j, 0)), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centers)]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: k rows


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT q, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, q, best.c AS c, best.d AS d FROM (SELECT vec_id, any_value(vq) AS q, min({{'d': d, 'c': c}}) AS best FROM (SELECT v.vec_id, v.q AS vq, c.c, {square} AS d FROM v, c{r} c) GROUP BY vec_id))")
        if r < rounds:
            floors = "(s - ((s % n) + n) % n) // n"
            parts.append(f"m{r} AS MATERIALIZED (SELECT c, list(({floors})::BIGINT ORDER BY i) AS q FROM (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)")
    end = f"SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"
    return f"WITH {', '.join(parts)} {end}"


ORACLE_SQL = _sql()
