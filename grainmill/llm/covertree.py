"""Exact cosine links by cover trees and dual traversal of their nodes.

Unit vectors at cosine c stand sqrt(2 - 2c) apart, so a cosine threshold is a distance.
Vectors of a label are dealt to blocks of bounded size by their nearest pivot; each
pair of blocks that pivot distances cannot rule out is compared by two cover trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import numbered
from .common import cut
from .graph import connected_components, forest

THRESHOLD = 0.98
#: Vectors of a block at most; a pair of blocks is one task's work.
BLOCK = 2048
PIVOTS = 32
#: Nodes of so many rows are not split any more; candidates for centers that are looked at together.
LEAF = 48
CHUNK = 64
#: Slack for rounding in the triangle inequality.
SLACK = 1e-9


@dataclass
class Level:
    """One level of a cover tree: centers (row numbers), exact covering radii, and each center's parent in the level above."""

    centers: np.ndarray
    radius: np.ndarray
    parent: np.ndarray


def _split(x: np.ndarray, rows: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray]:
    """(centers, the center's number for each of ``rows``): each row goes to the first center that near.

    The first row is a center, and so is every row that no center before it is near.
    Distances are taken to ``CHUNK`` candidates at once, and only from rows still open.
    """
    centers, own, open_ = [], np.full(len(rows), -1), np.arange(len(rows))
    while len(open_):
        head = open_[:CHUNK]
        near = x[rows[open_]] @ x[rows[head]].T >= close
        taken = np.full(len(open_), -1)
        for k in range(len(head)):
            if taken[k] < 0:
                free = near[:, k] & (taken < 0)
                free[k] = True
                taken[free] = len(centers)
                centers.append(rows[head[k]])
        own[open_] = taken
        open_ = open_[taken < 0]
    return np.array(centers), own


def cover_tree(x: np.ndarray, least: float, leaf: int | None = None) -> tuple[list[Level], np.ndarray]:
    """Nested levels from radius 2 down by halves to ``least``, and each row's node in the last level.

    ``x``: unit vectors, a block's worth at most.  Centers of a level stay centers below
    it; every row of a node that was split is within the level's radius of its center,
    and centers of one parent are farther apart than it.  A node of ``leaf`` rows or
    fewer (``LEAF``) is not split; its radius says how far its rows reach.
    """
    leaf = LEAF if leaf is None else leaf
    node = np.zeros(len(x), np.int64)
    levels = [Level(np.zeros(1, np.int64), _far(x, np.zeros(1, np.int64), node, 1), np.zeros(1, np.int64))]
    scale = 2.0
    while scale > least:
        scale /= 2
        above, m = levels[-1], len(levels[-1].centers)
        size = np.bincount(node, minlength=m)
        if not ((size > leaf) & (above.radius > least)).any():
            break  # nothing below would be split
        order, ends = np.argsort(node, kind="stable"), np.cumsum(size)
        kids, split = np.ones(m, np.int64), {}
        for p in np.flatnonzero((size > leaf) & (above.radius > scale)):
            rows = order[ends[p] - size[p] : ends[p]]
            rows = np.concatenate([above.centers[p : p + 1], rows[rows != above.centers[p]]])
            split[p] = rows, *_split(x, rows, 1 - scale * scale / 2)  # the cosine at this distance
            kids[p] = len(split[p][1])
        first = np.cumsum(kids) - kids
        at, below = np.repeat(above.centers, kids), first[node]
        for p, (rows, centers, own) in split.items():
            at[first[p] : first[p] + kids[p]] = centers
            below[rows] = first[p] + own
        levels.append(Level(at, _far(x, at, below, len(at)), np.repeat(np.arange(m), kids)))
        node = below
    return levels, node


def _far(x: np.ndarray, centers: np.ndarray, node: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(m)
    np.maximum.at(out, node, np.sqrt(((x - x[centers[node]]) ** 2).sum(1)))
    return out


def _children(tree: list[Level], depth: int) -> tuple[Level, np.ndarray]:
    """A level, and where the children of each node of the level above begin in it; a tree that has ended stays."""
    if depth >= len(tree):
        return tree[-1], np.arange(len(tree[-1].centers) + 1)
    level = tree[depth]
    return level, np.concatenate([[0], np.cumsum(np.bincount(level.parent, minlength=len(tree[depth - 1].centers)))])


def dual_links(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Yields (i, j) arrays of rows with cosine >= threshold; ``b`` None: pairs within ``a``, each once.

    Rows must be unit vectors.  Node pairs are kept while the distance of their centers
    can be bridged by their covering radii and the threshold's distance.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    same = b is None
    tree_a, node_a = cover_tree(a, eps / 2)
    tree_b, node_b = (tree_a, node_a) if same else cover_tree(b, eps / 2)
    other = a if same else b
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(1, max(len(tree_a), len(tree_b))):
        (la, first_a), (lb, first_b) = _children(tree_a, depth), _children(tree_b, depth)
        out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # pairs of nodes that have one child each: side by side
        lone = (np.diff(first_a)[i] == 1) & (np.diff(first_b)[j] == 1)
        for lo in range(0, len(i), 1 << 16):
            u, v = (first[k[lo : lo + (1 << 16)][lone[lo : lo + (1 << 16)]]] for first, k in ((first_a, i), (first_b, j)))
            squared = 2 - 2 * np.einsum("nd,nd->n", a[la.centers[u]], other[lb.centers[v]])
            reach = la.radius[u] + lb.radius[v] + eps
            keep = squared <= reach * reach + SLACK
            out_i.append(u[keep])
            out_j.append(v[keep])
        for p, q in zip(i[~lone].tolist(), j[~lone].tolist(), strict=True):
            own, opposite = slice(first_a[p], first_a[p + 1]), slice(first_b[q], first_b[q + 1])
            squared = 2 - 2 * (a[la.centers[own]] @ other[lb.centers[opposite]].T)
            reach = la.radius[own][:, None] + lb.radius[opposite][None, :] + eps
            u, v = np.nonzero(squared <= reach * reach + SLACK)
            u, v = u + first_a[p], v + first_b[q]
            if same and p == q:
                u, v = u[u <= v], v[u <= v]
            out_i.append(u)
            out_j.append(v)
        i, j = np.concatenate(out_i), np.concatenate(out_j)
    rows_a, first_a = np.argsort(node_a, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(node_a, minlength=len(tree_a[-1].centers)))])
    rows_b, first_b = (rows_a, first_a) if same else (np.argsort(node_b, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(node_b, minlength=len(tree_b[-1].centers)))]))
    for p, q in zip(i, j, strict=True):
        left, right = rows_a[first_a[p] : first_a[p + 1]], rows_b[first_b[q] : first_b[q + 1]]
        for lo in range(0, len(left), 1024):
            part = left[lo : lo + 1024]
            u, v = np.nonzero(a[part] @ other[right].T >= threshold)
            u, v = part[u], right[v]
            if same and p == q:
                keep = u < v
                u, v = u[keep], v[keep]
            if len(u):
                yield u, v


def _pair_worker(threshold: float):
    """Links between two blocks, or within one, as counts per vector and a thinned set of links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["unit"].to_numpy())
        ids, copies = pdf["key"].to_numpy(), pdf["copies"].to_numpy()
        side = pdf["side"].to_numpy()
        if (side == 0).all():
            parts = [(np.arange(len(x)), None)]
        else:
            parts = [(np.flatnonzero(side == 1), np.flatnonzero(side == 2))]
        counts = np.zeros(len(x), np.int64)
        links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for left, right in parts:
            if not len(left) or (right is not None and not len(right)):
                continue
            for u, v in dual_links(x[left], None if right is None else x[right], threshold):
                u, v = left[u], (left if right is None else right)[v]
                np.add.at(counts, u, copies[v])
                np.add.at(counts, v, copies[u])
                child, root = forest(ids[u], ids[v])
                links_a.append(child)
                links_b.append(root)
            child, root = forest(np.concatenate(links_a), np.concatenate(links_b))
            links_a, links_b = [child], [root]
        linked = dict(zip(links_a[0].tolist(), links_b[0].tolist(), strict=True))
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"key": ids[hit], "n": counts[hit], "root": [linked.get(int(k), int(k)) for k in ids[hit]]})

    return run


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and not null and their cosine in double
    precision is at least the threshold.  Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, as do vectors of different lengths.
    Equal vectors of one label are compared once and counted as often as they stand.
    Rows with one vec_id are vectors of their own, as are rows without one: inside, vectors
    go by a number of each different one.  A row without a vec_id has the smallest of those it reaches, and is
    kept where there is none.  Other columns are ignored; an empty table gives no rows.
    """
    e = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(e, lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
    sound = F.col(label).isNotNull() & (F.size(e) > 0) & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.coalesce(sound, F.lit(False)).alias("sound"), e.alias("e"), norm.alias("norm"))
    unit = F.transform("e", lambda v: v / F.col("norm"))
    good = rows.where("sound").select("vec_id", "label", unit.alias("unit"))
    one = cut(numbered(good.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "key"))
    # pivots: a bounded sample, the same for all labels
    pivots = [r["unit"] for r in one.orderBy(F.xxhash64("vec_id"), "vec_id", "unit").limit(PIVOTS).select("unit").collect()]
    dim = len(pivots[0]) if pivots else 0
    at = np.array([p for p in pivots if len(p) == dim], dtype=float).reshape(-1, max(dim, 1))

    def place(batches):
        for pdf in batches:
            far, cell = [], []
            for u in pdf["unit"]:
                d = np.sqrt(np.maximum(0, ((at - u) ** 2).sum(1))) if len(u) == at.shape[1] and len(at) else np.full(len(at), np.inf)
                far.append(d)
                cell.append(int(np.argmin(d)) if len(d) else 0)
            yield pd.DataFrame({"key": pdf["key"], "cell": np.array(cell, np.int32), "far": far})

    cells = one.select("key", "unit").mapInPandas(place, "key long, cell int, far array<double>")
    size = F.size("unit").alias("dim")
    placed = one.select("label", "key", "unit", "copies", size).join(cells, "key")
    # blocks of one label and length, filled cell by cell: at most `block` vectors each
    # so many salts that those of one cell hold some thousand vectors each, however large the table
    salts = max(64, one.count() // 4096)
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    counts = placed.groupBy("label", "dim", "cell", salt.alias("salt")).agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("label", "dim").orderBy("cell", "salt")
    packed = counts.withColumn("before", F.sum("n").over(in_order) - F.col("n"))
    slots = packed.select("label", "dim", "cell", "salt", "before")
    inner = Window.partitionBy("label", "dim", "cell", "salt").orderBy("key")
    dealt = placed.withColumn("salt", salt).join(slots, ["label", "dim", "cell", "salt"])
    blocks = cut(dealt.withColumn("block", F.floor((F.col("before") + F.row_number().over(inner) - 1) / block).cast("long")).select("label", "dim", "block", "key", "unit", "copies", "far"))
    k = len(at)
    bounds = blocks.groupBy("label", "dim", "block").agg(F.count("*").alias("n"), *[F.min(F.get("far", F.lit(n))).alias(f"lo{n}") for n in range(k)], *[F.max(F.get("far", F.lit(n))).alias(f"hi{n}") for n in range(k)])
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    p, q = bounds.alias("p"), bounds.alias("q")
    close = F.lit(True)
    for n in range(k):
        close = close & (F.col(f"p.lo{n}") <= F.col(f"q.hi{n}") + eps) & (F.col(f"q.lo{n}") <= F.col(f"p.hi{n}") + eps)
    pairs = p.join(q, F.expr("p.label <=> q.label and p.dim = q.dim and p.block <= q.block")).where(close).select(F.col("p.label").alias("label"), F.col("p.dim").alias("dim"), F.col("p.block").alias("bp"), F.col("q.block").alias("bq"))
    sides = pairs.select("label", "dim", "bp", "bq", F.explode(F.when(F.col("bp") == F.col("bq"), F.array(F.struct(F.col("bp").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("bp").alias("block"), F.lit(1).alias("side")), F.struct(F.col("bq").alias("block"), F.lit(2).alias("side"))))).alias("x"))
    work = sides.select("label", "dim", "bp", "bq", "x.*").join(blocks, ["label", "dim", "block"]).select("label", "dim", "bp", "bq", "side", "key", "unit", "copies")
    found = cut(work.groupBy("label", "dim", "bp", "bq").applyInPandas(_pair_worker(threshold), "key long, n long, root long"))
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("key"), "component")
    direct = found.groupBy("key").agg(F.sum("n").alias("n"))
    classes = cut(one.select("label", "unit", "key", "vec_id", "copies").join(direct, "key", "left").join(parts, "key", "left").select("label", "unit", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")))
    named = cut(classes.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    classes = classes.join(named, "component").select("label", "unit", "n_links", "component_id", F.lit(True).alias("linked"))
    whole = rows.select("vec_id", "label", F.when(F.col("sound"), unit).alias("unit"))
    joined = whole.join(classes, ["label", "unit"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
