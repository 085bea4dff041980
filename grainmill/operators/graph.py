"""Connected components of a link table, by rounds of joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ids import discard, spread, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id that the links join, with the smallest id of its tree (itself left out)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(ids))
    u, v = flat[: len(a)], flat[len(a) :]
    while True:
        pu, pv = parent[u], parent[v]
        low, high = np.minimum(pu, pv), np.maximum(pu, pv)
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while True:  # pointer jumping
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = u[open_], v[open_]
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    return ids[moved], ids[parent[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        child, root = forest(pdf["a"].to_numpy(), pdf["b"].to_numpy())
        yield pd.DataFrame({"a": child, "b": root})


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links(a, b)``; component is the smallest id reachable.

    Large-star and small-star rounds: each keeps the number of links and about halves
    the depth of the trees.  Links are first contracted batch by batch, which drops
    those that close cycles.  A row with a null end or with equal ends is no link; an
    empty table gives an empty one.  No round groups a node's neighbours in memory.
    Every round's links are written once; the tables before are removed.
    """
    clean = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    edges = stored(clean.mapInPandas(_contract, "a long, b long").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        # large star: the larger end of a link goes to the smallest neighbour of its smaller end, or to that end
        # written first, so that the join can split the links of a large component's root
        low = stored(edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")))
        big = edges.join(spread(low), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: all smaller neighbours of a node, and the node, go to the smallest of them
        big = stored(big)
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(spread(least), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        rooted = stored(small.select("e.*").where("a > b").distinct())
        discard(edges, low, big)
        edges = rooted
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
