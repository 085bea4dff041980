"""A trie of conversations: every common beginning of turns is a node.

Turns are told apart by 64-bit digests, beginnings by the value of a polynomial in them,
modulo two primes, whose running sums numpy scans give a block of depths at a time.  Equal
values only make candidates: every turn of a group is held against that of the group's
representative, its smallest conversation, text by text unless both are the same row, and
so is the group it came from; what differs becomes a group of its own.

Sums over subtrees need no walk up the tree.  A node belongs to the smallest conversation
that passes through it, so each conversation owns one stretch of its path, down to its
end.  The subtree of a node is what its members own, without the part of the
representative's stretch above the node: one sum over members, one running sum.

No conversation, however long, is worked on in one piece: places of turns come from ranges
of all rows, running sums go by blocks of depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import numbered
from .common import bounded, cut

#: Two primes below 2**31, and bases modulo them.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1020353825)
#: Depths that are scanned together.
BLOCK = 4096
#: Ids of one slice of an end's list: as many bits.
SLICE_BITS = 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, role, text, digest, chars): the turns of every conversation, numbered from 1 on.

    They are ordered by turn, null first, then role and text; null roles and texts are
    empty.  Rows without a conversation are left out.
    """
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").isNotNull().alias("_has"), F.col("turn").alias("_turn"), c("role").alias("role"), c("text").alias("text"))
    ordered = numbered(rows, "_n", ["conv", "_has", "_turn", "role", "text"])
    first = cut(ordered.groupBy("conv").agg(F.min("_n").alias("_first")))
    digest = F.xxhash64("role", F.lit("\x00"), "text")
    return ordered.join(first, "conv").select("conv", (F.col("_n") - F.col("_first") + 1).alias("pos"), "role", "text", digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from another."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, src_conv, src_pos, digest, chars) of the rebuilt conversations, and (conv, length).

    The first turns of conversation ``c - c % 100``, then one's own after as many.
    """
    sizes = cut(own.groupBy("conv").agg(F.count("*").alias("n")))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    wants = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % 100).alias("base"), borrowed(F.col("conv")).alias("h")).join(base, "base", "left")
    plan = cut(wants.select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("got"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("rest")))
    slim = own.select(F.col("conv").alias("src_conv"), F.col("pos").alias("src_pos"), "digest", "chars")
    # at most 199 conversations take from one, and five turns each
    head = slim.where("src_conv % 100 = 0 and src_pos <= 5").join(plan.where("got > 0"), (F.col("src_conv") == F.col("base")) & (F.col("src_pos") <= F.col("got")))
    tail = slim.join(plan.where("rest > 0"), F.col("src_conv") == F.col("conv")).where("src_pos > h")
    columns = ["conv", "src_conv", "src_pos", "digest", "chars"]
    rows = head.select(*columns, F.col("src_pos").alias("depth")).unionByName(tail.select(*columns, (F.col("src_pos") - F.col("h") + F.col("got")).alias("depth")))
    return rows, plan.select("conv", (F.col("got") + F.col("rest")).alias("length"))


def running(df: DataFrame, value: str, name: str, order: str = "depth") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its conversation before this one, by blocks of ``order``."""
    block = F.floor(F.col(order) / BLOCK).cast("long")
    marked = df.withColumn("_block", block)
    inside = F.sum(value).over(Window.partitionBy("conv", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    if df.where(F.col(order) >= BLOCK).isEmpty():
        return marked.withColumn(name, F.coalesce(inside, F.lit(0))).drop("_block")
    sums = marked.groupBy("conv", "_block").agg(F.sum(value).alias("_sum"))
    before = cut(sums.select("conv", "_block", F.coalesce(F.sum("_sum").over(Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    return marked.withColumn(name, F.coalesce(inside, F.lit(0))).join(before, ["conv", "_block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def fingerprints(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``rows`` with ``f1`` and ``f2``: the values, modulo each prime, of the polynomial in the turns up to this one."""
    columns = ["conv", "depth", "src_conv", "src_pos", "chars", "digest"]
    kinds = "conv long, depth long, src_conv long, src_pos long, chars long, f1 long, f2 long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for p, base in zip(primes, BASES, strict=True):
            table = np.ones(BLOCK, dtype=np.int64)
            for i in range(1, BLOCK):
                table[i] = table[i - 1] * (base % p) % p
            tables.append(table)
        carry_of, carry = None, (0, 0)
        for b in batches:
            if not b.num_rows:
                continue
            conv, depth, digest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("conv", "depth", "digest"))
            block, place = depth // BLOCK, depth % BLOCK
            new = np.concatenate([[True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])
            start = np.flatnonzero(new)
            goes_on = carry_of == (conv[0], block[0])
            sums = []
            for k, (p, base, table) in enumerate(zip(primes, BASES, tables, strict=True)):
                turn = (digest.view(np.uint64) >> np.uint64(31 * k)).astype(np.int64) & (2**33 - 1)
                blocks, which = np.unique(block, return_inverse=True)
                shift = np.array([pow(base, int(x) * BLOCK, p) for x in blocks], dtype=np.int64)[which]
                term = (turn % p) * (table[place] * shift % p) % p
                total = np.cumsum(term)  # below 2**31 each, and a batch has fewer than 2**32 rows
                before = np.repeat(total[start] - term[start], np.diff(np.append(start, len(conv))))
                value = total - before
                if goes_on:
                    value[: start[1] if len(start) > 1 else None] += carry[k]
                sums.append(value % p)
            carry_of, carry = (conv[-1], block[-1]), (int(sums[0][-1]), int(sums[1][-1]))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns[:5]] + [pa.array(s) for s in sums], [*columns[:5], "f1", "f2"])

    block = F.floor(F.col("depth") / BLOCK)
    dealt = rows.select(*columns, block.alias("_block")).repartition("conv", "_block").sortWithinPartitions("conv", "depth").select(*columns)
    found = cut(dealt.mapInArrow(scan, kinds))
    if found.where(F.col("depth") >= BLOCK).isEmpty():
        return found
    # the value at the end of each block goes on into all later ones
    ends = found.where((F.col("depth") + 1) % BLOCK == 0).select("conv", (F.floor(F.col("depth") / BLOCK) + 1).alias("_block"), "f1", "f2")
    over = Window.partitionBy("conv").orderBy("_block")
    carried = cut(ends.select("conv", "_block", F.sum("f1").over(over).alias("_c1"), F.sum("f2").over(over).alias("_c2")))
    joined = found.withColumn("_block", F.floor(F.col("depth") / BLOCK)).join(carried, ["conv", "_block"], "left")
    return cut(joined.select(*[c for c in found.columns if c not in ("f1", "f2")], *[((F.col(f"f{k}") + F.coalesce(f"_c{k}", F.lit(0))) % p).alias(f"f{k}") for k, p in ((1, primes[0]), (2, primes[1]))]), found)


def verified(found: DataFrame, own: DataFrame) -> DataFrame:
    """(conv, depth, src_conv, src_pos, chars, rep): ``rep`` is the smallest conversation of the turn's exact group.

    Groups are those of equal depth and fingerprints.  A row belongs to its group if its
    turn is the representative's and both came from one group; a group where some row does
    not is split by text and origin, and all is looked at again, as groups below may have
    to follow.  Without collisions that is one look; a collision costs one for each turn
    that its conversations have in common afterwards.
    """
    rows = cut(found.withColumn("split", F.lit(0).cast("long")))
    key = ["depth", "f1", "f2", "split"]
    text = own.select(F.col("conv").alias("src_conv"), F.col("pos").alias("src_pos"), F.struct("role", "text").alias("said"))
    while True:
        # the group's first row by conversation; a group is a row here, however many members it has
        groups = cut(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("conv", "src_conv", "src_pos")).alias("rep")))
        named = cut(rows.join(groups.select(*key, "n", F.col("rep.conv").alias("rep"), F.col("rep.src_conv").alias("rep_src"), F.col("rep.src_pos").alias("rep_pos")), key))
        up = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("from"))
        several = named.where("n > 1 and conv <> rep")
        # the representative's own origin, a row for each group of several
        origin = named.where("n > 1 and conv = rep").join(up, ["conv", "depth"], "left").select(*key, F.col("from").alias("rep_from"))
        told = several.join(up, ["conv", "depth"], "left").join(origin, key)
        strayed = ~F.col("from").eqNullSafe(F.col("rep_from"))
        other = told.where("src_conv <> rep_src or src_pos <> rep_pos")
        rep_text = text.select(F.col("src_conv").alias("rep_src"), F.col("src_pos").alias("rep_pos"), F.col("said").alias("rep_said"))
        read = other.select("conv", "depth", "src_conv", "src_pos", "rep_src", "rep_pos").join(text, ["src_conv", "src_pos"]).join(rep_text, ["rep_src", "rep_pos"])
        unlike = read.where("said <> rep_said").select("conv", "depth")
        bad = cut(told.where(strayed).select("conv", "depth").unionByName(unlike).distinct())
        if bad.isEmpty():
            return named.select("conv", "depth", "src_conv", "src_pos", "chars", "rep")
        broken = cut(named.join(bad, ["conv", "depth"], "left_semi").select(*key).distinct())
        inside = named.join(broken, key, "left_semi").join(text, ["src_conv", "src_pos"]).join(up, ["conv", "depth"], "left")
        parts = [*key, "said", "from"]
        least = inside.groupBy(*parts).agg(F.min("conv").alias("_new")).withColumnsRenamed({c: f"_{c}" for c in parts})
        new = cut(inside.join(least, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts])).select("conv", "depth", "_new"))
        rows = cut(rows.join(new, ["conv", "depth"], "left").withColumn("split", F.coalesce("_new", "split")).drop("_new"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of ``ends(rep, depth, conv)``: SHA-256 of the ids in order, comma-joined.

    Ids are put in order a slice of ``2 ** SLICE_BITS`` at a time.  A digest takes its bytes one after
    the other, so one task has the slices of a node pass by, holding one at a time.
    """
    slices = ends.groupBy("rep", "depth", F.shiftright("conv", SLICE_BITS).alias("slice")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    joined = slices.select("rep", "depth", "slice", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = bounded(joined).repartition("rep", "depth").sortWithinPartitions("rep", "depth", "slice").select("rep", "depth", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["rep", "depth", "ends_sha256"])
        for b in batches:
            for rep, depth, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if node != (rep, depth):
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) >= 10_000:
                yield made()
                out = []
        if node:
            out.append((*node, sha.hexdigest()))
        if out:
            yield made()

    return dealt.mapInArrow(digest, "rep long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations(conv_id, turn, role, text)``; other columns are of no account, whatever
    their names.  A node is told by its smallest member and its depth; the root has depth 0
    and no parent.  Equal turns of a conversation keep both places; an empty table gives no
    nodes; conversations without a turn end at the root.  ``saved_tokens`` counts code points.
    """
    own = cut(turns(conversations))
    rows, lengths = rebuilt(own)
    lengths = cut(lengths)
    found = cut(verified(fingerprints(rows, primes), own).select("conv", "depth", "chars", "rep"))
    least = lengths.agg(F.min("conv")).first()[0]
    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit(least).cast("long").alias("rep"))
    paths = cut(found.unionByName(root), found)
    counted = paths.groupBy("rep", "depth").agg(F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    # a node's parent is its representative's turn before
    above = paths.where("conv <> rep").select(F.col("conv").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "rep"))
    nodes = cut(counted.join(above, ["rep", "depth"], "left").select("rep", "depth", "n_convs", parent.alias("parent"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["rep", "depth"], "left").na.fill(0, ["n_children"]), nodes)
    holds = cut(nodes.groupBy(F.col("rep").alias("conv")).agg(F.sum("saved").alias("owns"), F.count_if(F.col("n_children") == 0).alias("leaves")))
    subtree = paths.join(holds, "conv").groupBy("rep", "depth").agg(F.sum("owns").alias("owns"), F.sum("leaves").alias("n_leaves"))
    ends = paths.join(lengths, "conv").where("depth = length").select("rep", "depth", "conv")
    over = running(nodes.withColumnRenamed("rep", "conv"), "saved", "above").withColumnRenamed("conv", "rep")
    whole = over.join(subtree, ["rep", "depth"]).join(end_digests(ends), ["rep", "depth"], "left")
    return whole.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("owns") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 bit by bit over the decimal signs; prefixes as lists of turns.
ORACLE_SQL = """WITH o AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS MATERIALIZED (SELECT c, list(x ORDER BY pos) AS l, xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM o GROUP BY c),
r AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS s FROM l a LEFT JOIN l b ON b.c = a.c - a.c % 100),
p AS MATERIALIZED (SELECT c, d, len(s) AS n, s[1:d] AS p FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
g AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS MATERIALIZED (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN g.d > 0 THEN (n_convs - 1) * length(g.p[-1].t) ELSE 0 END AS saved FROM g LEFT JOIN k ON k.p = g.p AND k.d = g.d),
s AS (SELECT p[1:e] AS p, e AS d, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS e FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.p = w.p AND s.d = w.d LEFT JOIN g u ON u.d = w.d - 1 AND u.p = w.p[1:w.d - 1]"""
