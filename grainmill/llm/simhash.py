"""SimHash near-duplicates: blocks of candidates, each compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded, cut, discard, mix64, shingle_runs
from .graph import connected_components, forest

RADIUS = 3
#: Bit ranges of the five blocks of a fingerprint; two of them at least agree within the radius.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Buckets above this many distinct fingerprints are split by further bits.
HOT_BUCKET = 4096

#: What ``keep_one`` takes for near copies.
NEAR_WIDTH = 5
NEAR_SIMILARITY = 0.8
#: Blocks of candidates there: texts that agree in the smallest shingle hash under all functions of a band.
#: At similarity 0.8 two texts share one of the bands in 99.9 of 100 cases.
BANDS, ROWS = 18, 5
FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the 128 bits compared in a block 19 differ at similarity 0.8, with a standard deviation of 4.
NEAR_RADIUS = 38
#: Texts of a block at most; larger ones are dealt to several.
CROWDED = 2048


def count_bits(hashes: np.ndarray, row: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts[row]`` how often each bit is set; ``row`` ascends."""
    for lo in range(0, len(hashes), 1 << 16):
        part, own = hashes[lo : lo + (1 << 16)], row[lo : lo + (1 << 16)]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)


def prints(flat: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """SimHash of the word shingles of each row; no words: zero."""
    n = len(at) - 1
    counts, total = np.zeros((n, 64), dtype=np.int64), np.zeros(n, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for text, start, end, row in shingle_runs(flat, at, width):
        hashes = np.array([digest(text[s:e], 42) for s, e in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
        count_bits(hashes, row, counts)
        total += np.bincount(row, minlength=n)
    return np.packbits((2 * counts > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text; no words: zero."""
    return int(prints(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), width)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the signed view of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = prints(*as_bytes(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 fingerprints to a word; ``fps``: one or more words each."""
    fps = np.ascontiguousarray(fps).reshape(len(fps), -1)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    padded = np.zeros((64 * fps.shape[1], -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def within(queries: np.ndarray, block: np.ndarray, n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) at most ``radius`` bits apart; ``block``: planes of n members.

    Carry-save counter planes count differing bits of all members at once.  They start
    so far up that a count beyond the radius runs over, which one more plane keeps.
    The scan over bit planes stops as soon as every member has run over for every query.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    queries = queries.reshape(len(queries), -1)
    shape = (len(queries), block.shape[1])
    depth = int(radius).bit_length() or 1
    start = (1 << depth) - 1 - radius
    counter = [np.full(shape, full if start >> k & 1 else 0, dtype=np.uint64) for k in range(depth)]
    over = np.zeros(shape, dtype=np.uint64)
    for b in range(64 * queries.shape[1]):
        flip = np.where((queries[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1), full, np.uint64(0))
        carry = block[b][None, :] ^ flip[:, None]
        for k in range(depth):
            kept = counter[k] ^ carry
            carry &= counter[k]
            counter[k] = kept
        over |= carry
        if b % 8 == 7 and b > radius and (over == full).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = np.unpackbits((~over).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n]
    return np.nonzero(hits)


def small_pairs(fp: np.ndarray, bounds: np.ndarray, most: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius in buckets of at most ``most`` rows, all of them side by side: row i and row i + d."""
    sizes = np.diff(bounds)
    rows = np.flatnonzero(np.repeat((sizes <= most) & (sizes > 1), sizes))
    left = (np.repeat(bounds[1:], sizes) - np.arange(len(fp)))[rows]  # rows from here to the bucket's end
    words = 1 if fp.ndim == 1 else fp.shape[1]
    for d in range(1, most):
        rows, left = rows[left > d], left[left > d]
        if not len(rows):
            break
        _, hit = within(np.zeros((1, words), np.uint64), planes(fp[rows] ^ fp[rows + d]), len(rows), radius)
        yield rows[hit], rows[hit] + d


def bucket_links(fp: np.ndarray, rep: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of each bucket ``[bounds[i], bounds[i+1])``, thinned to trees."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in small_pairs(fp, bounds, 16, radius):
        out_a.append(rep[i])
        out_b.append(rep[j])
    for i in np.flatnonzero(np.diff(bounds) > 16):
        own, ids = fp[bounds[i] : bounds[i + 1]], rep[bounds[i] : bounds[i + 1]]
        for lo in range(0, len(own), 4096):
            block, n = planes(own[lo : lo + 4096]), min(4096, len(own) - lo)
            for q in range(0, min(len(own), lo + n), 256):
                a, b = within(own[q : q + 256], block, n, radius)
                keep = a + q < b + lo
                out_a.append(ids[a[keep] + q])
                out_b.append(ids[b[keep] + lo])
            if sum(map(len, out_a)) > 1_000_000:
                a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b = [a], [b]
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def whole_buckets(batches: Iterator[pd.DataFrame], least: int = 10_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches sorted by key, cut between buckets, of ``least`` rows and more, with the buckets' bounds."""
    held: list[pd.DataFrame] = []
    size = 0

    def out(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pd.concat(parts, ignore_index=True)
        key = pdf["key"].to_numpy()
        return pdf, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])

    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        at = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if size + at >= least and (at or held[-1]["key"].iloc[-1] != key[-1]):
            yield out([*held, pdf.iloc[:at]])
            held, size = [], 0
            pdf = pdf.iloc[at:]
        held.append(pdf)
        size += len(pdf)
    if held:
        yield out(held)


def _linker(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in whole_buckets(batches):
            a, b = bucket_links(pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), bounds, radius)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def _bits(lo: int, hi: int):
    return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def near_links(reps: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) that join every two fingerprints of ``reps(fp, rep)`` within the radius, thinned to trees.

    Fingerprints within three bits agree on two of five blocks, so each goes to ten
    buckets.  A bucket of more than ``hot`` fingerprints is dealt again by four parts
    of its other bits, one of which must agree too; nothing is dropped.
    """
    if radius > RADIUS:
        raise ValueError("the five blocks hold for at most three differing bits")
    pairs = list(combinations(range(5), 2))
    keys = [F.xxhash64(F.lit(n), _bits(*BLOCKS[i]), _bits(*BLOCKS[j])) for n, (i, j) in enumerate(pairs)]
    rows = reps.select("fp", "rep", F.posexplode(F.array(*keys)).alias("pair", "key"))
    # written before it is joined, so that the rows of a hot key can be split in the join
    crowded = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot")))
    marked = rows.join(crowded, "key", "left")
    split = None
    for n, (i, j) in enumerate(pairs):
        free = [b for k, (lo, hi) in enumerate(BLOCKS) if k not in (i, j) for b in range(lo, hi)]
        parts = []
        for p in range(4):
            mask = sum(1 << b for b in free[p::4])
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            parts.append(F.xxhash64(F.col("key"), F.lit(p), F.col("fp").bitwiseAND(F.lit(signed))))
        split = F.when(F.col("pair") == n, F.array(*parts)) if split is None else split.when(F.col("pair") == n, F.array(*parts))
    dealt = marked.select("fp", "rep", F.explode(F.when(F.col("hot"), split).otherwise(F.array("key"))).alias("key"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(_linker(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Exact fingerprint copies collapse to their smallest doc_id before any comparison,
    so a group of copies costs one row however large it is.  Null and empty texts have
    fingerprint zero and are linked like any other; rows with the same doc_id stay
    apart; other columns of ``docs`` are ignored; an empty table gives no rows.  A row
    whose doc_id is null takes the component of its fingerprint.  Texts of any length are
    read a slice at a time.
    """
    found = cut(fingerprints(docs, width))
    reps = cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    parts = connected_components(near_links(reps, radius, hot))
    owner = cut(reps.join(parts, reps["rep"] == parts["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return found.join(owner, "fp", "left").select("doc_id", "fp", "component_id")


def signatures(flat: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each row: a digest of its words, 128 bits of SimHash, the keys of its bands, and its set of shingles.

    Digest and bits are two words each; the set holds 32 bits of each shingle's hash.
    Rows without words have no keys that mean anything, and an empty set.
    """
    n = len(at) - 1
    counts, total = np.zeros((n, 128), dtype=np.int64), np.zeros(n, dtype=np.int64)
    least = np.full((n, BANDS * ROWS), np.iinfo(np.uint64).max, dtype=np.uint64)
    sets: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    order = [xxhash.xxh3_128(seed=42) for _ in range(n)]
    digest = xxhash.xxh3_64_intdigest
    for text, start, end, row in shingle_runs(flat, at, width):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        hashes = np.array([digest(text[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for r, lo, hi in zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)], strict=True):
            order[r].update(hashes[lo:hi].tobytes())  # the shingles in turn tell the words in turn
            sets[r] = np.unique(np.concatenate([sets[r], short[lo:hi]]) if len(sets[r]) else short[lo:hi])
        for k, factor in enumerate(FACTORS):
            found = np.minimum.reduceat(hashes * factor, first)
            least[row[first], k] = np.minimum(least[row[first], k], found)
        count_bits(mix64(hashes), row, counts[:, :64])
        count_bits(mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15)), row, counts[:, 64:])
        total += np.bincount(row, minlength=n)
    bits = np.packbits((2 * counts > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    norm = np.frombuffer(b"".join(x.digest() for x in order), dtype="<u8").reshape(n, 2)
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    for k in range(ROWS):
        keys = mix64(keys + least[:, k::ROWS])
    return norm, bits, mix64(keys + np.arange(BANDS, dtype=np.uint64)), sets


def _sign(width: int):
    """Put :func:`signatures` in the place of each batch's last column, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, bits, keys, sets = signatures(*as_bytes(batch.column(batch.num_columns - 1)), width)
            n = batch.num_rows
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel().view(np.int64)))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint32), *sets]).view(np.int32)))
            words = [pa.array(x.view(np.int64)) for x in (*norm.T.copy(), *bits.T.copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *words, lists, shingles], names=[*batch.schema.names[:-1], "n1", "n2", "x", "y", "keys", "shingles"])

    return run


def common_counts(sets: list[np.ndarray]):
    """A function of i: how many values ``sets[i]`` shares with each of ``sets``."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = owner[np.argsort(code, kind="stable")]
    begin, ends = np.cumsum(count) - count, np.cumsum(sizes)

    def of(i: int) -> np.ndarray:
        own = code[ends[i] - sizes[i] : ends[i]]
        n = count[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(postings[at], minlength=len(sets))

    return of


def crowded_links(fp: np.ndarray, sets: list[np.ndarray], part: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one bucket that join all whose bits are near and whose sets are similar; ``part``: what is joined already."""
    part = part.copy()
    if (part == part[0]).all():
        return
    sizes, shared = np.array([len(s) for s in sets]), common_counts(sets)
    block = planes(fp)
    for lo in range(0, len(fp), 256):
        q, near = within(fp[lo : lo + 256], block, len(fp), NEAR_RADIUS)
        bounds = np.searchsorted(q, np.arange(min(256, len(fp) - lo) + 1))
        for i in range(lo, min(lo + 256, len(fp))):
            other = near[bounds[i - lo] : bounds[i - lo + 1]]
            other = other[part[other] != part[i]]
            if not len(other):
                continue
            common = shared(i)[other]
            for j in other[common >= similarity * (sizes[i] + sizes[other] - common)].tolist():
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    yield i, j


def _similar_rows(similarity: float):
    """Links (a, b) of rows (key, rep, part, x, y, shingles) sorted by key, of different parts of a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in whole_buckets(batches):
            fp = pdf[["x", "y"]].to_numpy().view(np.uint64)
            sets, part, rep = pdf["shingles"].tolist(), pdf["part"].to_numpy(), pdf["rep"].to_numpy()
            found: list[tuple[int, int]] = []
            for i, j in small_pairs(fp, bounds, 16, NEAR_RADIUS):
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if part[a] != part[b]:
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                            found.append((a, b))
            for k in np.flatnonzero(np.diff(bounds) > 16):
                lo, hi = bounds[k], bounds[k + 1]
                found += [(lo + a, lo + b) for a, b in crowded_links(fp[lo:hi], sets[lo:hi], part[lo:hi], similarity)]
            yield pd.DataFrame({"a": rep[[a for a, _ in found]], "b": rep[[b for _, b in found]]})

    return run


def outsiders(placed: DataFrame, crowded: int) -> DataFrame:
    """Buckets (key, rep, part) in which the texts outside a band's largest component meet those inside, and each other.

    ``placed(key, rep, m, part)``: texts of crowded bands, with their components and
    numbers of shingles.  Both kinds are dealt to slices of two fifths of ``crowded`` texts; a bucket has a
    slice of each kind, or two slices of outsiders.  So none is crowded, however many
    texts are outside; as many buckets as that takes are the price of losing no pair.
    """
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    bands = sizes.groupBy("key").agg(F.max_by(F.struct("part", "n", "m"), F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    slices = lambda n, m: F.greatest(F.lit(1), F.ceil(F.greatest(n / (crowded * 0.4), m / (crowded * 0.4 * 1024)))).cast("int")
    counts = cut(bands.select("key", F.col("main.part").alias("main"), slices(F.col("main.n"), F.col("main.m")).alias("inside"), slices(F.col("n") - F.col("main.n"), F.col("m") - F.col("main.m")).alias("outside")))
    told = placed.join(counts, "key")
    is_main = F.col("part") == F.col("main")
    own = F.pmod(F.xxhash64("rep", "key"), F.when(is_main, F.col("inside")).otherwise(F.col("outside"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.when(is_main, F.transform(every("outside"), lambda o: F.struct(F.lit("in").alias("kind"), F.col("own").alias("a"), o.alias("b"))))
    mixed = F.transform(every("inside"), lambda i: F.struct(F.lit("in").alias("kind"), i.alias("a"), F.col("own").alias("b")))
    among = F.transform(every("outside"), lambda o: F.struct(F.lit("out").alias("kind"), F.least("own", o).alias("a"), F.greatest("own", o).alias("b")))
    each = told.withColumn("own", own).select("key", "rep", "part", F.explode(F.coalesce(across, F.concat(mixed, among))).alias("at"))
    return each.select(F.xxhash64("key", "at.kind", "at.a", "at.b").alias("key"), "rep", "part")


def similar_links(signed: DataFrame, similarity: float = NEAR_SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between texts of ``signed(n1, x, y, keys, shingles)`` whose shingle sets have that Jaccard similarity.

    Texts that agree in a band stand in one bucket.  There bit planes leave those near
    enough, and the sets decide.  A bucket of more than ``crowded`` texts is dealt to
    several; afterwards its texts outside its largest component meet all others, see
    :func:`outsiders`, so that only pairs are left out that links join already.
    """
    reps = signed.where(F.size("shingles") > 0).select("n1", "keys", F.size("shingles").alias("m")).dropDuplicates(["n1"])
    rows = reps.select(F.col("n1").alias("rep"), "m", F.explode("keys").alias("key"))
    parts = F.ceil(F.greatest(F.count("*") / crowded, F.sum("m") / (crowded * 1024))).cast("int")
    again = cut(rows.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1").select("key", "parts"))
    members = cut(rows.join(again, "key").select("key", "rep", "m", "parts"))
    ends = cut(members.select("rep").distinct())
    sets = cut(signed.select(F.col("n1").alias("rep"), "x", "y", "shingles").join(ends, "rep", "left_semi").dropDuplicates(["rep"]), ends)

    def search(dealt: DataFrame) -> DataFrame:
        full = dealt.join(sets, "rep").select("key", "rep", "part", "x", "y", "shingles")
        return cut(bounded(full).repartition("key").sortWithinPartitions("key").mapInPandas(_similar_rows(similarity), "a long, b long"))

    own = F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int")
    links = search(members.select(F.when(F.col("parts") > 1, F.xxhash64("key", own)).otherwise(F.col("key")).alias("key"), "rep", F.col("rep").alias("part")))
    large = members.where("parts > 1")
    if not large.isEmpty():
        joined = cut(connected_components(links))
        placed = cut(large.join(joined, large["rep"] == joined["id"], "left").select("key", "rep", "m", F.coalesce("component", "rep").alias("part")), joined)
        more = search(outsiders(placed, crowded))
        discard(placed)
        links = cut(links.unionByName(more), links, more)
    discard(again, members, sets)
    return links


def keep_one(docs: DataFrame, width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, all columns kept.

    Two texts are near copies when their sets of ``width``-word shingles have that
    Jaccard similarity at least, or when their words are the same but for case and
    spacing; near copies of near copies belong to the group.  Texts without words, nulls
    among them, are one group.  A null doc_id comes after all others; unlike texts that
    share a doc_id, or have none, are each judged by themselves.  Of rows of a group
    with the smallest doc_id, one with a text comes before one without, then a hash of
    the text decides; of rows equal in id and text any one stays.  Columns may have any
    names; an empty table gives no rows.
    """
    text, ident = F.col("text").cast("string"), F.col("doc_id")
    # equal keys: equal id and text
    both = [F.xxhash64(ident.isNull(), ident, text.isNull(), text).alias("k1"), F.xxhash64(F.lit(1), text, ident.isNull(), ident).alias("k2")]
    given = docs.select(*both, ident.alias("i"), text.isNull().alias("e"), text.alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(bounded(given).mapInArrow(_sign(width), f"k1 long, k2 long, i {kind}, e boolean, n1 long, n2 long, x long, y long, keys array<long>, shingles array<int>"))
    links = similar_links(signed, similarity, crowded)
    found = cut(connected_components(links), links)
    parts = cut(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()), found)
    rows = signed.groupBy("k1", "k2").agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("i").alias("i"), F.first("e").alias("e"), F.count("*").alias("n"))
    placed = rows.join(parts, F.col("n1") == F.col("id"), "left")
    group = [F.coalesce("component", "n1").alias("c"), F.when(F.col("component").isNull(), F.col("n2")).alias("d")]
    order = F.struct(F.col("i").isNull(), F.col("i"), F.col("e"), F.col("k1"), F.col("k2"))
    kept = placed.groupBy(*group).agg(F.min_by(F.struct("k1", "k2", "n"), order).alias("own")).select("own.*")
    kept = cut(kept, signed, parts)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *both)
    chosen = whole.join(kept.where("n = 1"), ["k1", "k2"], "left_semi")
    if not (several := kept.where("n > 1")).isEmpty():
        chosen = chosen.unionByName(whole.join(several, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
