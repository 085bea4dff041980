"""Repeated byte strings: sparse suffix arrays and their common-prefix interval trees.

Every 200-byte window is assigned to the anchor in it, the leftmost smallest hash
among its 72-byte substrings, so equal windows always share an anchor hash.  The run
of windows with one anchor is a frame.  Anchor hashes seen once are dropped by an
aggregation, equal frames collapse to one, and the differing frames of an anchor are
searched together by an enhanced suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PrefixHash, as_bytes, bounded, cut, fresh, mix64, runs_of_rows

MIN_LENGTH = 200
#: The frames of an anchor that has more different ones than this are dealt again by anchors of another hash.
HOT_FRAMES = 2000
#: So often at most: frames that still share all their anchors are searched together.
DEALS = 3
SLICE = 1 << 20


def _identity() -> list:
    """Tell rows apart that differ in id or text; equal rows share both columns, and get the same result."""
    ident = F.col("doc_id").cast("long")
    return [F.coalesce(ident, F.lit(0)), F.xxhash64(ident.isNull(), F.coalesce(F.col("text").cast("string"), F.lit("")))]


def _text(docs: DataFrame) -> DataFrame:
    """(id, key, doc_id, text), with an empty text for a null."""
    ident, key = _identity()
    return bounded(docs).select(ident.alias("id"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def anchor_size(min_length: int) -> int:
    return max(1, min_length * 9 // 25)


def frames_of(data: np.ndarray, offsets: np.ndarray, min_length: int, deal: int = 0) -> tuple[np.ndarray, ...]:
    """(anchor hash, frame digest, row, first window, number of windows) of each frame in the rows of ``data``.

    ``deal`` chooses among hashes, and so among anchors.  The digest is of the frame's
    bytes and has nothing in common with the anchor's hash; together they have 128 bits.
    """
    k = anchor_size(min_length)
    width = min_length - k + 1
    empty = np.zeros(0, np.int64)
    if len(data) < min_length:
        return (empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    sums = PrefixHash(data)
    grams = sums.windows(k)
    if deal:
        grams = mix64(grams + np.uint64(deal))
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows within one row
    valid = np.ones(len(anchor), dtype=bool)
    for end in offsets[1:-1]:
        valid[max(0, end - min_length + 1) : end] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return (empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor[at]) != 0)
    row_of = np.searchsorted(offsets, at, side="right") - 1
    new[1:] |= np.diff(row_of) != 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, row = at[first], row_of[first]
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    sid = np.array([digest(raw[s:e]) for s, e in zip(start.tolist(), (start + count - 1 + min_length).tolist(), strict=True)], dtype=np.uint64)
    return grams[anchor[start]], sid, row, start - offsets[row], count


def _slices(flat: np.ndarray, at: np.ndarray, min_length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in it, bytes, offsets): a few rows, or a part of a long one that overlaps the next part."""
    for lo, hi in runs_of_rows(at, SLICE):
        size = int(at[hi] - at[lo])
        if size <= 4 * SLICE:
            yield lo, 0, flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        else:
            for s in range(0, size - min_length + 1, SLICE):
                part = flat[at[lo] + s : min(at[hi], at[lo] + s + SLICE + min_length - 1)]
                yield lo, s, part, np.array([0, len(part)])


def frames(texts: DataFrame, min_length: int = MIN_LENGTH, deal: int = 0) -> DataFrame:
    """(h, sid, id, key, lo, n): all frames of ``texts(id, key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            flat, at = as_bytes(batch.column(2))
            for row, offset, data, own in _slices(flat, at, min_length):
                h, sid, r, lo, n = frames_of(data, own, min_length, deal)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(sid.view(np.int64)), pa.array(ids[row + r]), pa.array(keys[row + r]), pa.array((lo + offset).astype(np.int32)), pa.array(n.astype(np.int16))],
                        names=["h", "sid", "id", "key", "lo", "n"],
                    )

    return bounded(texts).select("id", "key", "text").mapInArrow(run, "h long, sid long, id long, key long, lo int, n short")


def interval_tree(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, left, right) of each common-prefix interval of at least ``least`` bytes.

    One scan with a stack over the common-prefix lengths of neighbours; ``lcp[i]``
    stands between suffixes i and i+1.  Right ends are inclusive.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > length:
            top, left = stack.pop()
            if top >= least:
                out.append((top, left, i))
        if not stack or stack[-1][0] < length:
            stack.append((length, left))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # the first lo bytes agree, the first hi do not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_groups(segments: list[bytes], min_length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(segment, start), ...]) of each maximal repeat among different segments.

    Suffixes of at least ``min_length`` bytes are first dealt to classes by a hash of
    their first ``min_length`` bytes.  A class whose members all follow the same byte
    extends to the left, so its intervals lie in those of the class one byte before and
    it is skipped; the others get a sorted suffix array, the common-prefix lengths of
    neighbours and the interval tree, and an interval is a maximal repeat when its
    members have different bytes on their left.  A segment's start counts as different.
    """
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    if len(data) < min_length:
        return []
    heads = PrefixHash(data).windows(min_length)
    lengths = np.maximum(np.diff(offsets) - min_length + 1, 0)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
    start = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    place = (offsets[owner] + start).astype(np.int32)
    head = heads[place]
    order = np.argsort(head, kind="stable")
    head = head[order]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    size = np.diff(np.append(first, len(head)))
    before = np.where(start > 0, data[np.maximum(place - 1, 0)].astype(np.int32), -1 - owner)[order]
    varied = (size > 1) & (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)) if len(head) else np.zeros(0, bool)
    groups = []
    for i in np.flatnonzero(varied):
        members = order[first[i] : first[i] + size[i]]
        suffixes = sorted((segments[o][s:], int(o), int(s), int(x)) for o, s, x in zip(owner[members], start[members], before[first[i] : first[i] + size[i]], strict=True))
        lcp = [_common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        for length, left, right in interval_tree(lcp, min_length):
            if len({x[3] for x in suffixes[left : right + 1]}) > 1:
                groups.append((length, [(o, s) for _, o, s, _ in suffixes[left : right + 1]]))
    return groups


def _searcher(min_length: int, groups: bool, target: int = 1 << 20):
    """Streams segments sorted by anchor and searches whole anchors, a megabyte at a time.

    Gives a row for each member of each maximal repeat, or with ``groups`` false one row
    for each segment with the ranges that repeats cover in it.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        segments = pdf["seg"].tolist()
        if not groups:
            parts: dict[int, dict[int, int]] = {}
            for length, found in maximal_groups(segments, min_length):
                for o, s in found:
                    own = parts.setdefault(o, {})
                    own[s] = max(own.get(s, 0), length)
            at = list(parts)
            ranges = [[{"start": s, "length": e - s} for s, e in merge([{"s": s, "e": s + n} for s, n in parts[o].items()])] for o in at]
            return pd.DataFrame({"h": pdf["h"].to_numpy()[at], "sid": pdf["sid"].to_numpy()[at], "parts": ranges})
        rows = []
        for number, (length, found) in enumerate(maximal_groups(segments, min_length)):
            rid = None
            for o, s in found:
                if rid is None:
                    rid = xxhash.xxh64_intdigest(segments[o][s : s + length]) - (1 << 63)
                rows.append((o, rid, length, s))
        o = [r[0] for r in rows]
        return pd.DataFrame({"h": pdf["h"].to_numpy()[o], "sid": pdf["sid"].to_numpy()[o], "rid": np.array([r[1] for r in rows], np.int64), "length": np.array([r[2] for r in rows], np.int32), "start": np.array([r[3] for r in rows], np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # blocks without repeats give no frame: an empty list of ranges has no type in pandas
        yield from (found for found in blocks(batches) if len(found))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held = 0
        for pdf in batches:
            while len(pdf):
                h = pdf["h"].to_numpy()
                sizes = np.cumsum(pdf["seg"].str.len().to_numpy())
                take = min(len(pdf), int(np.searchsorted(sizes, target)) + 1)
                part, pdf = pdf.iloc[:take], pdf.iloc[take:]
                rest.append(part)
                held += int(sizes[take - 1])
                if held >= target:
                    block = pd.concat(rest, ignore_index=True)
                    last = int(np.searchsorted(block["h"].to_numpy(), h[take - 1]))
                    if last:
                        yield search(block.iloc[:last].reset_index(drop=True))
                    rest = [block.iloc[last:]]
                    held = int(rest[0]["seg"].str.len().sum())
                    if held >= target:  # one large anchor: wait for more before the next look
                        held = 0
        if rest and sum(map(len, rest)):
            yield search(pd.concat(rest, ignore_index=True))

    return run


def _cutter(min_length: int):
    """Frames out of the texts: their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = as_bytes(batch.column(0))
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                own = flat[at[i] : at[i + 1]]
                seg = [own[w["lo"] : w["lo"] + w["n"] - 1 + min_length].tobytes() for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w["h"] for w in wanted], pa.int64()), pa.array([w["sid"] for w in wanted], pa.int64()), pa.array(seg, pa.binary())], names=["h", "sid", "seg"])

    return run


MEMBERS = "h long, sid long, rid long, length int, start int"
RANGES = "h long, sid long, parts array<struct<start:int,length:int>>"


def _search(texts: DataFrame, min_length: int, hot: int, groups: bool, deal: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames of ``texts(id, key, text)`` with a repeated anchor; all different frames with their copies; repeats found between different frames."""
    every = frames(texts, min_length, deal)
    # small tables of keys are written before they are joined, so that a hot key's rows can be split in the join
    again = cut(every.groupBy("h").agg(F.count("*").alias("seen")).where("seen > 1").select("h"))
    repeated = cut(every.join(again, "h"), again)
    kinds = cut(repeated.groupBy("h", "sid").agg(F.count("*").alias("copies"), F.min(F.struct("id", "key", "lo", "n")).alias("one")))
    several = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    mixed = kinds.join(several, "h")

    def fetch(which: DataFrame) -> DataFrame:
        """(h, sid, seg) of frames, each once however many equal rows hold it."""
        wanted = which.groupBy("one.id", "one.key").agg(F.collect_list(F.struct("h", "sid", F.col("one.lo").alias("lo"), F.col("one.n").alias("n"))).alias("wanted"))
        segments = bounded(texts).join(wanted, ["id", "key"]).select("text", "wanted").mapInArrow(_cutter(min_length), "h long, sid long, seg binary")
        return segments.dropDuplicates(["h", "sid"])

    last = deal == DEALS or several.where(F.col("kinds") > hot).isEmpty()
    segments = fetch(mixed if last else mixed.where(F.col("kinds") <= hot))
    found = segments.repartition("h").sortWithinPartitions("h").mapInPandas(_searcher(min_length, groups), MEMBERS if groups else RANGES)
    if not last:
        # the crowded anchors' frames are texts themselves, in which other anchors are chosen
        dense = cut(fetch(mixed.where(F.col("kinds") > hot)).select(F.col("h").alias("id"), F.col("sid").alias("key"), F.col("seg").alias("text")))
        if groups:
            more = _members(dense, min_length, hot, deal + 1).select(F.col("id").alias("h"), F.col("key").alias("sid"), "rid", "length", "start")
        else:
            part = lambda p: F.struct(p["s"].alias("start"), (p["e"] - p["s"]).alias("length"))
            more = _covered(dense, min_length, hot, deal + 1).select(F.col("id").alias("h"), F.col("key").alias("sid"), F.transform("spans", part).alias("parts"))
        found = found.unionByName(more)
    return repeated, kinds, found


def _members(texts: DataFrame, min_length: int, hot: int, deal: int = 0) -> DataFrame:
    """(rid, length, id, key, start): every occurrence of every group in ``texts``."""
    repeated, kinds, found = _search(texts, min_length, hot, True, deal)
    whole = kinds.where("copies > 1").select("h", "sid", F.xxhash64("h", "sid").alias("rid"), (F.col("one.n") - 1 + min_length).cast("int").alias("length"), F.lit(0).alias("start"))
    return repeated.join(found.unionByName(whole), ["h", "sid"]).select("rid", "length", "id", "key", (F.col("lo") + F.col("start")).alias("start"))


def _covered(texts: DataFrame, min_length: int, hot: int, deal: int = 0) -> DataFrame:
    """(id, key, spans): the byte ranges of each text that repeats cover, unsorted and not merged."""
    repeated, kinds, found = _search(texts, min_length, hot, False, deal)
    # a frame with copies is covered whole, whatever else was found in it
    whole = kinds.where("copies > 1").select("h", "sid", F.array(F.struct(F.lit(0).alias("start"), (F.col("one.n") - 1 + min_length).cast("int").alias("length"))).alias("parts"))
    hits = repeated.join(whole.unionByName(found), ["h", "sid"]).select("id", "key", F.transform("parts", lambda p: F.struct((F.col("lo") + p["start"]).alias("s"), (F.col("lo") + p["start"] + p["length"]).alias("e"))).alias("parts"))
    return hits.groupBy("id", "key").agg(F.flatten(F.collect_set("parts")).alias("spans"))


def _shifts_joined(occurrences: DataFrame) -> DataFrame:
    """(rid, length, id, key, start): one group for all that have the same occurrences, shifted, and lie without a gap.

    ``occurrences(rid, length, id, key, start)`` are different rows.  A group's shape is
    the set of its occurrences relative to the smallest, as a count and two digests.
    Groups of one shape whose strings overlap or touch at their smallest occurrence do
    so at every one.  Gives the smallest occurrence of each joined group.
    """
    least = cut(occurrences.groupBy("rid").agg(F.min(F.struct("id", "key", "start")).alias("one"), F.max("length").alias("length")))
    place = [F.col("id"), F.col("key"), F.col("start") - F.col("one.start")]
    digests = [F.bit_xor(F.xxhash64(F.lit(seed), *place)).alias(f"x{seed}") for seed in (1, 2)]
    shapes = occurrences.drop("length").join(least.drop("length"), "rid").groupBy("rid").agg(F.count("*").alias("n"), *digests)
    rows = least.join(shapes, "rid").select("rid", "one.id", "one.key", "one.start", (F.col("one.start") + F.col("length")).alias("end"), "n", "x1", "x2")
    shape = ["id", "key", "n", "x1", "x2"]  # groups that begin in one document
    along = Window.partitionBy(*shape).orderBy("start", "rid")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy(*shape, "island").agg(F.min(F.struct("start", "rid")).alias("first"), F.max("end").alias("end"))
    return joined.select("first.rid", (F.col("end") - F.col("first.start")).alias("length"), "id", "key", "first.start")


def _around(block: int):
    """The bytes before (backwards) and after occurrences, up to ``block`` of them and to the text's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // block)
        for batch in batches:
            flat, at = as_bytes(batch.column(0))
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                own = flat[at[i] : at[i + 1]]
                for lo in range(0, len(wanted), step):
                    part = wanted[lo : lo + step]
                    before = [own[max(0, w["s"] - block) : w["s"]][::-1].tobytes() if w["more_left"] else None for w in part]
                    after = [own[w["e"] : w["e"] + block].tobytes() if w["more_right"] else None for w in part]
                    yield pa.RecordBatch.from_arrays([pa.array([w["rid"] for w in part], pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["rid", "before", "after"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far all of a group's surroundings agree: as far as the smallest and the largest do."""
    for batch in batches:
        sides = [[_common(a, b) if a is not None else 0 for a, b in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist(), strict=True)] for k in (1, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int32()) for x in sides]], names=["rid", "to_left", "to_right"])


def _extended(texts: DataFrame, occurrences: DataFrame, groups: DataFrame) -> DataFrame:
    """(rid, length, left): how long the groups' strings are when they take in what all occurrences share around them.

    Rounds look at 256, 4096 and then always 65536 bytes on each side that is still open;
    a group is open while all of them agree.  The comparison is by bytes, and aggregates
    only the smallest and the largest surroundings, so no group is gathered.
    """
    done = None
    state = cut(groups.select("rid", F.col("length").cast("int").alias("length"), F.lit(0).alias("left"), F.lit(True).alias("more_left"), F.lit(True).alias("more_right")))
    block = 256
    while True:
        at = occurrences.drop("length").join(state, "rid").select("id", "key", F.struct("rid", (F.col("start") - F.col("left")).alias("s"), (F.col("start") - F.col("left") + F.col("length")).alias("e"), "more_left", "more_right").alias("w"))
        wanted = at.groupBy("id", "key").agg(F.collect_list("w").alias("wanted"))
        around = bounded(texts).join(wanted, ["id", "key"]).select("text", "wanted").mapInArrow(_around(block), "rid long, before binary, after binary")
        ends = around.groupBy("rid").agg(F.min("before").alias("a"), F.max("before").alias("b"), F.min("after").alias("c"), F.max("after").alias("d"))
        shared = ends.mapInArrow(_agreeing, "rid long, to_left int, to_right int")
        moved = state.join(shared, "rid").select("rid", (F.col("length") + F.col("to_left") + F.col("to_right")).alias("length"), (F.col("left") + F.col("to_left")).alias("left"), (F.col("to_left") == block).alias("more_left"), (F.col("to_right") == block).alias("more_right"))
        after = cut(moved, state)
        finished = after.where("NOT (more_left OR more_right)").select("rid", "length", "left")
        done = finished if done is None else done.unionByName(finished)
        state = after.where("more_left OR more_right")
        if state.isEmpty():
            return done
        state = cut(state)
        block = min(block * 16, 1 << 16)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, at = as_bytes(batch.column(0))
        for i, wanted in enumerate(batch.column(1).to_pylist()):
            own = flat[at[i] : at[i + 1]].tobytes()
            found = [xxhash.xxh64_intdigest(memoryview(own)[w["s"] : w["e"]]) - (1 << 63) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([w["rid"] for w in wanted], pa.int64()), pa.array(found, pa.int64())], names=["rid", "repeat_id"])


def maximal_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, hot: int = HOT_FRAMES) -> DataFrame:
    """(repeat_id, length, doc_id, start): every occurrence of every maximal repeat group.

    Groups found within frames that have the same occurrences, shifted, become one, which
    then takes in all bytes that its occurrences share on both sides: a long passage is
    one group however many frames it has, and neither ``hot`` nor the frames show.  Each
    group is a maximal repeat with all its occurrences.  A maximal repeat of whose
    strings of ``min_length`` bytes every one occurs elsewhere too, apart from it, comes
    only as the groups of these.  Lengths and starts are in bytes; a group's repeat_id
    hashes its bytes.

    Matches never cross documents; null and short texts have none.  Rows may share a
    doc_id; equal rows are documents of their own, so their texts repeat, and each
    row's occurrences are listed.  A null doc_id stays null; columns may have any names;
    an empty table gives no rows.
    """
    ids = _text(docs)
    occurrences = cut(_members(ids, min_length, hot).distinct())
    groups = cut(_shifts_joined(occurrences))
    kept = cut(occurrences.join(groups.select("rid"), "rid", "left_semi"))
    whole = cut(_extended(ids, kept, groups))
    spans = groups.drop("length").join(whole, "rid").select("id", "key", F.struct("rid", (F.col("start") - F.col("left")).alias("s"), (F.col("start") - F.col("left") + F.col("length")).alias("e")).alias("w"))
    named = bounded(ids).join(spans.groupBy("id", "key").agg(F.collect_list("w").alias("wanted")), ["id", "key"]).select("text", "wanted").mapInArrow(_digests, "rid long, repeat_id long")
    names = cut(whole.join(named.distinct(), "rid").select("rid", "repeat_id", F.col("length").alias("long"), "left"))
    # groups that grew to one string are one
    every = kept.join(names, "rid").select("repeat_id", F.col("long").alias("length"), "id", "key", (F.col("start") - F.col("left")).alias("start")).distinct()
    rows = every.join(ids.select("id", "key", "doc_id"), ["id", "key"])
    return rows.select("repeat_id", "length", "doc_id", "start")


def covered(docs: DataFrame, min_length: int = MIN_LENGTH, hot: int = HOT_FRAMES) -> DataFrame:
    """(id, key, spans): the byte ranges of each document that repeats cover; see :func:`_text` for id and key."""
    return _covered(_text(docs), min_length, hot)


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps; ranges that touch become one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, hot: int = HOT_FRAMES, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (merged byte ranges), kept_sha256, and kept text if asked.

    A byte goes when a string of ``min_length`` bytes that covers it starts anywhere
    else too, in the same document or another; strings are judged on the input, so all
    copies go.  A null text is empty and gives zeros.  Texts shorter than
    ``min_length`` are never touched.  Rows may share a doc_id, or be equal: each has
    its own result.  Other columns are ignored; an empty table gives no rows.  A
    character that loses only some of its bytes is left out of the kept text; the
    digest is over the kept bytes.
    """
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<s:int,e:int>>, kept_sha256 string" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = as_bytes(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own = flat[at[i] : at[i + 1]].tobytes()
                gone = merge(spans)
                kept = b"".join(own[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(own)], strict=True)) if gone else own
                rows.append((len(own), len(own) - len(kept), [{"s": s, "e": e} for s, e in gone], hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array([r[3] for r in rows], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([r[4] for r in rows], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _text(docs).join(covered(docs, min_length, hot), ["id", "key"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, hot: int = HOT_FRAMES) -> DataFrame:
    """``docs`` with repeated bytes removed from the texts; columns as they were, n_chars following the text.

    Rows and their order of columns stay, whatever their names; a null text stays null
    and counts as empty.  Equal rows are documents of their own, so each loses what
    the other holds; rows may share a doc_id or have none.  An empty table gives none.
    """
    names = docs.columns
    ident, key, spans = fresh(docs, "id", "key", "spans")
    found = covered(docs, min_length, hot).select(F.col("id").alias(ident), F.col("key").alias(key), F.col("spans").alias(spans))
    rows = bounded(docs).select(*[F.col(f"`{c}`") for c in names], *[c.alias(n) for c, n in zip(_identity(), (ident, key), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            texts = batch.column(at_text).to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found:
                    own, gone = texts[i].encode(), merge(found)
                    texts[i] = b"".join(own[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(own)], strict=True)).decode("utf-8", "ignore")
            columns = [pa.array(texts, batch.schema.field(at_text).type) if k == at_text else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.join(found, [ident, key], "left").select(*[F.col(f"`{c}`") for c in names], spans).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in names]) if "n_chars" in names else out
