import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from grainmill.llm import common, simhash
from grainmill.llm.graph import connected_components, forest

from .helpers import docs, empty, rows


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprint_matches_definition():
    for _, text, *_ in rows()[:7]:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_near_duplicates(spark):
    found = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs(spark)).collect())
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in rows()]
    links = [(a, b) for a, x in prints for b, y in prints if (x ^ y).bit_count() <= 3]
    parts = plain_components({i for i, _ in prints}, links)
    by_print = {}
    for i, x in prints:  # rows of one id with far texts stay apart
        by_print.setdefault(x, parts[i])
    assert [(i, x) for i, x, _ in found] == sorted(prints)
    assert {c for i, _, c in found if i in (1, 2)} == {1}
    assert {c for i, _, c in found if i in (3, 4)} == {3}
    assert {c for i, _, c in found if i in (7, 8)} == {7}


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(empty(spark)).columns == empty(spark).columns


def test_links_with_and_without_hot_buckets(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for b in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, n) for n, x in enumerate(prints)], "fp long, rep long")
    want = plain_components(range(len(prints)), [(i, j) for i, x in enumerate(prints) for j in range(i) if (x ^ prints[j]).bit_count() <= 3])
    for hot in (4096, 2):
        links = [(r.a, r.b) for r in simhash.near_links(table, hot=hot).collect()]
        assert plain_components(range(len(prints)), links) == want


def test_bit_planes_against_popcount():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ np.uint64(0b1011)
    q, m = simhash.within(fps[:50], simhash.planes(fps), len(fps))
    want = np.argwhere(np.bitwise_count(fps[:50, None] ^ fps[None, :]) <= 3)
    assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(129, 40), (300, 301), (7, 7), (None, 3)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = plain_components({i for l in links for i in l if i is not None}, [l for l in links if None not in l])
    assert found == {i: c for i, c in want.items() if i != c}
    child, root = forest(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(child.tolist(), root.tolist(), strict=True)) == {4: 3, 5: 3, 9: 8}


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark)).collect()
    assert [r.doc_id for r in kept if r.doc_id in (1, 2, 3, 4, 7, 8)].__len__() == 3
    assert {r.doc_id for r in kept} >= {1, 3, 5, 6, 7, 11}


def jaccard(s, t):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (s.lower().split(), t.lower().split()))
    return len(one & two) / len(one | two)


def planted(rng, n):
    """Pairs of a text and a copy with a few words replaced, in one place or in several; with their similarity."""
    out = []
    while len(out) < n:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        copy, edits, at = list(words), rng.randrange(1, 12), rng.randrange(len(words) // 2)
        for k in range(edits) if len(out) % 2 else range(at, at + edits * 2):
            copy[k if len(out) % 2 == 0 else rng.randrange(len(copy))] = f"new{k}x{rng.randrange(10**6)}"
        s, t = " ".join(words), " ".join(copy)
        if abs(jaccard(s, t) - 0.8) > 0.01 and jaccard(s, t) > 0.6:
            out.append((s, t, jaccard(s, t)))
    return out


def test_keep_one_takes_near_copies_at_five_words(spark):
    pairs = planted(random.Random(11), 400)
    data = [(2 * i + k, pairs[i][k], "en", "s", 0, "", "", 0) for i in range(len(pairs)) for k in (0, 1)]
    left = {r.doc_id for r in simhash.keep_one(docs(spark, data)).collect()}
    assert left >= {2 * i for i in range(len(pairs))}
    assert all(2 * i + 1 in left for i, p in enumerate(pairs) if p[2] < 0.8)
    for lo, hi, recall in ((0.8, 0.85, 0.95), (0.85, 0.9, 0.98), (0.9, 1, 1)):
        gone = [2 * i + 1 not in left for i, p in enumerate(pairs) if lo <= p[2] < hi]
        assert len(gone) > 20 and sum(gone) >= recall * len(gone), (lo, sum(gone), len(gone))


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    data = []
    for i in range(120):  # 0-59 near one text, 60-119 near another that is far from it but alike in hashing
        words = list(base)
        if i >= 60:
            words[100:120] = [f"other{k}" for k in range(20)]
        for _ in range(2):
            words[rng.randrange(90)] = f"own{i}x{rng.randrange(10**6)}"
        data.append((i, " ".join(words), "en", "s", 0, "", "", 0))
    links = [(a[0], b[0]) for a in data for b in data if a[0] < b[0] and jaccard(a[1], b[1]) >= 0.8]
    want = set(plain_components(range(120), links).values())
    for crowded in (simhash.CROWDED, 24):
        assert {r.doc_id for r in simhash.keep_one(docs(spark, data), crowded=crowded).collect()} == want


def test_crowded_links_join_what_is_similar():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(60, 40, replace=False)) for _ in range(70)]
    for part in (np.arange(70), np.repeat([0, 1, 2], [40, 20, 10])):
        near = [(i, j) for i in range(70) for j in range(i) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j])) * 1.2]
        own = [(i, int(np.flatnonzero(part == part[i])[0])) for i in range(70)]
        found = list(simhash.crowded_links(np.zeros((70, 2), np.uint64), sets, part, 0.6))
        assert set(found) <= {(i, j) for a, b in near for i, j in ((a, b), (b, a))}
        assert plain_components(range(70), own + found) == plain_components(range(70), own + near)


def test_slices_make_no_difference(monkeypatch):
    texts = [("  word%d\n" * 1) % (i % 7) * 3 + " ".join(f"Ü{i * k % 31}\tx" for k in range(i * 3)) for i in range(40)] + ["one", "", "y" * 5000, "two three", "a b c " * 900 + "z" * 3000 + " d e f"]
    flat = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole, signed = simhash.prints(flat, at), simhash.signatures(flat, at, 5)
    assert whole.tolist() == [plain_fingerprint(t) for t in texts]
    for size in (64, 700):
        monkeypatch.setattr(common, "SLICE", size)
        assert simhash.prints(flat, at).tolist() == whole.tolist()
        for a, b in zip(simhash.signatures(flat, at, 5)[:3], signed[:3], strict=True):
            assert a.tolist() == b.tolist()
        assert all(np.array_equal(a, b) for a, b in zip(simhash.signatures(flat, at, 5)[3], signed[3], strict=True))


def test_a_long_text_takes_little_memory():
    import tracemalloc

    text = np.frombuffer(b" ".join(b"word%d" % (i * 7919 % 100003) for i in range(2_000_000)), dtype=np.uint8)
    tracemalloc.start()
    simhash.prints(text, np.array([0, len(text)]))
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_keep_one_loses_no_row_without_a_near_copy(spark):
    data = [(None, "a text without an id that stands alone here"), (1, "the copy of number zero in as many words"), (1, "a unique text under the same id as that copy"), (0, "the copy of number zero in as many words"), (None, "The copy of number zero in as many words")]
    data.append(data[2])  # equal rows
    found = simhash.keep_one(docs(spark, [(i, t, "en", "s", 0, "", "", 0) for i, t in data])).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted([data[0], data[2], data[3]], key=str)


def test_keep_one_with_its_own_names_as_columns(spark):
    table = docs(spark).withColumn("k1", F.lit(1)).withColumn("n1", F.lit("n")).withColumn("row", F.lit(2)).withColumn("component", F.lit(3))
    found = simhash.keep_one(table)
    assert found.columns == table.columns and found.count() == simhash.keep_one(docs(spark)).count()


def test_no_bucket_of_the_second_search_is_crowded(spark):
    """A band of many texts that few links join: slices meet slices, and all pairs that matter meet somewhere."""
    rng = random.Random(2)
    crowded, texts = 64, 1500
    part = [0 if rng.random() < 0.3 else i for i in range(texts)]
    placed = spark.createDataFrame([(k, i, 10, part[i]) for k in (5, 6) for i in range(texts) if k == 5 or i % 10 == 0], "key long, rep long, m int, part long")
    dealt = simhash.outsiders(placed, crowded)
    buckets = {}
    for r in dealt.collect():
        buckets.setdefault(r["key"], []).append(r["rep"])
    assert max(map(len, buckets.values())) <= crowded * 1.25
    meet = {(a, b) for b_ in buckets.values() for i, a in enumerate(sorted(set(b_))) for b in sorted(set(b_))[i + 1 :]}
    assert all((a, b) in meet for a in range(0, texts, 7) for b in range(a + 1, texts, 3) if part[a] != part[b])
