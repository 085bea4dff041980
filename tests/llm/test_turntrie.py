"""The trie against one built from Python's tuples, with and without colliding fingerprints."""

import hashlib
import random
import zlib

import pytest

from grainmill.llm import turntrie

SCHEMA = "conv_id long, turn int, role string, text string, rep long, depth string, conv string, split int"


def given(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = tuple(own.get(base, [])[:h]) + tuple(ts[h:])
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    inner = {k[:-1] for k in nodes if k}
    out = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(members) if made[c] == k)
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(1 for x in nodes if x and x[:-1] == k), sum(x not in inner for x in below),
            sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def some(seed, convs=40, texts=3):
    rng = random.Random(seed)
    ids = [0, 100, 200, -100, -7] + rng.sample(range(300), convs) + [1000 + i for i in range(5)]
    rows = [(c, rng.choice([None, t, t // 2]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "é漢", "long " * 9][:texts] + ["a"])) for c in set(ids) for t in range(rng.randrange(1, 9))]
    return rows + [(None, 1, "user", "nobody's"), (1001, 3, "user", "twice"), (1001, 3, "user", "twice")]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_python(spark, seed):
    rows = some(seed)
    assert sorted([tuple(r) for r in turntrie.trie(given(spark, rows)).collect()], key=str) == plain(rows)


def test_collisions_are_split(spark):
    """With primes this small most groups hold unlike turns."""
    rows = some(3, convs=25)
    assert sorted([tuple(r) for r in turntrie.trie(given(spark, rows), primes=(3, 2)).collect()], key=str) == plain(rows)


def test_long_conversations_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "BLOCK", 4)
    monkeypatch.setattr(turntrie, "SLICE_BITS", 2)
    rows = [(c, t, "user", "same" if t < 9 + c % 3 else f"{c}") for c in (0, 3, 9, 15, 21, 22, 23, 24, 25) for t in range(23)] + [(400 + i, 0, "user", "end") for i in range(20)]
    assert sorted([tuple(r) for r in turntrie.trie(given(spark, rows)).collect()], key=str) == plain(rows)


def test_empty_and_single(spark):
    assert turntrie.trie(given(spark, [])).count() == 0
    assert turntrie.trie(given(spark, [(None, 1, "a", "b")])).count() == 0
    rows = [(5, None, None, None)]
    assert [tuple(r) for r in turntrie.trie(given(spark, rows)).orderBy("depth").collect()] == sorted(plain(rows), key=lambda r: r[1])
