import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from grainmill.llm import chunks, repeats

from .helpers import PASSAGE, docs, empty, rows


def brute(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + least] for b in data for s in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                gone[s : s + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("least, hot", [(200, repeats.HOT_FRAMES), (200, 0), (25, repeats.HOT_FRAMES)])
def test_remove_repeats(spark, least, hot):
    data = rows()
    found = repeats.remove_repeats(docs(spark), least, hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found) == sorted((d[0], *b) for d, b in zip(data, brute([d[1] for d in data], least), strict=True))


def test_empty_and_columns(spark):
    assert repeats.remove_repeats(empty(spark)).collect() == []
    out = repeats.without_repeats(docs(spark))
    assert out.columns == docs(spark).columns
    by_id = {(r.doc_id, r.n_chars) for r in out.collect()}
    assert (7, 0) in by_id and (8, 0) in by_id and len(out.collect()) == len(rows())


def test_groups_hold_all_occurrences(spark):
    texts = ["xx" + PASSAGE + "yy", "zz" + PASSAGE + "ww", "q" + PASSAGE[:300]]
    table = docs(spark, [(i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(texts)])
    check_groups(repeats.maximal_repeats(table).collect(), texts)
    check_groups(repeats.maximal_repeats(table, hot=1).collect(), texts)


def test_groups_of_equal_rows_list_each_row(spark):
    text = "".join(f"{i * i % 97}," for i in range(150))
    found = repeats.maximal_repeats(docs(spark, [(4, text, "en", "s", 0, "", "", 0)] * 2 + [(None, "n" + text, "en", "s", 0, "", "", 0)])).collect()
    seen = collections.Counter((r.repeat_id, r.length, r.doc_id, r.start) for r in found)
    assert seen and all(n == (2 if key[2] == 4 else 1) for key, n in seen.items()) and {k[2] for k in seen} == {4, None}


def test_passages_of_two_letters_in_thue_morse_order(spark):
    """Such strings and their complements collide under polynomials modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    data = [(1, word), (2, word.translate({97: 98, 98: 97})), (3, "x" + word[:512])]
    table = docs(spark, [(i, t, "en", "s", 0, "", "", 0) for i, t in data])
    found = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove_repeats(table).collect()}
    assert [found[i] for i, _ in data] == brute([t for _, t in data], 200)
    pieces = {r.doc_id: r for r in chunks.dedup_chunks(table, min_run=1, with_text=True).collect()}
    assert {i: (r.n_repeated, r.n_removed, r.text) for i, r in pieces.items()} == brute_chunks(data, 1)


def brute_chunks(data, min_run):
    """n_repeated, n_removed and the kept text of texts under different ids, by dictionaries over the cuts."""
    import numpy as np

    pieces = {}
    for i, t in data:
        b = np.frombuffer((t or "").encode(), dtype=np.uint8)
        ends = chunks.cuts(b, np.array([0, len(b)])).tolist() if len(b) else []
        pieces[i] = [(s, e, b[s:e].tobytes()) for s, e in zip([0, *ends], ends)]
    places = collections.defaultdict(list)
    for i, own in sorted(pieces.items()):
        for s, _, x in own:
            places[x].append((i, s))
    out = {}
    for i, own in pieces.items():
        runs, whole = [], sum(e - s for s, e, _ in own)
        for s, e, x in own:
            if len(places[x]) > 1:
                if runs and runs[-1][-1][1] == s:
                    runs[-1].append((s, e, x))
                else:
                    runs.append([(s, e, x)])
        runs = [r for r in runs if r[-1][1] - r[0][0] >= min(min_run, whole)]
        gone = {p for r in runs for p in r if places[p[2]][0] != (i, p[0])}
        out[i] = (sum(e - s for r in runs for s, e, _ in r), sum(e - s for s, e, _ in gone), b"".join(p[2] for p in own if p not in gone).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("min_run", [100, 1])
def test_chunks_against_dictionaries(spark, min_run):
    data = [(n, t) for n, (_, t, *_) in enumerate(rows())] + [(50, "short copy"), (51, "short copy"), (52, "p" * 700 + PASSAGE), (53, PASSAGE[100:900] + " é" * 300)]
    found = chunks.dedup_chunks(docs(spark, [(i, t, "en", "s", 0, "", "", 0) for i, t in data]), min_run=min_run, with_text=True).collect()
    assert {r.doc_id: (r.n_repeated, r.n_removed, r.text) for r in found} == brute_chunks(data, min_run)


def test_columns_with_names_that_operators_use(spark):
    table = docs(spark)
    for name in ("id", "spans", "_key", "_spans", "sid", "h"):
        table = table.withColumn(name, F.lit(name))
    out = repeats.without_repeats(table)
    assert out.columns == table.columns and {(r.id, r.spans, r.key) for r in out.collect()} == {("id", "spans", "clash")}


def brute_groups(texts, least):
    """{string: its places} of all maximal repeats of at least ``least`` bytes."""
    data = [t.encode() for t in texts]
    places = collections.defaultdict(set)
    for d, t in enumerate(data):
        for s in range(len(t)):
            for e in range(s + least, len(t) + 1):
                places[t[s:e]].add((d, s))
    out = {}
    for body, at in places.items():
        before = {data[d][s - 1] if s else -1 - d for d, s in at}
        after = {data[d][s + len(body)] if s + len(body) < len(data[d]) else -1 - d for d, s in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out[body] = at
    return out, places


@pytest.mark.parametrize("hot", [repeats.HOT_FRAMES, 1])
def test_a_long_passage_is_one_group(spark, hot):
    body = "".join(f"{i * i % 9973:05d}" for i in range(4000))
    passage, longer = body[:1000], body[2000:12000]
    texts = ["a" + passage + "b" + longer, "c" + longer + "d" + passage, "e" + passage + "f", "g" + longer + "h", "i" + longer[3000:9000] + "j"]
    table = docs(spark, [(i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(texts)])
    groups = collections.defaultdict(set)
    for r in repeats.maximal_repeats(table, hot=hot).collect():
        groups[texts[r.doc_id][r.start : r.start + r.length]].add((r.doc_id, r.start))
    assert groups == {passage: {(0, 1), (1, 10002), (2, 1)}, longer: {(0, 1002), (1, 1), (3, 1)}, longer[3000:9000]: {(0, 4002), (1, 3001), (3, 3001), (4, 1)}}


@pytest.mark.parametrize("seed", range(4))
def test_groups_against_all_substrings(spark, seed):
    """Texts of shared pieces: what is found is maximal and whole, and only what its parts tell is not found."""
    import numpy as np

    draw = np.random.default_rng(seed)
    pieces = ["".join(map(chr, draw.integers(97, 100, n))) for n in draw.integers(5, 90, 6)]
    texts = ["".join(pieces[k] for k in draw.integers(0, 6, 6)) for _ in range(8)]
    table = docs(spark, [(i, t, "en", "s", 0, "", "", 0) for i, t in enumerate(texts)])
    groups = collections.defaultdict(set)
    for r in repeats.maximal_repeats(table, 25, hot=[repeats.HOT_FRAMES, 2][seed % 2]).collect():
        groups[texts[r.doc_id].encode()[r.start : r.start + r.length]].add((r.doc_id, r.start))
    want, places = brute_groups(texts, 25)
    assert groups and all(want.get(body) == at for body, at in groups.items())
    for body in want.keys() - groups.keys():
        assert all(len(places[body[s : s + 25]]) > len(want[body]) for s in range(len(body) - 24))


def check_groups(found, texts):
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.repeat_id, r.length].add((r.doc_id, r.start))
    assert groups
    for (_, length), found in groups.items():
        cut = {texts[d].encode()[s : s + length] for d, s in found}
        assert len(cut) == 1 and length >= 200
        body = cut.pop()
        every = {(d, s) for d, t in enumerate(texts) for s in range(len(t)) if t.encode()[s : s + length] == body}
        assert found == every


def test_interval_tree():
    assert sorted(repeats.interval_tree([3, 5, 5, 2, 4], 3)) == [(3, 0, 3), (4, 4, 5), (5, 1, 3)]


def test_chunks_catch_passages_and_leave_clean_texts(spark):
    table = chunks.dedup_chunks(docs(spark), with_text=True)
    found = {}
    for r in table.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert found[5][0].n_repeated > 0.7 * len(PASSAGE) and found[6][0].n_repeated > 0.7 * len(PASSAGE)
    assert found[5][0].n_removed == 0 and found[6][0].n_removed > 0.7 * len(PASSAGE)
    assert found[8][0].n_removed == found[8][0].n_bytes and found[7][0].n_removed == 0
    assert found[1][0].n_repeated == 0 and found[11][0].n_repeated == 0 and found[3][0].n_bytes == 0
    for own in found.values():
        for r in own:
            assert r.n_removed == sum(s.e - s.s for s in r.spans) == r.n_bytes - len(r.text.encode())
            assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert chunks.dedup_chunks(empty(spark)).collect() == []


def test_cuts_resist_insertions():
    import numpy as np

    body = np.random.default_rng(2).integers(97, 123, 5000, dtype=np.uint8)
    moved = np.concatenate([np.frombuffer(b"inserted", dtype=np.uint8), body])
    a = set(chunks.cuts(body, np.array([0, 5000])).tolist())
    b = {int(c) - 8 for c in chunks.cuts(moved, np.array([0, 5008]))}
    assert len(a & b) > 0.98 * len(a)
    sizes = np.diff([0, *sorted(a)])
    assert 30 < sizes.mean() < 55 and sizes.max() <= chunks.MAX_CHUNK
    assert np.diff([0, *chunks.cuts(np.full(5000, 97, np.uint8), np.array([0, 5000]))]).max() <= chunks.MAX_CHUNK


def test_a_block_without_repeats_gives_nothing():
    import pandas as pd

    frames = pd.DataFrame({"h": [1, 1, 2, 2], "sid": [1, 2, 3, 4], "seg": [bytes(range(40)), bytes(range(40, 80)), bytes(range(80, 120)), b"x" + bytes(range(80, 120))]})
    for groups in (False, True):
        found = list(repeats._searcher(20, groups, target=50)([frames]))
        assert found and all(len(f) for f in found) and {h for f in found for h in f["h"]} == {2}
    assert list(repeats._searcher(30, False)([frames.iloc[:1]])) == []
