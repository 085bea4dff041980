import math
import re

import numpy as np
import pytest

from grainmill.llm import covertree, toxicity

from .helpers import docs, empty, rows


def plain_links(vectors, threshold=0.98):
    ok = [(i, np.array([np.nan if v is None else v for v in e], float), l) for i, e, l in vectors if e is not None and l is not None and len(e)]
    ok = [(i, e, l) for i, e, l in ok if np.isfinite(e).all() and np.linalg.norm(e) > 0]
    return [(i, j) for k, (i, e, l) in enumerate(ok) for j, f, m in ok[:k] if l == m and len(e) == len(f) and e @ f / np.linalg.norm(e) / np.linalg.norm(f) >= threshold]


def test_shared_and_missing_ids(spark):
    """Ids that several vectors have, within a label and across labels, and none at all."""
    rows = [(7, [1.0, 0.0], 0), (7, [0.0, 1.0], 1), (8, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (3, [1.0, 1.0], 1), (None, [1.0, 0.01], 0), (None, [-1.0, 0.0], 0), (None, [-2.0, 0.0], 0), (9, None, 0), (None, None, 0), (5, [1.0, 0.0], None)]
    rows += [(50, [1.0, i / 1000], 2) for i in range(7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or a[1] is None or b[1] is None:
            return False
        u, v = np.array(a[1]), np.array(b[1])
        return u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98

    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if i != j and linked(a, b):
                    group[i] = group[j] = min(group[i], group[j])
    want = []
    for i, a in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(known) if known else None
        want.append((a[0], sum(i != j and linked(a, b) for j, b in enumerate(rows)), least, a[0] == least))
    assert sorted([tuple(r) for r in covertree.near_embeddings(table, block=4).collect()], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_embeddings(spark, block):
    rng = np.random.default_rng(4)
    vectors = []
    for k in range(60):
        base = rng.normal(size=8)
        for _ in range(rng.integers(1, 5)):
            vectors.append((len(vectors), (base + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.2])).astype(np.float32).tolist(), int(k % 3)))
    n = len(vectors)
    vectors += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] + [1.0] * 7, 1), (n + 3, [None] + [1.0] * 7, 1), (n + 4, vectors[0][1], None), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [float("inf")] + [1.0] * 7, 0), (n + 8, [2 * x for x in vectors[0][1]], 0)]
    table = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, label int, unit string, dim int")
    found = {r.vec_id: r for r in covertree.near_embeddings(table, block=block).collect()}
    links = plain_links(vectors)
    degree = dict.fromkeys(range(len(vectors)), 0)
    parent = {i: i for i in degree}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert len(links) > 30 and len(found) == len(vectors)
    for i in degree:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (degree[i], root(i), root(i) == i), i


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    levels, node = covertree.cover_tree(x, 0.1, leaf=1)
    for above, level in zip(levels, levels[1:], strict=False):
        assert set(above.centers) <= set(level.centers)
    assert (np.linalg.norm(x - x[levels[-1].centers[node]], axis=1) <= levels[-1].radius[node] + 1e-12).all()
    assert levels[-1].radius.max() <= 0.125 + 1e-6


@pytest.mark.parametrize("spread, leaf", [(0.1, 48), (0.1, 4), (3.0, 48)])
def test_dual_traversal_finds_what_a_product_finds(spread, leaf, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 32))
    x = base[rng.integers(0, 30, 700)] + spread * rng.normal(size=(700, 32)) * rng.random((700, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[:400], x[400:]
    own = {(i, j) for u, v in covertree.dual_links(a, None, 0.98) for i, j in zip(u.tolist(), v.tolist(), strict=True)}
    assert {tuple(sorted(p)) for p in own} == {(i, j) for i, j in np.argwhere(a @ a.T >= 0.98).tolist() if i < j} and len(own) == len({tuple(sorted(p)) for p in own})
    both = {(i, j) for u, v in covertree.dual_links(a, b, 0.98) for i, j in zip(u.tolist(), v.tolist(), strict=True)}
    assert both == set(map(tuple, np.argwhere(a @ b.T >= 0.98).tolist()))


def test_no_vectors(spark):
    assert covertree.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    bags = [np.unique(rng.integers(0, 300, 20)) for _ in range(4000)]
    y = np.array([int(5 in b and 7 in b or 9 in b and 11 in b) for b in bags])
    for b in range(0, 1200):  # more pairs
        pair = ([5, 7], [9, 11], [5], [7])[b % 4]
        bags[b] = np.union1d(np.setdiff1d(bags[b], [5, 7, 9, 11]), pair)
        y[b] = int(b % 4 < 2)
    model = toxicity.fit(bags, y, epochs=25)
    w = {int(b): np.array(v) for b, v in zip(model.bucket, model.weights, strict=True)}

    def score(*terms):
        own = np.array([w[t] for t in terms])
        return w[-1][0] + own[:, 0].sum() + (own[0, 1:] @ own[1, 1:] if len(terms) == 2 else 0)

    assert score(5, 7) > max(score(5), score(7)) + 1


def test_train_and_score(spark):
    clean = [(i, f"the garden number {i} has many flowers and trees", "en", "s", 0, "", "", 0) for i in range(300)]
    rude = [(1000 + i, f"you are a total moronic{'abcdefgh'[i % 8]} fool number {i}", "en", "s", 0, "", "", 0) for i in range(100)]
    table = docs(spark, clean + rude)
    labels = spark.createDataFrame([(r[0], int(r[0] >= 1000)) for r in clean + rude if r[0] % 4], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(table, toxicity.train(table, labels)).collect()}
    held = [r for r in found.values() if r.doc_id % 4 == 0]
    assert all(r.predicted == int(r.doc_id >= 1000) for r in held)
    odd = toxicity.score(docs(spark), toxicity.train(table, labels)).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.train(empty(spark), labels)
    assert [r.predicted for r in toxicity.score(docs(spark), none).collect()] == [0] * len(rows())
    assert toxicity.score(empty(spark), none).collect() == []


def test_scores_are_sums_over_all_pairs_of_terms(spark):
    rng = np.random.default_rng(6)
    names = ["you", "awful", "fool", "Garden", "tree", "élan", "strange", "strangely"]
    ids = sorted({b for n in names[:6] for b in toxicity.buckets_of(n.lower().encode())})
    weights = rng.normal(0, 0.7, (len(ids), 1 + toxicity.FACTORS))
    model = toxicity.pd.DataFrame({"bucket": [-1, *ids], "weights": [[-0.3], *weights.tolist()]})
    texts = [(i, " ".join(rng.choice(names, rng.integers(0, 9))) + "!", "en", "s", 0, "", "", 0) for i in range(60)] + [(60, None, "en", "s", 0, "", "", 0), (60, "", "en", "s", 0, "", "", 0)]
    own = dict(zip(ids, weights, strict=True))

    def plain(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        terms = sorted({b for w in words for b in toxicity.buckets_of(w.encode()) if b in own})
        z = -0.3 + sum(own[t][0] for t in terms) + sum(own[a][1:] @ own[b][1:] for i, a in enumerate(terms) for b in terms[:i])
        return 1 / (1 + math.exp(-z))

    found = toxicity.score(docs(spark, texts), model).collect()
    assert sorted(round(r.score, 9) for r in found) == sorted(round(plain(t[1]), 9) for t in texts)
    assert all(r.predicted == int(r.score >= toxicity.THRESHOLD) for r in found) and len({round(r.score, 6) for r in found}) > 30


def test_copies_of_clean_texts_leave_the_bias_alone(spark):
    def found(copies):
        clean = [(i, f"the garden {'abcdefgh'[i % 8]} has many flowers {i}", "en", "s", 0, "", "", 0) for i in range(200)]
        same = [(3000 + i, "one page for all", "en", "s", 0, "", "", 0) for i in range(copies)]
        rude = [(1000 + i, f"you are a moronic fool {i}", "en", "s", 0, "", "", 0) for i in range(100)]
        labels = spark.createDataFrame([(r[0], int(1000 <= r[0] < 3000)) for r in clean + same + rude], "doc_id long, toxic int")
        model = toxicity.train(docs(spark, clean + same + rude), labels)
        bias = next(w[0] for b, w in zip(model.bucket, model.weights, strict=True) if b == -1)
        return bias - math.log(100 / (200 + copies))

    assert abs(found(600) - found(1)) < 0.3
