import collections

import pytest

import corpus_pipeline
from grainmill.llm import mixing, quality

from .helpers import DOC_SCHEMA, PASSAGE, rows
from .test_repeats import brute
from .test_simhash import jaccard, plain_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ola", "eti", "uno", "ami", "ire")]
    data = [r[:6] for r in rows()]
    data = [(100 + i, f"document {i} says " + " ".join(words[(i * 7 + k * k) % 45] + str(i * k % 13) for k in range(30 + i % 9)) + (" " + PASSAGE if i % 10 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(60)] + [r[:5] for r in data]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in data], ", ".join(DOC_SCHEMA.split(", ")[:5])).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages_follow_plain_versions(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = table.columns, table
    one = corpus_pipeline.quality_rules(spark, before, folder).cache()
    kept = collections.Counter(r.doc_id for r in quality.quality(before).collect() if r.kept)
    assert one.columns == columns and collections.Counter(r.doc_id for r in one.collect()) == kept
    two = corpus_pipeline.simhash_dedup(spark, one, folder).cache()
    own = [(r.doc_id, r.text) for r in one.collect()]
    links = [(a, b) for a, s in own for b, t in own if a < b and jaccard(s, t) >= 0.8]
    parts = plain_components({i for i, _ in own}, links)
    left = [r.doc_id for r in two.collect()]
    assert two.columns == columns and len(left) == len(set(left)) and set(left) == {i for i, c in parts.items() if i == c}
    three = corpus_pipeline.suffix_dedup(spark, two, folder).cache()
    texts = {r.doc_id: r.text for r in two.collect()}
    want = dict(zip(texts, (b[0] - b[1] for b in brute(list(texts.values()), 200)), strict=True))
    assert three.columns == columns and {r.doc_id: len(r.text.encode()) for r in three.collect()} == want
    assert any(want[i] < len(t.encode()) for i, t in texts.items())
    four = corpus_pipeline.mix_sources(spark, three, folder).cache()
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies})
    assert four.columns == columns and collections.Counter(r.doc_id for r in four.collect()) == copies
    five = corpus_pipeline.pack_sequences(spark, four, folder).collect()
    assert sum(r.length for r in five) == sum(r.doc_tokens for r in five if r.start == 0)
    assert collections.Counter(r.doc_id for r in five if r.start == 0) == copies


def test_run(spark, folder):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, folder).count() > 0
