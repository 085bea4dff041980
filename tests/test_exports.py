import json
from pathlib import Path

import pytest

from grainmill.operators.diff import diff
from grainmill.sources.exports import ChunkedExport, write_document


def tables(spark, n=1000):
    a = spark.range(n).selectExpr("id AS k", "concat('v', id) AS v", "'old, \"x\"\\nline' AS gone")
    b = spark.range(3, n + 5).selectExpr("id AS k", "concat(IF(id % 10 = 0, 'w', 'v'), id) AS v")
    return diff(a.drop("gone"), b, ["k"]), diff(a, b, ["k"])


def parts(path):
    return sorted(p for p in Path(path).iterdir() if p.name.startswith("part-"))


def test_chunks_go_on_where_a_run_ended(spark, tmp_path):
    d, other = tables(spark)
    path = str(tmp_path / "out")
    first = ChunkedExport(spark, path)
    made = first.prepare(d, 25)
    assert made["summary"] == {"added": 5, "removed": 3, "modified": 99, "unchanged": 898}
    assert (made["rows"], made["chunks"]) == (107, 5)
    first.write(3)
    first.write(1)
    (tmp_path / "out/chunks/00000001/_SUCCESS").unlink()  # a chunk that a lost driver left half done
    seen = {p.name for p in parts(first.folder(3))}
    again = ChunkedExport(spark, path)
    assert again.missing() == [0, 1, 2, 4]
    assert again.run(d, 25) == [0, 1, 2, 4]
    assert again.run(d, 25) == []
    assert {p.name for p in parts(first.folder(3))} == seen
    rows = []
    for c in range(5):
        own = spark.read.option("header", True).csv(first.folder(c)).collect()
        assert len(own) == (25 if c < 4 else 7)
        rows += own
    assert sorted((r["Status"], int(r["k"])) for r in rows) == sorted([("removed", i) for i in range(3)] + [("added", 1000 + i) for i in range(5)] + [("modified", i) for i in range(10, 1000, 10)])
    by_b = [int(r["k"]) for r in rows if r["Status"] != "removed"]
    assert by_b == sorted(by_b)
    with pytest.raises(ValueError):
        again.run(other, 25)
    with pytest.raises(ValueError):
        again.run(d, 26)


def test_an_equal_table_has_no_chunks(spark, tmp_path):
    a = spark.range(10).selectExpr("id AS k", "id AS v")
    export = ChunkedExport(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        export.missing()
    assert export.run(diff(a, a, ["k"])) == []
    assert export.manifest()["summary"]["unchanged"] == 10


@pytest.mark.parametrize("one_file", [False, True])
def test_files_in_order_are_one_document(spark, tmp_path, one_file):
    _, d = tables(spark, 200)
    path = str(tmp_path / "doc")
    summary = write_document(d, path, unchanged=True, one_file=one_file)
    assert not one_file or len(parts(path)) == 1
    whole = json.loads("".join(p.read_text() for p in parts(path)))
    assert whole["meta"] == {"keyColumns": ["k"], "newColumns": ["gone"], "removedColumns": []}
    assert whole["summary"] == summary
    assert len(whole["results"]) == sum(summary.values()) == 205
    one = next(r for r in whole["results"] if r.get("rowA", {}).get("k") == 0)
    assert one == {"status": "removed", "rowA": {"k": 0, "v": "v0", "gone": 'old, "x"\nline'}, "rowB": {}, "modifiedColumns": []}


def test_an_empty_document(spark, tmp_path):
    a = spark.range(0).selectExpr("id AS k", "id AS v")
    path = str(tmp_path / "empty")
    write_document(diff(a, a, ["k"]), path)
    assert json.loads("".join(p.read_text() for p in parts(path)))["results"] == []
