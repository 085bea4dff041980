import pytest

from grainmill.functions import privacy
from grainmill.operators import combine, validation
from grainmill.operators.commands import CommandError
from grainmill.sources import files


def table(spark):
    rows = [(100, "a", "(5)", "2020-01-02"), (200, None, " ", "soon"), (300, " ", "$1", None), (400, "12345", None, "3/4/2021")]
    return spark.createDataFrame(rows, "_cs_id long, a string, b string, d string")


CASES = [
    ("trim", {"column": "a"}, [300]),
    ("lowercase", {"column": "b"}, []),
    ("replace_empty", {"column": "a"}, [200, 300]),
    ("fill_down", {"column": "b"}, [200, 400]),
    ("split_column", {"column": "b"}, [100, 300]),
    ("pad_zeros", {"column": "a", "length": 5}, [100, 300]),
    ("unformat_currency", {"column": "b"}, [100, 300]),
    ("fix_negatives", {"column": "b"}, [100]),
    ("cast_type", {"column": "a", "target": "INTEGER"}, [100, 300, 400]),
    ("mask", {"column": "b"}, [100, 200, 300]),
    ("hash", {"column": "a", "secret": "x"}, [100, 300, 400]),
    ("standardize_date", {"column": "d"}, [100, 400]),
    ("calculate_age", {"column": "d"}, [100, 400]),
    ("combine_columns", {"columns": "a, b"}, [100, 300, 400]),
    ("scrub_batch", {"rules": [{"column": "a", "method": "zero"}, {"column": "d", "method": "zero"}]}, [100, 200, 300, 400]),
    ("edit_cell", {"row_id": 200, "column": "a", "value": "x"}, [200]),
    ("delete_row", {"row_ids": [100, 400, 999]}, [100, 400]),
]


@pytest.mark.parametrize("name, params, want", CASES)
def test_affected(spark, name, params, want):
    df = table(spark)
    assert sorted(r[0] for r in validation.affected(df, name, **params).collect()) == want
    marked = validation.highlighted(df, name, most=1, **params)
    assert marked.columns == [*df.columns, "_highlight"]
    assert {r["_cs_id"]: r["_highlight"] for r in marked.collect()} == {i: int(i in want[:1]) for i in (100, 200, 300, 400)}


def test_affected_of_batches_and_whole_tables(spark):
    df = table(spark)
    edits = spark.createDataFrame([(100, "a", "x"), (100, "b", "y"), (300, "a", "z")], "row_id long, column string, value string")
    assert sorted(r[0] for r in validation.affected(df, "edit_batch", changes=edits).collect()) == [100, 300]
    assert all(validation.affected(df, n) is None for n in validation.WHOLE_TABLE)
    assert validation.highlighted(df, "remove_duplicates").where("_highlight = 0").count() == 4
    for call in (lambda: validation.affected(df, "fly"), lambda: validation.affected(df, "trim", column="gone")):
        with pytest.raises(CommandError):
            call()


def test_keys_cleaned(spark):
    left = spark.createDataFrame([(" a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a ", 1), ("b", 2), ("  ", 3)], "k string, n int")
    a, b, counts = combine.clean_both_keys(left, right, "k")
    assert counts == {"left": 1, "right": 2} and combine.join(a, b, "k").count() == 2
    with pytest.raises(CommandError):
        combine.clean_both_keys(left, right, "n")


def test_older_scrubbing(spark):
    df = spark.createDataFrame([("John7 4", "ab", "1600000000000"), (None, None, None), ("", "a", "2021-07-08 10:00")], "x string, y string, z string")

    def values(kind, column="x"):
        return [r[0] for r in df.select(privacy.legacy(df[column], kind, "s")).collect()]

    assert values("redact") == ["[REDACTED]", "", "[REDACTED]"]
    assert values("mask") == ["J*****4", "", ""] and values("mask", "y") == ["**", "", "*"]
    assert values("scramble") == ["47", "", ""] and values("last4", "z") == ["*********0000", "", "********1000"]
    assert values("zero") == ["John0 0", "", ""] and values("year_only", "z") == ["2020-01-01", "", "2021-01-01"]
    assert values("year_only") == ["John7 4", "", ""] and [len(v) for v in values("hash")] == [16, 0, 16]
    known = spark.createDataFrame([("ab", "K")], "original string, obfuscated string")
    rules = [{"column": "x", "method": "zero"}, {"column": "y", "method": "hash"}]
    out = [tuple(r) for r in privacy.legacy_scrub(df, rules, "s", known).collect()]
    assert sorted(out, key=str) == sorted([("John0 0", "K", "1600000000000"), (None, None, None), ("", values("hash", "y")[2], "2021-07-08 10:00")], key=str)
    assert [r[0] for r in privacy.legacy_scrub(df, rules, "s").collect()] == ["John0 0", None, ""]


@pytest.mark.parametrize("broken", [False, True])
def test_large_csv_is_split_unless_a_field_holds_a_line_break(spark, tmp_path, broken):
    rows = [f'{i},"said ""{i}"", köln"' for i in range(3000)]
    if broken:
        rows[2500] = '2500,"two\nlines"'
    (tmp_path / "t.csv").write_text("id,note\n" + "\n".join(rows) + "\n", encoding="utf-8")
    part = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(part)
    spark.conf.set(part, "8192")
    try:
        df = files.read_csv(spark, str(tmp_path / "t.csv"))
        assert (df.rdd.getNumPartitions() > 1) == (not broken)
        got = {r["id"]: r["note"] for r in df.collect()}
    finally:
        spark.conf.set(part, before)
    want = {i: f'said "{i}", köln' for i in range(3000)} | ({2500: "two\nlines"} if broken else {})
    assert got == want
