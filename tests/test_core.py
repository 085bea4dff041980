"""Cases that the catalogue's tables do not hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from grainmill.functions import dates, privacy, similarity, text
from grainmill.functions.formula import FormulaError, columns_of, compile_formula, parse
from grainmill.operators import combine, diff, matching
from grainmill.operators.commands import CommandError, apply
from grainmill.operators.ids import ROW_ID, with_ids
from grainmill.plans import recipe
from grainmill.sources import files
from grainmill.streaming.recipes import drop_duplicates, run_stream


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert column(spark, ["  MIKE  JONES  ", None], F.trim) == ["MIKE  JONES", None]
    assert column(spark, ["hello  big wORLD", " ", None], text.title_case) == ["Hello  Big World", " ", None]
    assert column(spark, ["São Paulo", "Łódź ß"], text.remove_accents) == ["Sao Paulo", "Łodz ß"]
    assert column(spark, ["Bob\tWil\nson"], text.remove_non_printable) == ["BobWilson"]
    assert column(spark, ["$(750.00)", "(500)", "$1,234.5", "x", None], text.fix_negatives)[:2] == [-750.0, -500.0]
    assert column(spark, ["($1,000)", "€5", "x"], text.unformat_currency) == [-1000.0, 5.0, None]
    assert column(spark, ["123", "1234567"], text.pad_zeros) == ["00123", "12345"]
    assert column(spark, ["a.b|A.B", "x"], lambda c: text.replace(c, "a.b", "$1\\", False)) == ["$1\\|$1\\", "x"]
    assert column(spark, ["Doe, Jané", "jane  DOE"], text.fingerprint) == ["doe jane", "doe jane"]
    assert column(spark, ["abab", "a", None], text.bigrams)[:2] == [["ab", "ba"], []]


def test_dates(spark):
    got = column(spark, ["03/15/1985", "15-03-1985", "20240115", "Jan 5, 2024", "5 March 2024", "2024-02-30", "2024", "2024-01-15 10:00", "13/01/2020"], dates.parse_text)
    assert [str(x) for x in got] == ["1985-03-15", "1985-03-15", "2024-01-15", "2024-01-05", "2024-03-05", "None", "None", "2024-01-15", "2020-01-13"]
    assert column(spark, ["1700000000", "1700000000000", "20240115", "x", None], dates.epoch_unit) == ["s", "ms", None, None, None]


def test_privacy(spark):
    assert column(spark, ["12-34", "123", "a1b"], privacy.scramble) == ["43214321"[:4] + "-" + "4321", "321", "a1b"]
    assert column(spark, ["4111-1111-1111-1234", "12"], privacy.last4) == ["************1234", "12"]
    assert column(spark, ["1985-06-07", "soon"], privacy.year_only) == ["1985-01-01", "soon"]
    assert column(spark, ["ab", "abcdefghij"], lambda c: privacy.mask(c, 1, 1, 5)) == ["**", "a*****j"]
    with pytest.raises(ValueError):
        privacy.scrub(spark.range(1), [{"column": "id", "method": "hash"}], "abc")


@pytest.mark.parametrize("word, codes", [("edge", ("AJ", "AJ")), ("church", ("XRX", "XRX")), ("sign", ("SKN", "SN")), ("laugh", ("L", "L")), ("burgh", ("PRK", "PRK")), ("Knight", ("NT", "NT")), ("nation", ("NX", "NX")), ("Xavier", ("SFR", "SFR")), ("Thomas", ("0MS", "TMS")), ("Asia", ("AX", "AS")), ("Wagner", ("AKNR", "ANR")), ("é1", ("", ""))])
def test_sounds(word, codes):
    assert similarity.phonetic(word) == codes


def test_field_similarity():
    assert similarity.field_similarity("", "") == 100 and similarity.field_similarity("a", "") == 0 and similarity.field_similarity("a", "B") == 0
    assert similarity.field_similarity("MARTHA", "marhta") == 96.1 and similarity.field_similarity("dixon", "dicksonx") == 81.3
    assert similarity.field_similarity("abc", "acb") == 60.0  # half a transposition, and the bonus below 0.7 too


def test_fill_down_keeps_rows_without_an_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None), (None, "z")], "n long, v string")
    assert sorted(map(tuple, apply(df, "fill_down", column="v", order="n", bucket=1).collect()), key=str) == sorted([(1, "a"), (2, "a"), (None, None), (None, "z")], key=str)


def test_csv_below_lines_of_its_own_in_latin(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('top line\nid,place\n1,"café\nnext"\n2,"a ""b"""\n'.encode("iso-8859-1"))
    assert [tuple(r) for r in files.read_csv(spark, str(path), header_row=2).collect()] == [(1, "café\nnext"), (2, 'a "b"')]
    assert files.preview(spark, str(path))["encoding"] == "iso-8859-1"


def test_jaro_winkler_like_duckdb():
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(400)]
    con = duckdb.connect()
    for a, b in zip(words[::2], words[1::2], strict=True):
        want = con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert similarity.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9), (a, b)
    assert similarity.jaro_winkler("", "") == 0 and similarity.metaphone_key("Jon") == similarity.metaphone_key("Jonn")


def test_formula_errors(spark):
    for bad in ("", "=", "LEN(", "1 +", "@a ? 1", '"open', "NOPE(1)", "LEN(1, 2)", "@missing"):
        with pytest.raises(FormulaError):
            compile_formula(bad, ["a"])
    assert columns_of(parse("=@b + @[a c] * @b")) == ["b", "a c"]
    df = spark.createDataFrame([(1, "x", None)], "a int, `b c` string, d string")
    got = df.select(*[compile_formula(f, df.columns).alias(str(i)) for i, f in enumerate(('@[b c] & @d & "!"', "@a / 0", "-@a * 2 + 3", "NOT(@a = 1)", '@a NOT IN (2, 3)', 'LEFT("abc", -1)', 'MID("abc", 0, 2)', 'SPLIT("a-b", "-", 0)', 'IFERROR(MOD(1, 0), "none")'))]).first()
    assert list(got) == ["x!", None, 1.0, False, True, "ab", "a", "", "none"]


def test_commands(spark):
    df = with_ids(spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), (None, 3)], "v string, n int"))
    assert sorted(r[ROW_ID] for r in df.collect()) == [100, 200, 300, 400]
    assert sorted(r[ROW_ID] for r in apply(df, "remove_duplicates").collect()) == [100, 200, 400]
    assert apply(df, "add_column", column="c", after=None).columns[0] == "c"
    for name, params, code in (("rename_column", {"column": "v", "new_name": "n"}, "COLUMN_EXISTS"), ("trim", {"column": "q"}, "COLUMN_NOT_FOUND"), ("delete_row", {"row_ids": []}, "NO_ROWS_SELECTED"), ("delete_row", {"row_ids": [7]}, "ROWS_NOT_FOUND"), ("custom_sql", {"sql": "TRUNCATE x"}, "FORBIDDEN_SQL"), ("excel_formula", {"formula": "1"}, "MISSING_OUTPUT_COLUMN"), ("nope", {}, "UNKNOWN_COMMAND")):
        with pytest.raises(CommandError) as e:
            apply(df, name, **params)
        assert e.value.code == code
    filled = apply(df, "fill_down", column="v", bucket=200).orderBy(ROW_ID).collect()
    assert [r.v for r in filled] == ["b", "a", "a", "a"]
    assert sorted(r[ROW_ID] for r in apply(apply(df, "insert_row"), "insert_row", at_end=True).collect())[::5] == [50, 500]


def test_joins_and_diffs(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (None, "z", 3)], "k int, v string, only_a int")
    b = spark.createDataFrame([("1", "x"), ("3", "w"), (None, "q")], "k string, v string")
    found = sorted((r.diff_status, r.a_v, r.b_v) for r in diff.diff(a, b, ["k"]).rows.select("diff_status", F.coalesce("a_v", F.lit("")).alias("a_v"), F.coalesce("b_v", F.lit("")).alias("b_v")).collect())
    assert found == [("added", "", "q"), ("added", "", "w"), ("modified", "x", "x"), ("removed", "y", ""), ("removed", "z", "")]
    assert not combine.validate_join(a, b, "nope")["valid"] and combine.validate_join(a, b, "k")["warnings"]
    assert combine.stack(a, b).count() == 6 and combine.validate_stack(a, b)["warnings"]
    with pytest.raises(CommandError):
        diff.diff(a, b, [ROW_ID])


def test_matching(spark):
    df = with_ids(spark.createDataFrame([("John Smith", "a"), ("Jon Smith", "a"), ("Sarah", None), ("Sara", "b"), ("", "c"), ("john smith", "z")], "name string, city string"))
    pairs = matching.find_duplicates(df, "name", "first_letter", maybe=85.0)
    assert {(r.a_row_id, r.b_row_id) for r in pairs.collect()} == {(100, 200), (100, 600), (200, 600), (300, 400)}
    rows = matching.field_similarities(pairs, ["city"]).collect()
    assert {r.field_similarities[0].status for r in rows} <= {"exact", "similar", "different"}
    assert matching.stratified(pairs, 2).count() == 2
    assert matching.find_duplicates(df, "name", "metaphone", maybe=85.0).count() >= 3


def test_recipes(spark):
    r = recipe.from_json('{"name": "x", "steps": [{"id": "1", "type": "transform:trim", "column": "Full-Name", "enabled": true}, {"type": "scrub:hash", "column": "Full-Name", "enabled": false}]}')
    df = spark.createDataFrame([(" a ",)], "full_name string")
    assert recipe.run(df, r).first()[0] == "a" and not recipe.requires_secret(r)
    assert recipe.match_columns(["A b", "c"], ["a_B", "C", "c"]) == {"A b": "a_B", "c": "c"}
    with pytest.raises(CommandError):
        recipe.from_json('{"steps": []}')


def test_files(spark, tmp_path):
    path = tmp_path / "odd file.csv"
    path.write_text('note\nmore\nid;name\n1;"a;b"\n2;c\n', encoding="utf-8")
    assert files.detect_delimiter(["id;name", '1;"a;b"']) == ";" and files.split_line('1,"a ""b"", c",') == ["1", 'a "b", c', ""]
    assert [tuple(r) for r in files.read_csv(spark, str(path), header_row=3).collect()] == [(1, "a;b"), (2, "c")]
    assert files.table_name("/x/1 odd-file.csv") == "t_1_odd_file" and files.detect_encoding("é".encode("latin-1") + b"abcdef") == "iso-8859-1"
    df = with_ids(spark.createDataFrame([(1, 'q"uo,te', None)], "id int, v string, w string"))
    files.write_csv(df, str(tmp_path / "out"), True)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True, escape='"').collect()] == [("1", 'q"uo,te', None)]
    files.write_snapshot(df, str(tmp_path / "snap.parquet"))
    assert files.load(spark, str(tmp_path / "snap.parquet")).count() == 1


def test_streams(spark, tmp_path):
    source = spark.createDataFrame([(1, " a ", "2024-01-01 00:00:00"), (1, " a ", "2024-01-01 00:00:00")], "id int, v string, ts string").selectExpr("id", "v", "cast(ts AS timestamp) ts")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    steps = recipe.Recipe("s", [recipe.Step("trim", {"column": "v"}), recipe.Step("uppercase", {"column": "v"})])
    out = drop_duplicates(run_stream(stream, steps), "ts", "1 hour", ["id"])
    query = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.id, r.v) for r in spark.table("streamed").collect()] == [(1, "A")]
    with pytest.raises(CommandError):
        run_stream(stream, recipe.Recipe("s", [recipe.Step("remove_duplicates")]))


def test_join_of_tables_with_a_column_named_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, _key string")
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(map(tuple, combine.join(left, right, "k", "left").collect())) == [(1, "a", "x"), (2, "b", None)]


def test_streamed_tables_may_be_folders(spark, tmp_path):
    from pyspark.sql.types import TimestampNTZType

    spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS ts, 1 AS k FROM range(3)").write.parquet(str(tmp_path / "t.parquet"))
    stream = spark.readStream.schema("ts timestamp_ntz, k int").parquet(str(tmp_path / "t[.]parquet"))
    seen = drop_duplicates(stream, "ts", "1 hour", ["k"])
    assert not isinstance(seen.schema["ts"].dataType, TimestampNTZType)
    query = seen.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    query.awaitTermination()
    assert [r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1]
