"""Whole results at sizes and layouts that the catalogue's small tables do not have."""

from pyspark.sql import functions as F

from grainmill.operators import filters, matching, temporal, validation
from grainmill.operators.ids import ROW_ID
from grainmill.sources import files


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_matching_and_merging_broadcast_nothing_that_grows(spark):
    """files are small beside the rows that they hold and that an explode makes of them."""
    c = spark.range(3000).select(F.col("id").alias(ROW_ID), F.concat(F.lit("Customer#"), F.lpad((F.col("id") % 1500).cast("string"), 9, "0")).alias("c_name"))
    found = matching.find_duplicates(c, "c_name", "fingerprint")
    assert "Broadcast" not in planned(found)
    pairs = found.select(F.col("a_row_id").alias("kept_id"), F.col("b_row_id").alias("deleted_id"), "similarity", F.lit("c_name").alias("match_column"))
    rows, audit = matching.merge_duplicates(c, pairs)
    assert "BroadcastHashJoin" not in planned(rows)
    assert planned(audit).count("BroadcastHashJoin") <= 1  # the rows' numbers, by a row for each partition
    assert rows.count() == 1500 and audit.count() == 1500


def test_audits_are_whole(spark):
    """the details went up to 10000."""
    before = spark.range(12_000).select(F.col("id").alias(ROW_ID), F.lit("a").alias("v"), F.lit("b").alias("w"))
    after = before.where(F.col(ROW_ID) >= 1000).withColumn("v", F.lit("x"))
    told = {r.change: r["count"] for r in validation.audit_all(before, after, "e").groupBy("change").count().collect()}
    assert told == {"modified": 11_000, "removed": 1000}
    assert validation.audit(before, after, ["v"], "e").count() == 11_000
    first = validation.audit_all(before, after, "e", most=3).collect()
    assert [(r.row_id, r.change) for r in first] == [(0, "removed"), (1, "removed"), (2, "removed")]


def test_json_lines_behind_an_empty_file(spark, tmp_path):
    """a folder's first file is empty where its first task had no row; a line may be longer than the head."""
    (tmp_path / "part-0.json").write_text("")
    (tmp_path / "part-1.json").write_text("".join(f'{{"k": {i}}}\n' for i in range(50)))
    assert files.read_json(spark, str(tmp_path)).count() == 50
    long = tmp_path / "long.json"
    long.write_text("".join(f'{{"k": {i}, "v": "{"x" * 70_000}"}}\n' for i in range(3)))
    assert files.read_json(spark, str(long)).count() == 3
    one = tmp_path / "array.json"
    one.write_text('[\n{"k": 1},\n{"k": 2}\n]')
    assert files.read_json(spark, str(one)).count() == 2


def test_encoding_behind_a_header_and_behind_plain_rows(spark, tmp_path):
    """the first file holds a header alone, or more than 64 kB without an accent."""
    folder = tmp_path / "headed"
    folder.mkdir()
    (folder / "part-0.csv").write_bytes(b'"k","mark"\n')
    (folder / "part-1.csv").write_bytes('"k","mark"\n"1","köln"\n'.encode("latin-1"))
    found = files.preview(spark, str(folder))
    assert (found["encoding"], found["lines"]) == ("iso-8859-1", ['"k","mark"', '"1","köln"'])
    assert [r.mark for r in files.read_csv(spark, str(folder)).collect()] == ["köln"]
    for encoding in ("utf-8", "latin-1"):
        late = tmp_path / f"{encoding}.csv"
        late.write_bytes(("k,mark\n" + "1,plain\n" * 10_000 + "2,köln\n").encode(encoding))
        assert files.read_csv(spark, str(late)).where("k = 2").first().mark == "köln"
    short = tmp_path / "short.csv"
    short.write_bytes("k,mark\n1,kö\n".encode("latin-1"))
    assert files.read_csv(spark, str(short)).first().mark == "kö"


def test_large_pages_go_through_no_single_task(spark, monkeypatch):
    """F8, F9, F10: a page of any size was put in order by one task."""
    monkeypatch.setattr(filters, "PAGE", 10)
    rows = [(i * 7 % 101, None if i % 9 == 0 else float(i % 5)) for i in range(101)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, price double").repartition(5)
    for descending in (False, True):
        want = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))
        got, cursor, sizes = [], None, []
        while True:
            page, cursor = filters.page_and_cursor(df, 30, "price", descending, cursor)
            assert "TakeOrdered" not in planned(page) and "GlobalLimit" not in planned(page)
            taken = [tuple(r) for r in page.collect()]
            got += taken
            sizes.append(len(taken))
            if cursor is None:
                break
        assert got == want and sizes == [30, 30, 30, 11]
        back = filters.sorted_page(df, 29, "price", descending, (want[70][1] is None, want[70][1], want[70][0]), True).collect()
        assert [tuple(r) for r in back] == want[40:70][::-1]
        few, cursor = filters.page_and_cursor(df, 5, "price", descending)
        assert [tuple(r) for r in few.collect()] == want[:5] and cursor == (want[4][1] is None, want[4][1], want[4][0])


def test_interval_joins_shuffle_only_what_is_read(spark):
    """every column of both sides went through the shuffle with each copy of a row."""
    spans = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("lo"), (F.col("id") + F.col("id") % 7).alias("hi"), F.concat(F.lit("unread"), F.col("id").cast("string")).alias("note"))
    counted = temporal.interval_join(spans, spans, ["k"], ("lo", "hi"), ("lo", "hi"), closed=False).groupBy("k").agg(F.count("*").alias("n"))
    assert "unread" not in planned(counted) and "BroadcastHashJoin" not in planned(counted)
    rows = [tuple(r) for r in spans.select("k", "lo", "hi").collect()]
    want = {k: sum(a[0] == b[0] == k and a[1] < b[2] and b[1] < a[2] for a in rows for b in rows) for k in range(3)}
    assert {r.k: r.n for r in counted.collect()} == want


def test_a_crowded_bucket_is_dealt_to_cells(spark, monkeypatch):
    """one task had all pairs of a bucket."""
    monkeypatch.setattr(temporal, "CELL", 20)
    points = spark.range(600).select(F.col("id").alias("p"), (F.col("id") % 10).cast("double").alias("x"))
    ranges = spark.range(300).select(F.col("id").alias("r"), (F.col("id") % 4).cast("double").alias("lo"), (F.col("id") % 4 + F.col("id") % 30).cast("double").alias("hi"))
    found = temporal.range_join(points, ranges, [], "x", ("lo", "hi"))
    assert "a_cell" in planned(found)
    got = sorted((r.p, r.r) for r in found.select("p", "r").collect())
    assert got == sorted((p, r) for p in range(600) for r in range(300) if r % 4 <= p % 10 <= r % 4 + r % 30)
