"""Further queries: files, row ids, pages, checks, audits and matching, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import diff, filters, ids, matching, validation
from ..operators.commands import apply
from ..operators.ids import ROW_ID
from ..session import scratch
from ..sources import files
from . import catalogue, history, recipe
from .catalogue import DIFF, add, table

# --- files ----------------------------------------------------------------------------


def _csv(s: SparkSession, d: str, reader, writer) -> DataFrame:
    path = scratch(s)
    writer(table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, 'a "quoted", one\nand a second line').alias("note"), "c_acctbal"), path)
    return reader(path)


NOTED = "SELECT c_custkey::INT AS c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'a \"quoted\", one' || chr(10) || 'and a second line' END AS note, c_acctbal FROM customer"
add("source_csv", lambda s, d: _csv(s, d, lambda p: files.load(s, p, "csv", delimiter=","), files.write_csv), NOTED)


def _wizard(s: SparkSession, d: str) -> DataFrame:
    """Two lines and an empty one before the header, semicolons, and a line break in quotes."""
    path = scratch(s)
    rows = table(s, d, "nation").select(F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit(' ""x"";\n'), F.col("n_regionkey").cast("string"), F.lit('"'))).alias("line"))
    whole = rows.agg(F.concat(F.lit("exported by hand\nfrom a sheet\n\nkey;label\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("value"))
    whole.coalesce(1).write.text(path)
    return files.read_csv(s, path, header_row=4)


add("source_csv_wizard", _wizard, """SELECT n_nationkey::INT AS "key", n_name || ' "x";' || chr(10) || n_regionkey::VARCHAR AS label FROM nation""")


def _preview(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    table(s, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_nationkey", "n_name").write.option("sep", "|").csv(path)
    found = files.preview(s, path, 5)
    return s.createDataFrame([(i, x, found["delimiter"], found["encoding"]) for i, x in enumerate(found["lines"])], "i int, line string, delimiter string, encoding string")


add("source_preview", _preview, "SELECT n_nationkey::INT AS i, n_nationkey::VARCHAR || '|' || n_name AS line, '|' AS delimiter, 'utf-8' AS encoding FROM nation WHERE n_nationkey < 5")


def _stored(write, read):
    def run(s: SparkSession, d: str) -> DataFrame:
        path = scratch(s)
        write(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
        return read(s, path).select("o_orderkey", "o_custkey", "o_orderstatus")

    return run


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
add("source_snapshot", _stored(files.write_snapshot, files.read_parquet), ORDERS)
add("source_json", _stored(lambda df, p: df.write.json(p), files.read_json), "SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus FROM orders")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    files.write_csv(table(s, d, "customer").select("c_custkey", "c_name").coalesce(1).sortWithinPartitions("c_custkey"), path)
    return files.ingest(s, path, "csv", delimiter=",").select(ROW_ID, "c_custkey", "c_name")


add("ingest_with_ids", _ingested, f"SELECT row_number() OVER (ORDER BY c_custkey) * 100 AS {ROW_ID}, c_custkey::INT AS c_custkey, c_name FROM customer")
add("row_ids_in_order", lambda s, d: ids.with_ids(table(s, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).drop(ids.ORIGIN_ID), f"SELECT row_number() OVER (ORDER BY o_orderkey) * 100 AS {ROW_ID}, o_orderkey, o_custkey FROM orders")
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
add("row_ids_lineitem", lambda s, d: ids.with_ids(table(s, d, "lineitem"), [*LINE, "l_returnflag", "l_linestatus"]).drop(ids.ORIGIN_ID), f"SELECT row_number() OVER (ORDER BY {', '.join(LINE)}, l_returnflag, l_linestatus) * 100 AS {ROW_ID}, * FROM lineitem")
add("row_ids_documents", lambda s, d: ids.with_ids(table(s, d, "documents"), ["doc_id"]).drop(ids.ORIGIN_ID), f"SELECT row_number() OVER (ORDER BY doc_id) * 100 AS {ROW_ID}, * FROM documents")
add("renumber_lineitem", lambda s, d: ids.renumber(table(s, d, "lineitem").select((F.col("l_orderkey") * 3).alias(ROW_ID), "l_orderkey").distinct()), f"SELECT row_number() OVER (ORDER BY l_orderkey) * 100 AS {ROW_ID}, l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
add("duplicate_table", lambda s, d: ids.duplicate(table(s, d, "orders").withColumn(ROW_ID, F.col("o_orderkey") * 7), keep_ids=False).drop(ids.ORIGIN_ID), f"SELECT row_number() OVER (ORDER BY o_orderkey) * 100 AS {ROW_ID}, * FROM orders")


def _changes(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    log = table(s, d, "events").select(F.timestamp_seconds(F.col("event_id").cast("long")).alias("ts"), F.col("user_id").cast("long").alias("row_id"), F.col("event_type").alias("column"), F.col("event_id").cast("string").alias("value"))
    files.append_changes(log.where("row_id % 2 = 0"), path)
    files.append_changes(log.where("row_id % 2 <> 0"), path)
    return history.latest_changes(files.read_changes(s, path)).select("row_id", "column", "value")


add("changelog_latest", _changes, 'SELECT user_id::BIGINT AS row_id, event_type AS "column", max(event_id)::VARCHAR AS value FROM events GROUP BY 1, 2')

# --- filters and pages ------------------------------------------------------------------

add("filter_last_days", lambda s, d: table(s, d, "orders").where(filters.condition("o_orderdate", "last_n_days", 30, today=F.lit("1996-06-30").cast("date"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1996-06-30' - 30")
add("filter_fallback", lambda s, d: table(s, d, "part").where(filters.condition("p_type", "resembles", "%larg%")).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_type ILIKE '%larg%'")
add("filter_false", lambda s, d: filters.where(table(s, d, "part").select("p_partkey", (F.col("p_size") > 20).alias("big")), [{"column": "big", "operator": "is_false"}]), "SELECT p_partkey, p_size > 20 AS big FROM part WHERE NOT p_size > 20")
add("row_at_and_count", lambda s, d: (lambda o: s.createDataFrame([(filters.row_at(o, 10), filters.count(o, [{"column": "o_orderstatus", "operator": "equals", "value": "f"}]))], "row_id long, n long"))(table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias(ROW_ID), "o_orderstatus")), "SELECT (SELECT o_orderkey::BIGINT FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 10) AS row_id, (SELECT count(*) FROM orders WHERE lower(o_orderstatus) = 'f') AS n")
add("project_and_reorder", lambda s, d: ids.reorder(filters.project(ids.with_ids(table(s, d, "nation"))), ["n_name"]), "SELECT n_name, * EXCLUDE (n_name) FROM nation")

# --- windows, sets and pivots through SQL -------------------------------------------------


def _sql(name: str, source: str, sql: str, duck: str | None = None) -> None:
    add(name, lambda s, d: apply(table(s, d, source), "custom_sql", sql=sql), (duck or sql).replace("FROM input", f"FROM {source}"))


_sql("window_ntile_lead", "orders", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS part, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS place FROM input")
_sql("agg_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM input GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_sql("agg_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM input) PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM input GROUP BY 1")
add("cast_timestamp", lambda s, d: apply(table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd 10:30:00").alias("v")), "cast_type", column="v", target="TIMESTAMP"), "SELECT o_orderkey, (strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00')::TIMESTAMP AS v FROM orders")

# --- checks, previews and audits ------------------------------------------------------------

VALUES = ("12", " -7 ", "1.5", "300", "1e3", "2024-01-05", "1/5/2024", "5-1-24", "2024-01-05 10:30", "10:30:00", "Yes", "", "x")
FITS = {"UTINYINT": "0,3,11", "INTEGER": "0,1,3,11", "FLOAT": "0,1,2,3,4,11", "DECIMAL(10,2)": "0,1,2,3,11", "DATE": "5,6,7,11", "TIMESTAMP": "5,8,11", "TIME": "9,11", "BOOLEAN": "10,11", "UBIGINT": "0,3,11", "VARCHAR": ",".join(str(i) for i in range(13))}
FITS["UTINYINT"] = "0,11"


def _fits(s: SparkSession, d: str) -> DataFrame:
    """Which of some values each type takes, once for every region."""
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(VALUES)])
    values = table(s, d, "region").select("r_regionkey", F.inline(listed))
    each = [F.struct(F.lit(k).alias("kind"), validation.value_fits("v", k).alias("fits")) for k in FITS]
    return values.select("r_regionkey", "i", F.explode(F.array(*each)).alias("x")).where("x.fits").groupBy("r_regionkey", "x.kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i.cast("string")), ",").alias("found"))


add("validate_types", _fits, "SELECT r_regionkey, kind, found FROM region, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in FITS.items()) + ") t(kind, found)")


def _numbered(s: SparkSession, d: str, source: str = "customer") -> DataFrame:
    return table(s, d, source).select((F.col("c_custkey").cast("long") * 100).alias(ROW_ID), "c_name", "c_mktsegment")


add("affected_rows", lambda s, d: validation.affected(_numbered(s, d), "replace", "c_mktsegment", find="BUILDING", to="house"), f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID} FROM customer WHERE contains(c_mktsegment, 'BUILDING')")
add("preview_changes", lambda s, d: validation.changes(_numbered(s, d), "lowercase", "c_mktsegment"), f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID}, c_mktsegment AS original, lower(c_mktsegment) AS result FROM customer WHERE c_mktsegment <> lower(c_mktsegment)")
add("preview_split", lambda s, d: validation.preview_split(table(s, d, "nation").select("n_name"), "n_name", 100, mode="position", position=2).select("original", F.array_join("parts", "+").alias("parts")), "SELECT n_name AS original, n_name[1:2] || '+' || n_name[3:] AS parts FROM nation")
add("preview_combine", lambda s, d: validation.preview_combine(table(s, d, "nation").select("n_name", "n_regionkey"), ["n_name", "n_regionkey"], 100, delimiter="-").select("result"), "SELECT n_name || '-' || n_regionkey AS result FROM nation")
add("audit_added_removed", lambda s, d: (lambda c: validation.row_changes(c, apply(apply(c, "delete_row", row_ids=list(range(100, 5000, 700))), "insert_row", after=300), "e").select("row_id", "change", F.get_json_object("row", "$.c_name").alias("name")))(_numbered(s, d)), "SELECT c_custkey::BIGINT * 100 AS row_id, 'removed' AS change, c_name AS name FROM customer WHERE c_custkey < 50 AND c_custkey % 7 = 1 UNION ALL SELECT (300 + (SELECT min(c_custkey) * 100 FROM customer WHERE c_custkey > 3 AND (c_custkey >= 50 OR c_custkey % 7 <> 1))) // 2, 'added', NULL")
add("audit_page", lambda s, d: (lambda a, b: validation.audit_page(validation.audit(a, b, ["c_mktsegment"], "e"), 20, 5).select("row_id", "previous_value", "new_value"))(_numbered(s, d), apply(_numbered(s, d), "lowercase", column="c_mktsegment")), "SELECT c_custkey::BIGINT * 100 AS row_id, c_mktsegment AS previous_value, lower(c_mktsegment) AS new_value FROM customer WHERE c_mktsegment <> lower(c_mktsegment) ORDER BY 1 LIMIT 20 OFFSET 5")


def _steps(s: SparkSession, d: str) -> DataFrame:
    line = history.Timeline(_numbered(s, d))
    line.run("uppercase", column="c_name")
    line.run("replace", column="c_mktsegment", find="BUILDING", to="house")
    return line.step_diff(2).changed().select("row_id", "diff_status", "a_c_mktsegment", "b_c_mktsegment")


add("history_step_diff", _steps, "SELECT c_custkey::BIGINT * 100 AS row_id, 'modified' AS diff_status, c_mktsegment AS a_c_mktsegment, replace(c_mktsegment, 'BUILDING', 'house') AS b_c_mktsegment FROM customer WHERE contains(c_mktsegment, 'BUILDING')")
SHORTENED = f"SELECT {ROW_ID}, c_name, replace(c_mktsegment, 'BUILDING', 'house') AS c_mktsegment FROM input WHERE c_mktsegment <> 'MACHINERY'"


def _positions(s: SparkSession, d: str) -> DataFrame:
    line = history.Timeline(_numbered(s, d))
    line.run("uppercase", column="c_name")
    line.run("custom_sql", sql=SHORTENED)
    return s.createDataFrame([line.position_diff(1, 2)], "added_rows long, removed_rows long, modified_cells long")


add("history_position_diff", _positions, "SELECT 0::BIGINT AS added_rows, count(*) FILTER (c_mktsegment = 'MACHINERY') AS removed_rows, count(*) FILTER (contains(c_mktsegment, 'BUILDING')) AS modified_cells FROM customer")
add("audit_custom_sql", lambda s, d: validation.audit_all(_numbered(s, d), apply(_numbered(s, d), "custom_sql", sql=SHORTENED), "e").select("row_id", "change", "column_name", "previous_value", "new_value"), """SELECT c_custkey::BIGINT * 100 AS row_id, 'modified' AS change, 'c_mktsegment' AS column_name, c_mktsegment AS previous_value, 'house' AS new_value FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey::BIGINT * 100, 'removed', NULL, '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}', NULL FROM customer WHERE c_mktsegment = 'MACHINERY'""")
add("audit_prune", lambda s, d: history.prune(table(s, d, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").cast("date").alias("created_at")), 50), "SELECT o_orderkey AS entry_id, o_orderdate::DATE AS created_at FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey LIMIT 50")
add("recipe_extracted", lambda s, d: recipe.run(_numbered(s, d), recipe.from_json(recipe.extract([recipe.Step("trim", {"column": "c_name"}), recipe.Step("edit_cell", {"row_id": 100, "column": "c_name", "value": "x"}), recipe.Step("lowercase", {"column": "c_mktsegment"})], "taken").to_json())), f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID}, trim(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")

# --- differences ------------------------------------------------------------------------------

add("diff_narrow", lambda s, d: catalogue._diff(s, d).narrow().groupBy("diff_status").agg(F.count("*").alias("n")), f"{DIFF} SELECT diff_status, count(*) AS n FROM x GROUP BY 1")
add("diff_page", lambda s, d: diff.diff(_numbered(s, d), apply(_numbered(s, d), "replace", column="c_mktsegment", find="BUILDING", to="x")).page(10, after=100).select("row_id", "diff_status"), "SELECT c_custkey::BIGINT * 100 AS row_id, 'modified' AS diff_status FROM customer WHERE contains(c_mktsegment, 'BUILDING') AND c_custkey > 100 ORDER BY 1 LIMIT 10")
add("diff_json", lambda s, d: diff.export_json(catalogue._diff(s, d)).select(F.get_json_object("json", "$.status").alias("status"), F.get_json_object("json", "$.rowA.o_orderkey").alias("a"), F.get_json_object("json", "$.rowB.o_orderkey").alias("b")), f"{DIFF} SELECT diff_status AS status, a_o_orderkey::VARCHAR AS a, b_o_orderkey::VARCHAR AS b FROM x WHERE diff_status <> 'unchanged'")
add("diff_report", lambda s, d: (lambda r: s.createDataFrame([(k, v) for k, v in r["summary"].items()], "status string, n long"))(diff.export_report(catalogue._diff(s, d))), f"{DIFF} SELECT status, count(x.diff_status) AS n FROM (VALUES ('added'), ('removed'), ('modified'), ('unchanged')) t(status) LEFT JOIN x ON x.diff_status = status GROUP BY 1")

# --- matching and clusters ------------------------------------------------------------------------


def _twice(s: SparkSession, d: str) -> DataFrame:
    """Every customer, and again with the name in capitals under an id after the others."""
    c = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias(ROW_ID), "c_name")
    return c.unionByName(c.select((F.col(ROW_ID) + 10**9).alias(ROW_ID), F.upper("c_name").alias("c_name")))


add("match_customers_fingerprint", lambda s, d: matching.find_duplicates(_twice(s, d), "c_name", "fingerprint").select("a_row_id", "b_row_id", "similarity", "class"), "SELECT c_custkey::BIGINT AS a_row_id, c_custkey::BIGINT + 1000000000 AS b_row_id, 100.0::DOUBLE AS similarity, 'definite' AS class FROM customer")


def _named(s: SparkSession, d: str) -> DataFrame:
    """Different part names with their brands, by their first row."""
    return table(s, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("v")).agg(F.min("p_partkey").cast("long").alias(ROW_ID))


NAMED = "n AS MATERIALIZED (SELECT min(p_partkey)::BIGINT AS id, concat_ws(' ', p_name, p_brand) AS v FROM part GROUP BY 2)"
JW = "jaro_winkler_similarity(least(lower(a.v), lower(b.v)), greatest(lower(a.v), lower(b.v)))"
#: Blocks of 500 values and more need five points more; the best 1000 pairs of each block, 10000 in all.
LIMITED = f"""WITH {NAMED}, k AS (SELECT *, upper(v[1:1]) AS block, count(*) OVER (PARTITION BY upper(v[1:1])) AS size FROM n),
p AS (SELECT a.id AS a, b.id AS b, a.block, a.size, {JW} AS s FROM k a JOIN k b ON a.block = b.block AND a.id < b.id),
t AS (SELECT *, round(s * 100, 1) AS similarity, row_number() OVER (PARTITION BY block ORDER BY round(s * 100, 1) DESC, a, b) AS place FROM p WHERE s >= CASE WHEN size >= 500 THEN 0.85 ELSE 0.8 END)
SELECT a AS a_row_id, b AS b_row_id, similarity FROM t WHERE place <= 1000 ORDER BY similarity DESC, a, b LIMIT 10000"""
add("match_limited", lambda s, d: matching.find_duplicates(_named(s, d), "v", maybe=80.0, limited=True).select("a_row_id", "b_row_id", "similarity"), LIMITED)
#: A block of 2000 rows and more is sampled to the 500 whose ids have the smallest digests.
SAMPLED = """WITH c AS (SELECT c_custkey::BIGINT AS id, c_name AS v FROM customer UNION ALL SELECT c_custkey + 1000000000, upper(c_name) FROM customer),
k AS (SELECT * FROM (SELECT *, count(*) OVER () AS size, row_number() OVER (ORDER BY md5(id::VARCHAR), id) AS place FROM c) WHERE size < 2000 OR place <= 500),
p AS (SELECT a.id AS a, b.id AS b, a.size, jaro_winkler_similarity(least(lower(a.v), lower(b.v)), greatest(lower(a.v), lower(b.v))) AS s FROM k a JOIN k b ON a.id < b.id)
SELECT a AS a_row_id, b AS b_row_id, round(s * 100, 1) AS similarity FROM p WHERE s >= CASE WHEN size >= 500 AND size < 2000 THEN 0.65 ELSE 0.6 END ORDER BY 3 DESC, 1, 2 LIMIT 1000"""
add("match_limited_report", lambda s, d: matching.find_duplicates(_twice(s, d), "c_name", "first_letter", limited=True).select("a_row_id", "b_row_id", "similarity"), SAMPLED)
add("match_stratified", lambda s, d: matching.stratified(matching.find_duplicates(_named(s, d), "v", "first_2_chars", maybe=96.0), 500).select("a_row_id", "b_row_id", "similarity"), f"""WITH {NAMED}, p AS (SELECT a.id AS a, b.id AS b, {JW} AS s FROM n a JOIN n b ON a.v[1:2] = b.v[1:2] AND a.id < b.id)
SELECT a AS a_row_id, b AS b_row_id, round(s * 100, 1) AS similarity FROM p WHERE s >= 0.96 ORDER BY 3 DESC, 1, 2 LIMIT 500""")
add("sql_jaro_winkler", lambda s, d: (similarity.register(s), apply(table(s, d, "part"), "custom_sql", sql="SELECT p_partkey, jaro_winkler(p_name, p_type) AS v FROM input"))[1], "SELECT p_partkey, jaro_winkler_similarity(p_name, p_type) AS v FROM part")
add("bigrams", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(text.bigrams(F.col("p_type")), "|").alias("v")), "SELECT p_partkey, array_to_string(list_transform(range(1, length(p_type)), lambda i: substr(lower(p_type), i, 2)), '|') AS v FROM part")
#: The sounds of the five segments.
SOUNDS = {"AUTOMOBILE": "ATMP", "BUILDING": "PLTN", "FURNITURE": "FRNT", "MACHINERY": "MXNR", "HOUSEHOLD": "HSHL"}
CODES = "CASE upper(trim(regexp_replace(v, '[^A-Za-z]', '', 'g'))) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SOUNDS.items()) + " END"
for name in ("metaphone", "token_phonetic"):
    catalogue.SQL[f"cluster_{name}"] = f"SELECT cluster_key, arg_min(v, (-n, v)) AS master, count(*) AS size FROM (SELECT v, n, {CODES} AS cluster_key FROM ({catalogue.KEYED})) GROUP BY 1"
catalogue.SQL["match_merge_details"] = """WITH n AS (SELECT n_nationkey::BIGINT AS id, n_name FROM nation),
p AS (SELECT b.id AS deleted, min(a.id) AS kept, max(round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)) * 100, 1)) AS s FROM n a JOIN n b ON a.n_name[1:1] = b.n_name[1:1] AND a.id < b.id WHERE jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)) >= 0.75 GROUP BY b.id)
SELECT 'merge' AS audit_entry_id, row_number() OVER (ORDER BY kept, deleted) - 1 AS pair_index, round(s)::INT AS similarity, 'n_name' AS match_column,
  '{"n_name":"' || k.n_name || '"}' AS kept_row_data, '{"n_name":"' || x.n_name || '"}' AS deleted_row_data
FROM p JOIN n k ON k.id = kept JOIN n x ON x.id = deleted"""


def _chosen(s: SparkSession, d: str) -> DataFrame:
    found = matching.build_clusters(catalogue._spelled(s, d), "v")
    return matching.mapping_audit(catalogue._spelled(s, d), "v", matching.mappings(found, {"building": "Houses", "machinery": None}, left_out=["MACHINERY"]))


add("cluster_chosen_values", _chosen, f"SELECT v AS from_value, CASE WHEN cluster_key = 'building' THEN 'Houses' ELSE master END AS to_value, n AS row_count FROM (SELECT *, first_value(v) OVER (PARTITION BY cluster_key ORDER BY n DESC, v) AS master FROM ({catalogue.KEYED})) WHERE (cluster_key = 'building') OR (cluster_key = 'machinery' AND v <> master AND v <> 'MACHINERY')")
add("cluster_records", lambda s, d: filters.cluster_records(catalogue._spelled(s, d), "v", ["BUILDING"], "BUILDING", 10).agg(F.count("*").alias("n")), f"SELECT least(count(*), 10) AS n FROM ({catalogue.SPELLED}) WHERE v = 'BUILDING'")
add("standardize_command", lambda s, d: apply(catalogue._spelled(s, d), "standardize", column="v").groupBy("v").agg(F.count("*").alias("n")), catalogue.SQL["cluster_apply"].replace('AS "count"', "AS n"))
add("standardize_by_hand", lambda s, d: apply(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "standardize", column="c_mktsegment", mapping={"BUILDING": "Houses", "MACHINERY": None}), "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Houses' ELSE c_mktsegment END AS c_mktsegment FROM customer")


def _merging(s: SparkSession, d: str) -> DataFrame:
    found = matching.find_duplicates(_twice(s, d), "c_name", "fingerprint")
    return found.select(F.col("a_row_id").alias("kept_id"), F.col("b_row_id").alias("deleted_id"), "similarity", F.lit("c_name").alias("match_column"))


add("merge_command", lambda s, d: apply(_twice(s, d), "merge", pairs=_merging(s, d)), f"SELECT c_custkey::BIGINT AS {ROW_ID}, c_name FROM customer")
add("merge_audit_page", lambda s, d: validation.audit_page(matching.merge_duplicates(_twice(s, d), _merging(s, d))[1], 20, 5).select("pair_index", "similarity", "match_column", F.get_json_object("kept_row_data", "$.c_name").alias("kept")), "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pair_index, 100 AS similarity, 'c_name' AS match_column, c_name AS kept FROM customer ORDER BY 1 LIMIT 20 OFFSET 5")
add("page_arrow", lambda s, d: s.createDataFrame(filters.arrow_page(_numbered(s, d), 30, cursor=500)), f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID}, c_name, c_mktsegment FROM customer WHERE c_custkey > 5 ORDER BY 1 LIMIT 31")
