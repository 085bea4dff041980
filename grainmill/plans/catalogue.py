"""Queries over the test tables, one for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy, text
from ..functions.formula import compile_formula
from ..operators import combine, diff, filters, matching, validation
from ..operators.commands import apply
from ..operators.ids import ROW_ID
from . import recipe as recipes
from .history import Timeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _command(name: str, command: str, source: str, key: str, column: str, sql: str, made: Callable[[], Column] | None = None, made_sql: str | None = None, **params) -> None:
    """A one-column command over a table, giving the key and ``v``."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        base = table(spark, d, source).select(key, (F.col(column) if made is None else made()).alias("v"))
        return apply(base, command, column="v", **params).select(key, "v")

    add(name, run, f"SELECT {key}, {sql} AS v FROM (SELECT {key}, {made_sql or column} AS v FROM {source})")


# --- flagship -----------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Trim and title-case a segment, keep positive balances, count by segment."""
    c = table(spark, d, "customer")
    c = apply(apply(c, "trim", column="c_mktsegment"), "title_case", column="c_mktsegment")
    kept = filters.where(c, [{"column": "c_acctbal", "operator": "gt", "value": 0}])
    return kept.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))


TITLE = "array_to_string(list_transform(string_split(lower(v), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ')"
add("flagship", flagship, f"SELECT segment, count(*) AS customers FROM (SELECT {TITLE} AS segment FROM (SELECT trim(c_mktsegment) AS v FROM customer WHERE c_acctbal > 0)) GROUP BY segment")

# --- text ---------------------------------------------------------------------------

PADDED, PADDED_SQL = (lambda: F.concat(F.lit("  "), "p_name", F.lit("\t  "))), "'  ' || p_name || chr(9) || '  '"
_command("text_trim", "trim", "part", "p_partkey", "p_name", "trim(v)", PADDED, PADDED_SQL)
_command("text_lower", "lowercase", "part", "p_partkey", "p_type", "lower(v)")
_command("text_upper", "uppercase", "part", "p_partkey", "p_name", "upper(v)")
_command("text_title", "title_case", "part", "p_partkey", "p_type", TITLE)
_command("text_sentence", "sentence_case", "orders", "o_orderkey", "o_orderpriority", "upper(v[1:1]) || lower(v[2:])")
_command("text_collapse", "collapse_spaces", "part", "p_partkey", "p_name", "regexp_replace(v, '[ \\t\\n\\r]+', ' ', 'g')", PADDED, PADDED_SQL)
_command("text_non_printable", "remove_non_printable", "part", "p_partkey", "p_name", "regexp_replace(v, '[\\x00-\\x1F\\x7F]', '', 'g')", PADDED, PADDED_SQL)
add(
    "text_accents",
    lambda s, d: apply(table(s, d, "documents").select("doc_id", F.col("text").alias("v")), "remove_accents", column="v").select("doc_id", F.md5(F.col("v").cast("binary")).alias("v")),
    "SELECT doc_id, md5(strip_accents(text)) AS v FROM documents",
)
_command("replace_contains", "replace", "part", "p_partkey", "p_type", "replace(v, 'E', '$1')", find="E", to="$1")
_command("replace_contains_any_case", "replace", "part", "p_partkey", "p_type", "regexp_replace(v, '[eE]', 'x.y', 'g')", find="e", to="x.y", case_sensitive=False)
_command("replace_exact", "replace", "orders", "o_orderkey", "o_orderpriority", "CASE WHEN v = '1-URGENT' THEN 'now' ELSE v END", find="1-URGENT", to="now", match="exact")
_command("replace_exact_any_case", "replace", "orders", "o_orderkey", "o_orderpriority", "CASE WHEN lower(v) = '1-urgent' THEN 'now' ELSE v END", find="1-Urgent", to="now", match="exact", case_sensitive="false")
BLANKED = lambda: F.when(F.col("o_orderkey") % 3 == 0, "  ").when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))
BLANKED_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN '  ' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END"
_command("replace_empty", "replace_empty", "orders", "o_orderkey", "o_orderpriority", "CASE WHEN v IS NULL OR trim(v) = '' THEN 'none' ELSE v END", BLANKED, BLANKED_SQL, to="none")
_command("pad_zeros", "pad_zeros", "part", "p_partkey", "p_partkey", "lpad(v::VARCHAR, 3, '0')", length=3)
MONEY = lambda: F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), F.abs(F.round(F.col("c_acctbal") * 100)).cast("long").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("$1,"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string")))
MONEY_SQL = "CASE WHEN c_acctbal < 0 THEN '($' || abs(round(c_acctbal * 100))::BIGINT::VARCHAR || ')' ELSE '$1,' || round(c_acctbal * 100)::BIGINT::VARCHAR END"
_command("unformat_currency", "unformat_currency", "customer", "c_custkey", "c_acctbal", "TRY_CAST(CASE WHEN regexp_full_match(v, '\\(.*\\)') THEN '-' || regexp_replace(v, '[()$, €]', '', 'g') ELSE regexp_replace(v, '[$, €£¥+]', '', 'g') END AS DOUBLE)", MONEY, MONEY_SQL)
_command("fix_negatives", "fix_negatives", "customer", "c_custkey", "c_acctbal", "TRY_CAST(CASE WHEN trim(v) LIKE '%(%)%' THEN '-' || regexp_replace(v, '[$(),]', '', 'g') ELSE replace(v, ',', '') END AS DOUBLE)", MONEY, MONEY_SQL)

# --- structure ----------------------------------------------------------------------

add("rename_column", lambda s, d: apply(table(s, d, "nation"), "rename_column", column="n_name", new_name="country"), "SELECT n_nationkey, n_name AS country, n_regionkey FROM nation")
add("remove_duplicates", lambda s, d: apply(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q")), "remove_duplicates"), "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity::INT AS q FROM lineitem")
add(
    "remove_duplicates_least_id",
    lambda s, d: apply(table(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_custkey", "o_orderstatus"), "remove_duplicates"),
    f"SELECT min(o_orderkey) AS {ROW_ID}, o_custkey, o_orderstatus FROM orders GROUP BY ALL",
)
_command("cast_integer", "cast_type", "part", "p_partkey", "p_retailprice", "TRY_CAST(v AS INTEGER)", lambda: F.concat((F.col("p_partkey") % 1000).cast("string"), F.lit(".7")), "(p_partkey % 1000)::VARCHAR || '.7'", target="INTEGER")
_command("cast_double", "cast_type", "part", "p_partkey", "p_name", "TRY_CAST(v AS DOUBLE)", lambda: F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".25"))).otherwise(F.col("p_name")), "CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR || '.25' ELSE p_name END", target="DOUBLE")
_command("cast_boolean", "cast_type", "part", "p_partkey", "p_name", "TRY_CAST(v AS BOOLEAN)", lambda: F.when(F.col("p_size") > 25, "true").otherwise("maybe"), "CASE WHEN p_size > 25 THEN 'true' ELSE 'maybe' END", target="BOOLEAN")
add("split_delimiter", lambda s, d: apply(table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("v")), "split_column", column="v", mode="delimiter", delimiter="-"), "SELECT o_orderkey, o_orderpriority AS v, string_split(o_orderpriority, '-')[1] AS v_1, string_split(o_orderpriority, '-')[2] AS v_2 FROM orders")
add("split_position", lambda s, d: apply(table(s, d, "part").select("p_partkey", F.col("p_type").alias("v")), "split_column", column="v", mode="position", position=4), "SELECT p_partkey, p_type AS v, v[1:4] AS v_1, v[5:] AS v_2 FROM part")
add("split_length", lambda s, d: apply(table(s, d, "nation").select("n_nationkey", F.substring("n_name", 1, 4).alias("v")), "split_column", column="v", mode="length", length=2), "SELECT n_nationkey, n_name[1:4] AS v, n_name[1:2] AS v_1, n_name[3:4] AS v_2 FROM nation")
add("combine_columns", lambda s, d: apply(table(s, d, "part").select("p_partkey", "p_brand", "p_type"), "combine_columns", columns="p_brand,p_type", delimiter="/"), "SELECT p_partkey, p_brand, p_type, concat_ws('/', nullif(trim(p_brand), ''), nullif(trim(p_type), '')) AS combined FROM part")
add("add_and_delete_column", lambda s, d: apply(apply(table(s, d, "region"), "add_column", column="note", type="VARCHAR", after="r_regionkey"), "delete_column", column="r_name"), "SELECT r_regionkey, NULL::VARCHAR AS note FROM region")
add(
    "fill_down",
    lambda s, d: apply(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 3, F.col("event_type")).alias("v")), "fill_down", column="v", order="event_id", bucket=1000),
    "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN event_type END AS v FROM events) SELECT event_id, coalesce(nullif(trim(v), ''), last_value(nullif(trim(v), '') IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM e",
)
add("custom_sql", lambda s, d: apply(table(s, d, "customer"), "custom_sql", sql="CREATE OR REPLACE TABLE input AS SELECT c_nationkey, count(*) AS n FROM input GROUP BY c_nationkey"), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey")
MIXED = lambda: F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
MIXED_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%B %-d, %Y') END"
PARSED = "coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%B %d, %Y'))"
_command("standardize_date", "standardize_date", "orders", "o_orderkey", "o_orderdate", f"strftime({PARSED}, '%d/%m/%Y')", MIXED, MIXED_SQL, format="DD/MM/YYYY")
_command("cast_date", "cast_type", "orders", "o_orderkey", "o_orderdate", f"CAST({PARSED} AS DATE)", MIXED, MIXED_SQL, target="DATE")
EPOCH = lambda: F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
_command("cast_date_epoch", "cast_type", "orders", "o_orderkey", "o_orderdate", "CAST(make_timestamp(v::BIGINT * 1000000) AS DATE)", EPOCH, "epoch(o_orderdate)::BIGINT::VARCHAR", target="DATE")
add("calculate_age", lambda s, d: apply(table(s, d, "orders").select("o_orderkey", MIXED().alias("v")), "calculate_age", column="v", on="2024-06-30").select("o_orderkey", "age"), f"SELECT o_orderkey, (2024 - year({PARSED}))::INT AS age FROM (SELECT o_orderkey, {MIXED_SQL} AS v FROM orders)")

# --- rows and cells -----------------------------------------------------------------


def _nations(s, d):
    return table(s, d, "nation").select((F.col("n_nationkey").cast("long") * 100 + 100).alias(ROW_ID), "n_name", "n_regionkey")


NATIONS = f"SELECT n_nationkey::BIGINT * 100 + 100 AS {ROW_ID}, n_name, n_regionkey FROM nation"
add("edit_cell", lambda s, d: apply(_nations(s, d), "edit_cell", row_id=300, column="n_name", value="x'y"), f"SELECT {ROW_ID}, CASE WHEN {ROW_ID} = 300 THEN 'x''y' ELSE n_name END AS n_name, n_regionkey FROM ({NATIONS})")
add("edit_batch", lambda s, d: apply(_nations(s, d), "edit_batch", changes=s.createDataFrame([(100, "n_name", None), (200, "n_regionkey", "9"), (200, "n_name", "b")], "row_id long, column string, value string")), f"SELECT {ROW_ID}, CASE {ROW_ID} WHEN 100 THEN NULL WHEN 200 THEN 'b' ELSE n_name END AS n_name, CASE WHEN {ROW_ID} = 200 THEN 9 ELSE n_regionkey END AS n_regionkey FROM ({NATIONS})")
add("insert_row", lambda s, d: apply(_nations(s, d), "insert_row", after=300), f"{NATIONS} UNION ALL SELECT 350, NULL, NULL")
add("delete_row", lambda s, d: apply(_nations(s, d), "delete_row", row_ids=[100, 700]), f"SELECT * FROM ({NATIONS}) WHERE {ROW_ID} NOT IN (100, 700)")

# --- privacy ------------------------------------------------------------------------

_command("scrub_hash", "hash", "customer", "c_custkey", "c_name", "md5(concat(v, 'secret'))", secret="secret")
_command("scrub_mask", "mask", "customer", "c_custkey", "c_name", "CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) END", first=2, last=2)
_command("scrub_redact", "redact", "orders", "o_orderkey", "o_orderpriority", "CASE WHEN v IS NOT NULL THEN '[REDACTED]' END", BLANKED, BLANKED_SQL)
_command("scrub_last4", "last4", "customer", "c_custkey", "c_name", "CASE WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) <= 4 THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE repeat('*', length(regexp_replace(v, '[^0-9]', '', 'g')) - 4) || right(regexp_replace(v, '[^0-9]', '', 'g'), 4) END")
_command("scrub_zero", "zero", "customer", "c_custkey", "c_name", "regexp_replace(v, '[0-9]', '0', 'g')")
_command("scrub_scramble", "scramble", "customer", "c_custkey", "c_name", "CASE WHEN regexp_full_match(v, '[0-9]+') THEN reverse(v) ELSE regexp_replace(v, '[0-9]+', reverse(regexp_replace(v, '[^0-9]', '', 'g')), 'g') END")
_command("scrub_year_only", "year_only", "orders", "o_orderkey", "o_orderdate", "strftime(TRY_CAST(v AS DATE), '%Y-01-01')", lambda: F.date_format("o_orderdate", "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')")
RULES = [{"column": "c_name", "method": "mask"}, {"column": "c_mktsegment", "method": "redact"}, {"column": "c_custkey", "method": "hash"}]
MASK5 = "CASE WHEN length(c_name) <= 2 THEN repeat('*', length(c_name)) ELSE left(c_name, 1) || repeat('*', least(length(c_name) - 2, 5)) || right(c_name, 1) END"
add("scrub_batch", lambda s, d: privacy.scrub(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), RULES, "pepper"), f"SELECT md5(concat(c_custkey::VARCHAR, 'pepper')) AS c_custkey, {MASK5} AS c_name, '[REDACTED]' AS c_mktsegment FROM customer")
add("scrub_key_map", lambda s, d: privacy.key_map(table(s, d, "customer"), RULES[:2]), f"SELECT DISTINCT 'c_name' AS column_name, c_name AS original, {MASK5} AS obfuscated FROM customer UNION ALL SELECT DISTINCT 'c_mktsegment', c_mktsegment, '[REDACTED]' FROM customer")

# --- filters, sorts, pages ----------------------------------------------------------


def _filter(name: str, source: str, key: str, where: str, *tests: dict) -> None:
    add(name, lambda s, d: filters.where(table(s, d, source), list(tests)).select(key), f"SELECT {key} FROM {source} WHERE {where}")


def _t(column: str, operator: str, value=None, value2=None) -> dict:
    return {"column": column, "operator": operator, "value": value, "value2": value2}


_filter("filter_contains", "part", "p_partkey", "contains(lower(p_type), 'larg')", _t("p_type", "contains", "Larg"))
_filter("filter_equals", "orders", "o_orderkey", "lower(o_orderpriority) = '1-urgent'", _t("o_orderpriority", "equals", "1-Urgent"))
_filter("filter_starts_ends", "part", "p_partkey", "starts_with(lower(p_type), 'm') AND ends_with(lower(p_type), 'm')", _t("p_type", "starts_with", "M"), _t("p_type", "ends_with", "M"))
_filter("filter_numeric", "customer", "c_custkey", "c_acctbal >= 10 AND c_acctbal < 5000", _t("c_acctbal", "gte", "10"), _t("c_acctbal", "lt", "5000"))
_filter("filter_between", "part", "p_partkey", "p_size BETWEEN 5 AND 9", _t("p_size", "between", 5, 9))
_filter("filter_eq", "part", "p_partkey", "p_size = 7", _t("p_size", "eq", "7"))
_filter("filter_gt_lte", "part", "p_partkey", "p_size > 40 AND p_size <= 45", _t("p_size", "gt", 40), _t("p_size", "lte", 45))
_filter("filter_dates", "orders", "o_orderkey", "o_orderdate::DATE > DATE '1996-01-01' AND o_orderdate::DATE < DATE '1997-01-01'", _t("o_orderdate", "date_after", "1996-01-01"), _t("o_orderdate", "date_before", "1997-01-01"))
_filter("filter_date_between", "orders", "o_orderkey", "o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'", _t("o_orderdate", "date_between", "1995-03-01", "1995-03-31"))
_filter("filter_not_empty", "documents", "doc_id", "text IS NOT NULL AND text <> ''", _t("text", "is_not_empty"))
_filter("filter_empty", "events", "event_id", "props IS NULL OR props = ''", _t("props", "is_empty"))
add("filter_boolean", lambda s, d: filters.where(table(s, d, "part").select("p_partkey", (F.col("p_size") > 20).alias("big")), [_t("big", "is_true")]), "SELECT p_partkey, p_size > 20 AS big FROM part WHERE p_size > 20")
add("sort_top", lambda s, d: filters.sort(table(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_totalprice"), "o_totalprice", True).limit(50), f"SELECT o_orderkey AS {ROW_ID}, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
add("page_offset", lambda s, d: filters.page(table(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_custkey"), 100, 25), f"SELECT o_orderkey AS {ROW_ID}, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
add("page_keyset", lambda s, d: filters.keyset_page(table(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_custkey"), 25, 500), f"SELECT o_orderkey AS {ROW_ID}, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 26")
add("page_keyset_back", lambda s, d: filters.keyset_page(table(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), "o_custkey"), 25, 500, True), f"SELECT o_orderkey AS {ROW_ID}, o_custkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 26")

# --- joins and sets -----------------------------------------------------------------


def _sides(s, d):
    """Whole tables; some keys of each are negated, so that they have no partner."""
    key = lambda c, n: F.when(F.col(c) % n == 0, -F.col(c)).otherwise(F.col(c)).alias("custkey")
    return table(s, d, "orders").select(key("o_custkey", 5), "o_orderkey"), table(s, d, "customer").select(key("c_custkey", 7), "c_name")


SIDES = "WITH o AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS custkey, o_orderkey FROM orders), c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS custkey, c_name FROM customer) "
for kind, words in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("full_outer", "FULL JOIN"), ("right", "RIGHT JOIN")):
    add(f"join_{kind}", lambda s, d, kind=kind: combine.join(*_sides(s, d), "custkey", kind), f"{SIDES} SELECT o.custkey, o_orderkey, c_name FROM o {words} c ON o.custkey = c.custkey")
add("join_semi", lambda s, d: combine.join(*_sides(s, d), "custkey", "semi"), f"{SIDES} SELECT * FROM o WHERE custkey IN (SELECT custkey FROM c)")
add("join_anti", lambda s, d: combine.join(*_sides(s, d), "custkey", "anti"), f"{SIDES} SELECT * FROM o WHERE custkey NOT IN (SELECT custkey FROM c)")
add("stack", lambda s, d: combine.stack(table(s, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), table(s, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")), "SELECT n_name AS name, n_regionkey, NULL::INT AS r_regionkey FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
add("set_intersect", lambda s, d: combine.intersect(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("set_except", lambda s, d: combine.subtract(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders").select(F.col("o_custkey").alias("k"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
add("join_clean_keys", lambda s, d: combine.join(combine.clean_keys(table(s, d, "nation").select(F.concat(F.lit(" "), "n_name").alias("name"), "n_nationkey"), "name"), table(s, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), "name"), "SELECT n_name AS name, n_nationkey, n_regionkey FROM nation")

# --- diff ---------------------------------------------------------------------------


def _diff(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    b = o.where("o_orderkey % 11 != 0").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "price")
    more = o.where("o_orderkey % 17 = 0").select(-F.col("o_orderkey").alias("o_orderkey"), "o_custkey", "o_orderstatus", "price")
    return diff.diff(o, b.unionByName(more.toDF("o_orderkey", "o_custkey", "o_orderstatus", "price")), ["o_orderkey"])


DIFF = """WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0
      UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 17 = 0),
x AS (SELECT a.o_orderkey AS a_o_orderkey, b.o_orderkey AS b_o_orderkey, a.o_orderstatus AS a_o_orderstatus, b.o_orderstatus AS b_o_orderstatus,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'modified' ELSE 'unchanged' END AS diff_status
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) """
DIFF_COLUMNS = "diff_status, a_o_orderkey, b_o_orderkey, a_o_orderstatus, b_o_orderstatus"
add("diff_rows", lambda s, d: _diff(s, d).changed().select(*DIFF_COLUMNS.split(", ")), f"{DIFF} SELECT {DIFF_COLUMNS} FROM x WHERE diff_status <> 'unchanged'")
add("diff_summary", lambda s, d: _diff(s, d).summary(), f'{DIFF} SELECT diff_status, count(*) AS "count" FROM x GROUP BY 1')
add("diff_modified_in_column", lambda s, d: _diff(s, d).modified_in("o_orderstatus").select("a_o_orderkey"), f"{DIFF} SELECT a_o_orderkey FROM x WHERE diff_status = 'modified'")
add("diff_modified_columns", lambda s, d: _diff(s, d).with_modified_columns().select(F.coalesce("a_o_orderkey", "b_o_orderkey").alias("k"), F.array_join("modified_columns", ",").alias("names")), f"{DIFF} SELECT coalesce(a_o_orderkey, b_o_orderkey) AS k, CASE WHEN diff_status = 'modified' THEN 'o_orderstatus' ELSE '' END AS names FROM x")
add("diff_by_row_id", lambda s, d: diff.diff(_nations(s, d), apply(_nations(s, d), "edit_cell", row_id=300, column="n_name", value="Z")).summary(), "SELECT * FROM (VALUES ('modified', 1::BIGINT), ('unchanged', 24::BIGINT)) t(diff_status, \"count\")")
add("diff_export", lambda s, d: diff.export_rows(_diff(s, d)).select("Status", "o_orderkey", "o_orderstatus"), f"{DIFF} SELECT diff_status AS \"Status\", coalesce(b_o_orderkey, a_o_orderkey)::VARCHAR AS o_orderkey, coalesce(b_o_orderstatus, a_o_orderstatus) AS o_orderstatus FROM x WHERE diff_status <> 'unchanged'")

# --- matching and clusters ----------------------------------------------------------


def _match(name: str, strategy: str, block: str, maybe: float) -> None:
    """Different part names with their brands, by their first row."""

    def run(s: SparkSession, d: str) -> DataFrame:
        n = table(s, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("v")).agg(F.min("p_partkey").cast("long").alias(ROW_ID))
        return matching.find_duplicates(n, "v", strategy, maybe=maybe).select("a_row_id", "b_row_id", "similarity")

    add(name, run, f"WITH n AS (SELECT id, v, {block} AS block FROM (SELECT min(p_partkey)::BIGINT AS id, concat_ws(' ', p_name, p_brand) AS v FROM part GROUP BY 2)), p AS (SELECT a.id AS a, b.id AS b, jaro_winkler_similarity(least(lower(a.v), lower(b.v)), greatest(lower(a.v), lower(b.v))) AS s FROM n a JOIN n b ON a.block = b.block AND a.id < b.id) SELECT a AS a_row_id, b AS b_row_id, round(s * 100, 1) AS similarity FROM p WHERE s >= {maybe / 100}")


_match("match_first_letter", "first_letter", "upper(v[1:1])", 93.0)
_match("match_first_2_chars", "first_2_chars", "upper(regexp_replace(v, '[^a-zA-Z0-9]', '', 'g')[1:2])", 80.0)
_match("match_none", "none", "'ALL'", 90.0)


def _spelled(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias(ROW_ID), F.when(k % 3 == 0, F.upper("c_mktsegment")).when(k % 3 == 1, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("."))).otherwise(F.col("c_mktsegment")).alias("v"))


SPELLED = "SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN ' ' || lower(c_mktsegment) || '.' ELSE c_mktsegment END AS v FROM customer"
KEYED = f"SELECT v, count(*) AS n, array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(v), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '')), ' ') AS cluster_key FROM ({SPELLED}) GROUP BY v"
add("cluster_fingerprint", lambda s, d: matching.build_clusters(_spelled(s, d), "v").select("cluster_key", "master", "size", "row_count"), f"SELECT cluster_key, arg_min(v, (-n, v)) AS master, count(*) AS size, sum(n)::BIGINT AS row_count FROM ({KEYED}) GROUP BY cluster_key")
add("cluster_apply", lambda s, d: matching.apply_mappings(_spelled(s, d), "v", matching.mappings(matching.build_clusters(_spelled(s, d), "v"))).groupBy("v").count(), f'SELECT master AS v, sum(n)::BIGINT AS "count" FROM (SELECT n, first_value(v) OVER (PARTITION BY cluster_key ORDER BY n DESC, v) AS master FROM ({KEYED})) GROUP BY 1')
add("cluster_metaphone", lambda s, d: matching.build_clusters(_spelled(s, d), "v", "metaphone").select("cluster_key", "master", "size"))
add("cluster_token_phonetic", lambda s, d: matching.build_clusters(_spelled(s, d), "v", "token_phonetic").select("cluster_key", "master", "size"))


def _merged(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias(ROW_ID), "n_name")
    pairs = matching.find_duplicates(n, "n_name", "first_letter", maybe=75.0, limited=False)
    chosen = pairs.groupBy(F.col("b_row_id").alias("deleted_id")).agg(F.min("a_row_id").alias("kept_id"), F.max("similarity").alias("similarity")).withColumn("match_column", F.lit("n_name"))
    return matching.merge_duplicates(n, chosen)


add("match_merge", lambda s, d: _merged(s, d)[0], f"WITH n AS (SELECT n_nationkey::BIGINT AS id, n_name FROM nation) SELECT id AS {ROW_ID}, n_name FROM n WHERE id NOT IN (SELECT b.id FROM n a JOIN n b ON a.n_name[1:1] = b.n_name[1:1] AND a.id < b.id WHERE jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)) >= 0.75)")
add("match_merge_details", lambda s, d: _merged(s, d)[1])

# --- formulas -----------------------------------------------------------------------


def _formula(name: str, formula: str, source: str, key: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, source)
        return df.select(key, compile_formula(formula, df.columns).alias("v"))

    add(f"formula_{name}", run, f"SELECT {key}, {sql} AS v FROM {source}")


P, C, O = ("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")
INITCAP = "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ')"
for name, formula, (source, key), sql in (
    ("if", 'IF(@c_acctbal > 0, "plus", "minus")', C, "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END"),
    ("iferror", 'IFERROR(@p_size / (@p_size - 7), -1)', P, "CASE WHEN p_size = 7 THEN -1.0 ELSE p_size::DOUBLE / (p_size - 7) END"),
    ("len_upper", 'LEN(UPPER(@p_name))', P, "length(p_name)::INT"),
    ("lower_trim", 'LOWER(TRIM(@p_type))', P, "lower(trim(p_type))"),
    ("left_right", 'LEFT(@p_type, 3) & RIGHT(@p_type, 2)', P, "left(p_type, 3) || right(p_type, 2)"),
    ("left_negative", 'LEFT(@p_type, -3)', P, "left(p_type, -3)"),
    ("mid", 'MID(@p_type, 2, 4)', P, "substr(p_type, 2, 4)"),
    ("concat", 'CONCAT(@p_brand, "-", @p_size)', P, "concat(p_brand, '-', p_size)"),
    ("substitute", 'SUBSTITUTE(@p_type, "E", "3")', P, "replace(p_type, 'E', '3')"),
    ("proper", "PROPER(@p_type)", P, INITCAP),
    ("split", 'SPLIT(@o_orderpriority, "-", 2)', O, "split_part(o_orderpriority, '-', 2)"),
    ("lpad", 'LPAD(@p_size, 4, "0")', P, "lpad(p_size::VARCHAR, 4, '0')"),
    ("abs_ceiling_floor", "ABS(@c_acctbal) + CEILING(@c_acctbal) + FLOOR(@c_acctbal)", C, "abs(c_acctbal) + ceil(c_acctbal) + floor(c_acctbal)"),
    ("round", "ROUND(@c_acctbal)", C, "round(c_acctbal)"),
    ("sqrt_power", "SQRT(POWER(@p_size, 2))", P, "sqrt(pow(p_size, 2))"),
    ("mod", "MOD(@p_size, 7)", P, "(p_size % 7)::DOUBLE"),
    ("and_or_not", "AND(@p_size > 5, OR(@p_size < 9, NOT(@p_size < 40)))", P, "p_size > 5 AND (p_size < 9 OR NOT p_size < 40)"),
    ("infix", "(@p_size + 2) * 3 - -1 > 20 AND NOT (@p_size = 9) OR @p_size IN (1, 2)", P, "((p_size + 2) * 3 + 1 > 20 AND NOT p_size = 9) OR p_size IN (1, 2)"),
    ("coalesce_isblank", 'IF(ISBLANK(@p_name), "none", COALESCE(@p_name, "x"))', P, "CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'none' ELSE p_name END"),
    ("contains", 'OR(CONTAINS(@p_type, "LARGE"), ICONTAINS(@p_type, "promo"), STARTSWITH(@p_type, "L"), ENDSWITH(@p_type, "N"))', P, "contains(p_type, 'LARGE') OR contains(lower(p_type), 'promo') OR starts_with(p_type, 'L') OR ends_with(p_type, 'N')"),
    ("like", 'OR(LIKE(@p_type, "%LARGE%"), ILIKE(@p_type, "large%"))', P, "p_type LIKE '%LARGE%' OR p_type ILIKE 'large%'"),
    ("regex", 'REGEX(@p_brand, "[0-9]1")', P, "regexp_matches(p_brand, '[0-9]1')"),
    ("regexextract", 'REGEXEXTRACT(@p_brand, "[0-9]+")', P, "regexp_extract(p_brand, '[0-9]+')"),
    ("regexreplace", 'REGEXREPLACE(@p_brand, "([0-9])([0-9])", "\\2\\1")', P, "regexp_replace(p_brand, '([0-9])([0-9])', '\\2\\1', 'g')"),
    ("between", "BETWEEN(@p_size, 3, 8)", P, "p_size BETWEEN 3 AND 8"),
    ("dates", "YEAR(@o_orderdate) * 10000 + MONTH(@o_orderdate) * 100 + DAY(@o_orderdate)", O, "(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INT"),
    ("datediff", 'DATEDIFF("1995-01-01", @o_orderdate)', O, "date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT"),
):
    _formula(name, formula, source, key, sql)

# --- validation, previews, history, recipes -----------------------------------------


def _one(s: SparkSession, said: dict) -> DataFrame:
    figures = {k: v for k, v in said.items() if k in ("status", "code")} | {"n": next((int(v) for k, v in said.items() if k in ("duplicates", "parseable", "blank", "matches", "failed")), None)}
    return s.createDataFrame([tuple(figures.values())], "status string, code string, n long")


add("validate_replace", lambda s, d: _one(s, validation.validate(table(s, d, "part"), "replace", column="p_type", find="LARGE")), "SELECT 'valid' AS status, 'HAS_MATCHES' AS code, count(*) AS n FROM part WHERE contains(p_type, 'LARGE')")
add("validate_remove_duplicates", lambda s, d: _one(s, validation.validate(table(s, d, "lineitem").select("l_returnflag", "l_linestatus"), "remove_duplicates")), "SELECT 'valid' AS status, 'HAS_DUPLICATES' AS code, count(*) - count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem")
add("validate_dates", lambda s, d: _one(s, validation.validate(table(s, d, "orders").select(MIXED().alias("v")), "standardize_date", column="v")), "SELECT 'valid' AS status, 'ALL_PARSEABLE' AS code, count(*) AS n FROM orders")
add("validate_fill_down", lambda s, d: _one(s, validation.validate(table(s, d, "orders").select(BLANKED().alias("v")), "fill_down", column="v")), f"SELECT 'valid' AS status, 'HAS_EMPTY_VALUES' AS code, count(*) AS n FROM (SELECT {BLANKED_SQL} AS v FROM orders) WHERE v IS NULL OR trim(v) = ''")
add("validate_cast", lambda s, d: _one(s, validation.validate(table(s, d, "orders").select(F.col("o_orderpriority").alias("v")), "cast_type", column="v", target="DOUBLE")), "SELECT 'warning' AS status, 'PARTIAL_CAST' AS code, count(*) AS n FROM orders WHERE TRY_CAST(o_orderpriority AS DOUBLE) IS NULL")
add("validate_value", lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("v")).select("p_partkey", validation.value_fits("v", "TINYINT").alias("ok")), "SELECT p_partkey, p_partkey BETWEEN -128 AND 127 AS ok FROM part")
add("preview_changes", lambda s, d: validation.changes(table(s, d, "part").select(F.col("p_partkey").alias(ROW_ID), "p_type"), "replace", "p_type", find="LARGE", to="IRON"), f"SELECT p_partkey AS {ROW_ID}, p_type AS original, replace(p_type, 'LARGE', 'IRON') AS result FROM part WHERE contains(p_type, 'LARGE')")


def _timeline(s: SparkSession, d: str) -> Timeline:
    t = Timeline(_nations(s, d))
    t.run("lowercase", column="n_name")
    t.run("replace", column="n_name", find="a", to="4")
    t.run("pad_zeros", column="n_regionkey", length=3)
    return t


def _undone(s: SparkSession, d: str) -> DataFrame:
    t = _timeline(s, d)
    t.undo()
    t.undo()
    return t.redo()


add("history_undo_redo", _undone, f"SELECT {ROW_ID}, replace(lower(n_name), 'a', '4') AS n_name, n_regionkey FROM ({NATIONS})")
add("history_details", lambda s, d: _timeline(s, d).details(2), f"SELECT '2' AS audit_entry_id, {ROW_ID} AS row_id, 'n_name' AS column_name, lower(n_name) AS previous_value, replace(lower(n_name), 'a', '4') AS new_value FROM ({NATIONS}) WHERE contains(lower(n_name), 'a')")
RECIPE = recipes.Recipe("names", [recipes.Step("trim", {"column": "Name"}), recipes.Step("uppercase", {"column": "Name"}, False), recipes.Step("hash", {"column": "Name"}), recipes.Step("excel_formula", {"formula": "LEN(@Name) + @Size", "output_column": "total"})])
add("recipe", lambda s, d: recipes.run(table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("SIZE")), recipes.from_json(RECIPE.to_json()), "secret"), "SELECT p_partkey, md5(concat(trim(p_name), 'secret')) AS name, p_size AS \"SIZE\", (32 + p_size)::DOUBLE AS total FROM part")

# --- aggregates and windows ---------------------------------------------------------

add("agg_counts", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")), "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_quantity > 25) AS big, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
for kind, words in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)")):
    add(f"agg_{kind}", lambda s, d, kind=kind: getattr(table(s, d, "lineitem"), kind)("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY {words}")
RANKED = lambda: Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
add("window_rank_lag", lambda s, d: table(s, d, "orders").select("o_orderkey", F.row_number().over(RANKED()).alias("rn"), F.lag("o_orderkey").over(RANKED()).alias("before")), "SELECT o_orderkey, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
add("window_tumbling", lambda s, d: table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n")), "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
add("text_fingerprint", lambda s, d: table(s, d, "part").select("p_partkey", text.fingerprint(F.col("p_type")).alias("v")), "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(strip_accents(p_type)), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '')), ' ') AS v FROM part")
