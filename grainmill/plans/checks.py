"""Queries for checks before joins and stacks, recipes and columns matched, ids spaced out again, and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import combine, diff, filters, ids, matching, validation
from ..operators.commands import CommandError, apply
from ..operators.ids import ROW_ID
from ..session import scratch
from ..sources import files
from ..streaming import recipes as streams
from . import recipe
from .catalogue import add, table
from .more import _numbered


def _values(schema: str, make):
    """A query over figures and names that a check gives, one row for each."""
    return lambda s, d: s.createDataFrame(list(make(s, d)), schema)


def _listed(columns: str, *rows: tuple) -> str:
    quoted = [", ".join(x if x.startswith("(") else "'" + x.replace("'", "''") + "'" for x in r) for r in rows]
    return "SELECT * FROM (VALUES " + ", ".join(f"({r})" for r in quoted) + f") t({columns})"


# --- checks before joins, stacks, diffs and clusters ----------------------------------------


def _join_warnings(s: SparkSession, d: str):
    spaced = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("k")
    left, right = table(s, d, "customer").select(spaced), table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    yield from (("names", w) for w in combine.validate_join(left, left.select(F.trim("k").alias("k")), "k")["warnings"])
    yield from (("keys", w) for w in combine.validate_join(right.select(F.col("k").cast("int").alias("k")), right.select(F.col("k").cast("long").alias("k")), "k")["warnings"])
    yield "missing", combine.validate_join(left, right.select(F.col("k").alias("other")), "k")["error"]


add("join_checks", _values("tables string, said string", _join_warnings), "SELECT 'names' AS tables, count(*) || ' left keys have blanks around them' AS said FROM customer WHERE c_custkey % 5 = 0 UNION ALL " + _listed("a, b", ("keys", "key types differ: int and bigint"), ("missing", "KEY_NOT_FOUND")))


def _stack_warnings(s: SparkSession, d: str):
    a = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"), "c_mktsegment")
    b = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    yield from ((w, None) for w in combine.validate_stack(a, b)["warnings"])
    yield "rows", combine.stack(a, b).count()


add("stack_checks", _values("said string, n long", _stack_warnings), "SELECT 'only in the first: c_mktsegment' AS said, NULL::BIGINT AS n UNION ALL SELECT 'types of nation differ: int and string', NULL UNION ALL SELECT 'rows', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")


def _refused_keys(s: SparkSession, d: str):
    a = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    b = table(s, d, "customer").select("c_custkey")
    for keys in ([ROW_ID], ["o_orderkey"], [], ["c_custkey"]):
        try:
            rows = diff.diff(a, b, keys).rows.count()
        except CommandError as e:
            yield ",".join(keys), e.code, None
        else:
            yield ",".join(keys), "", rows


add("diff_key_checks", _values("keys string, code string, n long", _refused_keys), "SELECT keys, code, NULL::BIGINT AS n FROM (" + _listed("keys, code", (ROW_ID, "INTERNAL_KEY"), ("o_orderkey", "KEY_NOT_FOUND"), ("", "NO_KEY")) + ") UNION ALL SELECT 'c_custkey', '', count(*) FROM orders FULL JOIN customer ON o_custkey = c_custkey")
add("diff_clipboard", lambda s, d: diff.clipboard(diff.diff(_numbered(s, d), apply(_numbered(s, d), "lowercase", column="c_mktsegment"))), "SELECT 'modified' AS \"Status\", c_name, lower(c_mktsegment) AS c_mktsegment FROM customer WHERE c_mktsegment <> lower(c_mktsegment) ORDER BY c_custkey LIMIT 100")


def _clustering(s: SparkSession, d: str):
    for most in (None, 3):
        said = matching.validate_clustering(table(s, d, "part"), "p_type", most)
        yield "none" if most is None else str(most), said["valid"], said["distinct"]


add("cluster_checks", _values("most string, valid boolean, n long", _clustering), "WITH t AS (SELECT count(DISTINCT p_type) AS n FROM part WHERE trim(p_type) <> '') SELECT 'none' AS most, n > 0 AS valid, n FROM t UNION ALL SELECT '3', n BETWEEN 1 AND 3, n FROM t")

# --- columns, filters and files ---------------------------------------------------------------


def _kinds(s: SparkSession, d: str):
    events = table(s, d, "events")
    for f in events.schema.fields:
        kind = filters.category(f.dataType)
        yield f.name, kind, len(filters.OPERATORS[kind]), filters.count(events, [{"column": f.name, "operator": "is_not_empty"}])


FULL = " UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS kind, {n}::INT AS n, count(*) FILTER ({name}::VARCHAR <> '') AS filled FROM events" for name, kind, n in (("event_id", "numeric", 8), ("ts", "date", 7), ("user_id", "numeric", 8), ("event_type", "text", 6), ("value", "numeric", 8), ("props", "text", 6)))
add("column_operators", _values("name string, kind string, n int, filled long", _kinds), FULL)
FILTERS = ({"column": "p_type", "operator": "is_empty"}, {"column": "p_name", "operator": "starts_with", "value": "b"}, {"column": "p_size", "operator": "between", "value": 1, "value2": 9})
add("filter_words", _values("said string, n long", lambda s, d: ((filters.describe(f), filters.count(table(s, d, "part"), [f])) for f in FILTERS)), "SELECT 'p_type is empty' AS said, count(*) AS n FROM part WHERE coalesce(p_type, '') = '' UNION ALL SELECT 'p_name starts with b', count(*) FROM part WHERE p_name ILIKE 'b%' UNION ALL SELECT 'p_size between 1 and 9', count(*) FROM part WHERE p_size BETWEEN 1 AND 9")
#: How a table is written, and what a look at its head must say.
SHEETS = {"semicolons": (";", "UTF-8", "kö"), "tabs": ("\t", "UTF-8", "漢"), "bars": ("|", "UTF-8", "x, y; z"), "latin": (",", "ISO-8859-1", "köln")}


def _sniffed(s: SparkSession, d: str):
    """All customers as files of each kind: what the heads say, and the rows that the reader gets by it."""
    for name, (sign, encoding, mark) in SHEETS.items():
        path = scratch(s)
        table(s, d, "customer").select("c_custkey", F.lit(mark).alias("mark"), "c_name").write.options(sep=sign, encoding=encoding, header=True, quoteAll=True).csv(path)
        found = files.preview(s, path)
        yield name, found["delimiter"], found["encoding"], files.read_csv(s, path).where(F.col("mark") == mark).count()


add("source_sniffed", _values("name string, delimiter string, encoding string, n long", _sniffed), "SELECT name, delimiter, encoding, (SELECT count(*) FROM customer) AS n FROM (VALUES ('semicolons', ';', 'utf-8'), ('tabs', chr(9), 'utf-8'), ('bars', '|', 'utf-8'), ('latin', ',', 'iso-8859-1')) t(name, delimiter, encoding)")

# --- ids ----------------------------------------------------------------------------------------

add("ids_rebalanced", lambda s, d: ids.rebalance(table(s, d, "customer").select(F.col("c_custkey").cast("long").alias(ROW_ID), "c_name"), 50, 1), f"""WITH near AS (SELECT c_custkey, (SELECT min(c_custkey) FROM customer WHERE c_custkey BETWEEN -50 AND 150) + (row_number() OVER (ORDER BY c_custkey) - 1) * 100 AS to_id FROM customer WHERE c_custkey BETWEEN -50 AND 150)
SELECT CASE WHEN c_custkey <= 150 THEN to_id ELSE c_custkey + (SELECT max(to_id) - max(c_custkey) FROM near) END AS {ROW_ID}, c_name FROM customer LEFT JOIN near USING (c_custkey)""")

# --- recipes --------------------------------------------------------------------------------------



def _recipe_problems(s: SparkSession, d: str):
    """Recipes whose steps are what the table says: the first has no name, and a step for every kind of event."""
    kinds = [r[0] for r in table(s, d, "events").select("event_type").distinct().orderBy("event_type").collect()]
    for raw in ({"steps": []}, {"name": "n", "steps": [{"type": "transform:trim"}, *[{"type": k} for k in kinds]]}):
        yield from ((x,) for x in recipe.check(raw))


add("recipe_checks", _values("said string", _recipe_problems), _listed("said", ("no name",), ("no steps",)) + " UNION ALL SELECT 'step ' || row_number() OVER (ORDER BY event_type) || ': unknown type ' || event_type FROM (SELECT DISTINCT event_type FROM events)")


def _matched(s: SparkSession, d: str):
    part = table(s, d, "part")
    for wanted, found in recipe.match_columns(["P_NAME", "p size", "p_brand", "gone"], part.columns).items():
        yield wanted, found, part.select(found).distinct().count() if found else 0


add("recipe_columns_matched", _values("wanted string, found string, n long", _matched), " UNION ALL ".join(f"SELECT '{w}' AS wanted, '{c}' AS found, count(DISTINCT {c}) AS n FROM part" for w, c in (("P_NAME", "p_name"), ("p size", "p_size"), ("p_brand", "p_brand"))) + " UNION ALL SELECT 'gone', NULL, 0")


CLEANING = recipe.Recipe("cleaning", [recipe.Step("uppercase", {"column": "p_name"}), recipe.Step("replace", {"column": "p_type", "find": "LARGE", "to": "BIG"}), recipe.Step("pad_zeros", {"column": "p_size", "length": 4})])
WIDER = recipe.Recipe("wider", [recipe.Step("rename_column", {"column": "n_name", "new_name": "nation"}), recipe.Step("delete_column", {"column": "n_regionkey"})])


def _previewed(s: SparkSession, d: str):
    found = recipe.preview(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), WIDER, 5)
    return [(",".join(found["columns"]), ",".join(found["new"]), ",".join(found["gone"]), len(found["rows"]))]


add("recipe_preview", _values("columns string, new string, gone string, n int", _previewed), "SELECT 'n_nationkey,nation' AS columns, 'nation' AS new, 'n_name,n_regionkey' AS gone, 5 AS n")

# --- streams ----------------------------------------------------------------------------------------


def _streamed(s: SparkSession, d: str, name: str, made) -> DataFrame:
    """All present files of a table through a stream, written as Parquet and read again.

    The path is a pattern, as a stream takes a folder or a pattern and a table may be a single file.
    """
    path = scratch(s)
    stream = made(s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}[.]parquet"))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(path)


add("stream_recipe", lambda s, d: _streamed(s, d, "part", lambda x: streams.run_stream(x.select("p_partkey", "p_name", "p_type", "p_size"), CLEANING)), "SELECT p_partkey, upper(p_name) AS p_name, replace(p_type, 'LARGE', 'BIG') AS p_type, lpad(p_size::VARCHAR, 4, '0') AS p_size FROM part")
add("stream_distinct", lambda s, d: _streamed(s, d, "events", lambda x: streams.drop_duplicates(x.select("ts", "user_id", "event_type"), "ts", "10000 days", ["user_id", "event_type"])).select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events")

# --- touched rows, keys cleaned, older scrubbing, blocks by sound ----------------------------------


def _padded(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select((F.col("p_partkey").cast("long") * 100).alias(ROW_ID), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string")).alias("size"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).alias("note"))


def _touched(s: SparkSession, d: str) -> DataFrame:
    df = _padded(s, d)
    calls = {"pad_zeros": {"column": "size", "length": 2}, "fill_down": {"column": "note"}, "cast_type": {"column": "size", "target": "INTEGER"}, "fix_negatives": {"column": "note"}, "combine_columns": {"columns": ["size", "note"]}, "scrub_batch": {"rules": [{"column": "size", "method": "zero"}]}, "trim": {"column": "note"}}
    each = [validation.affected(df, name, **p).select(F.lit(name).alias("command"), F.col(ROW_ID)) for name, p in calls.items()]
    return reduce(DataFrame.unionByName, each)


PADDED = f"WITH t AS (SELECT p_partkey::BIGINT * 100 AS {ROW_ID}, CASE WHEN p_partkey % 4 <> 0 THEN p_size::VARCHAR END AS size, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '(' || p_size || ')' END AS note FROM part) "
TOUCHES = {"pad_zeros": "length(size) < 2", "fill_down": "trim(note) = ''", "cast_type": "size IS NOT NULL", "fix_negatives": "note LIKE '(%)'", "combine_columns": "size IS NOT NULL OR trim(note) <> ''", "scrub_batch": "size IS NOT NULL", "trim": "note = ' '"}
add("affected_by_command", _touched, PADDED + " UNION ALL ".join(f"SELECT '{name}' AS command, {ROW_ID} FROM t WHERE {test}" for name, test in TOUCHES.items()))
add("highlighted", lambda s, d: validation.highlighted(_padded(s, d), "fill_down", most=20, column="note").select(ROW_ID, "_highlight"), PADDED + f"SELECT {ROW_ID}, (note = ' ' AND row_number() OVER (PARTITION BY note = ' ' ORDER BY {ROW_ID}) <= 20)::INT AS _highlight FROM t")


def _cleaned_keys(s: SparkSession, d: str):
    spaced = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("k")
    left = table(s, d, "customer").select(spaced)
    right = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.concat("c_name", F.lit("  ")).alias("k"), "c_acctbal")
    a, b, counts = combine.clean_both_keys(left, right, "k")
    yield counts["left"], counts["right"], combine.join(a, b, "k").count()


add("keys_cleaned", _values("left_cleaned long, right_cleaned long, joined long", _cleaned_keys), "SELECT count(*) FILTER (c_custkey % 5 = 0) AS left_cleaned, count(*) FILTER (c_custkey % 2 = 0) AS right_cleaned, count(*) FILTER (c_custkey % 2 = 0) AS joined FROM customer")


def _older(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").withColumn("born", F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("-05-06")))
    known = table(s, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_name").alias("original"), F.lit("known").alias("obfuscated"))
    columns = {"c_name": "hash", "c_mktsegment": "mask", "c_acctbal": "scramble", "born": "year_only"}
    return privacy.legacy_scrub(c.select("c_custkey", *columns), [{"column": k, "method": m} for k, m in columns.items()], "secret", known)


add("scrub_older", _older, """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'known' ELSE sha256(c_name || 'secret')[1:16] END AS c_name,
c_mktsegment[1] || repeat('*', least(length(c_mktsegment) - 2, 5)) || c_mktsegment[-1] AS c_mktsegment, reverse(regexp_replace(c_acctbal::VARCHAR, '[^0-9]', '', 'g')) AS c_acctbal, '19' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-01-01' AS born FROM customer""")
#: Segments as two people spell them, and their sounds.
SPELLINGS = {"BUILDING": "BILDING", "MACHINERY": "MASHINERY", "AUTOMOBILE": "AUTTOMOBILE", "FURNITURE": "FURNITUR", "HOUSEHOLD": "HOUSEHOLT"}


def _by_sound(s: SparkSession, d: str) -> DataFrame:
    """Segments of all customers spelled in two ways, paired within blocks of one sound; fields compared."""
    other = reduce(lambda c, x: F.when(F.col("c_mktsegment") == x[0], x[1]).otherwise(c), SPELLINGS.items(), F.col("c_mktsegment"))
    first = table(s, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").cast("long").alias(ROW_ID))
    both = first.select(ROW_ID, F.col("c_mktsegment").alias("v")).unionByName(first.select((F.col(ROW_ID) + 1_000_000_000).alias(ROW_ID), other.alias("v")))
    pairs = matching.field_similarities(matching.find_duplicates(both, "v", "metaphone"), ["v"])
    return pairs.select("a_v", "b_v", F.col("field_similarities")[0]["status"].alias("status"))


add("match_by_sound", _by_sound, "SELECT c_mktsegment AS a_v, spelled AS b_v, 'similar' AS status FROM (SELECT DISTINCT c_mktsegment FROM customer) JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SPELLINGS.items()) + ") t(segment, spelled) ON segment = c_mktsegment")
