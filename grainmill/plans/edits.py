"""Queries for change logs, snapshots of timelines, chained audits, cursors and groups of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, matching, profile, validation
from ..operators.commands import apply
from ..operators.ids import ROW_ID
from ..session import scratch
from ..sources.versions import Versions
from ..streaming import compaction
from . import changelog, checkpoints, history
from .catalogue import add, table
from .more import JW, NAMED, _named, _numbered
from .recipe import Step

# --- change logs ----------------------------------------------------------------------------


def _log(s: SparkSession, d: str) -> DataFrame:
    """Every event as an entry: signups insert a row, errors delete it, the others write a cell."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "signup", "insert_row").when(F.col("event_type") == "error", "delete_row").otherwise("cell_edit")
    rows = F.array(((F.col("user_id") * 3 + 1) * 100).cast("long"))
    return e.select((F.col("event_id") + 1).cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), rows.alias("row_ids"), F.when(F.col("event_type") == "click", "c_name").otherwise("c_mktsegment").alias("column"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("string").alias("origin_id"))


def _batches(s: SparkSession, d: str) -> DataFrame:
    """The log as a stream of its files, the last batch of it folded once more."""
    at = scratch(s)
    states = Versions(s, f"{at}/states")
    states.write(_numbered(s, d), 0)
    rows = (F.element_at("row_ids", 1) / 300).cast("long") % 2
    for half in (0, 1):  # the order is that of the entries, so a batch has all entries of its rows
        _log(s, d).where(rows == half).write.mode("append").json(f"{at}/log")
        stream = s.readStream.schema(changelog.LOG).json(f"{at}/log")
        compaction.fold_stream(stream, states, f"{at}/checkpoint").awaitTermination()
    last = states.latest()
    compaction.fold_batch(states, _log(s, d), last - 1)
    return states.read(states.latest())


def _compacted(s: SparkSession, d: str) -> DataFrame:
    """A table with its log: a first half folded into a state, the rest read beside it."""
    t = changelog.EditedTable(s, scratch(s))
    t.create(_numbered(s, d))
    middle = _log(s, d).count() // 2
    t.append(_log(s, d).where(F.col("seq") <= middle))
    t.compact(force=True)
    t.append(_log(s, d).where(F.col("seq") > middle))
    return t.current()


FOLDED = f"""WITH e AS (SELECT (user_id * 3 + 1) * 100 AS id, event_id, event_type, (ts, event_id) AS o FROM events),
l AS (SELECT id, max(o) AS o, arg_max(event_type, o) AS kind FROM e WHERE event_type IN ('signup', 'error') GROUP BY id),
w AS (SELECT e.id, arg_max(event_id::VARCHAR, e.o) FILTER (event_type = 'click') AS name, arg_max(event_id::VARCHAR, e.o) FILTER (event_type <> 'click') AS segment FROM e LEFT JOIN l ON l.id = e.id WHERE event_type NOT IN ('signup', 'error') AND (l.o IS NULL OR e.o > l.o) GROUP BY e.id),
t AS (SELECT c_custkey::BIGINT * 100 AS id, c_name, c_mktsegment FROM customer),
k AS (SELECT id FROM t UNION SELECT id FROM l)
SELECT k.id AS {ROW_ID}, CASE WHEN w.name IS NOT NULL THEN w.name WHEN l.kind = 'signup' THEN NULL ELSE t.c_name END AS c_name, CASE WHEN w.segment IS NOT NULL THEN w.segment WHEN l.kind = 'signup' THEN NULL ELSE t.c_mktsegment END AS c_mktsegment
FROM k LEFT JOIN t USING (id) LEFT JOIN l ON l.id = k.id LEFT JOIN w ON w.id = k.id WHERE l.kind IS NULL OR l.kind = 'signup'"""
add("changelog_folded", lambda s, d: changelog.fold(_numbered(s, d), _log(s, d)), FOLDED)
add("changelog_compacted", _compacted, FOLDED)
add("changelog_stream", _batches, FOLDED)

# --- snapshots and audits of timelines ----------------------------------------------------------

SIGNS = [(str(i % 10), chr(98 + i)) for i in range(13)]


def _long(s: SparkSession, d: str) -> history.Timeline:
    """Thirteen commands, a snapshot after every fourth."""
    line = history.Timeline(_numbered(s, d), snapshots=Versions(s, scratch(s)), every=4, most=2)
    for find, to in SIGNS:
        line.run("replace", column="c_name", find=find, to=to)
    return line


def _replaced(n: int, column: str = "c_name") -> str:
    for find, to in SIGNS[:n]:
        column = f"replace({column}, '{find}', '{to}')"
    return column


def _undone(s: SparkSession, d: str) -> DataFrame:
    line = _long(s, d)
    line.undo()
    return line.undo()


add("history_snapshots", _undone, f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID}, {_replaced(11)} AS c_name, c_mktsegment FROM customer")
CHAIN = [Step("uppercase", {"column": "c_name"}), Step("replace", {"column": "c_mktsegment", "find": "BUILDING", "to": "house"}), Step("title_case", {"column": "c_mktsegment"}), Step("mask", {"column": "c_name", "first": 2, "last": 2})]
TITLE = "array_to_string(list_transform(string_split(lower(s2), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ')"
add("audit_chain", lambda s, d: validation.audit_chain(_numbered(s, d), CHAIN, most=10**9), f"""WITH t AS (SELECT *, {TITLE} AS s3, left(n1, 2) || repeat('*', length(n1) - 4) || right(n1, 2) AS n4 FROM (SELECT c_custkey::BIGINT * 100 AS row_id, c_name AS n0, upper(c_name) AS n1, c_mktsegment AS s0, replace(c_mktsegment, 'BUILDING', 'house') AS s2 FROM customer))
SELECT * FROM (SELECT '1' AS audit_entry_id, row_id, 'c_name' AS column_name, n0 AS previous_value, n1 AS new_value FROM t UNION ALL SELECT '2', row_id, 'c_mktsegment', s0, s2 FROM t UNION ALL SELECT '3', row_id, 'c_mktsegment', s2, s3 FROM t UNION ALL SELECT '4', row_id, 'c_name', n1, n4 FROM t) WHERE previous_value <> new_value""")

# --- pages by cursor --------------------------------------------------------------------------------


def _priced(s: SparkSession, d: str) -> DataFrame:
    """Orders whose prices are rounded to thousands, so that many tie, and some null."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias(ROW_ID), F.when(F.col("o_orderkey") % 50 != 7, F.round(F.col("o_totalprice") / 1000) * 1000).alias("price"))


PRICED = f"SELECT o_orderkey AS {ROW_ID}, CASE WHEN o_orderkey % 50 <> 7 THEN round(o_totalprice / 1000) * 1000 END AS price FROM orders"


def _walked(s: SparkSession, d: str, descending: bool, backward: bool) -> DataFrame:
    """The first pages, one after the other by the cursor of each one's last row, together; backward: from among the nulls."""
    df, found = _priced(s, d), []
    size = max(1, df.count() // 8)
    cursor = (True, None, 10**9) if backward else None
    for _ in range(5):
        rows, cursor = filters.page_and_cursor(df, size, "price", descending, cursor, backward)
        found.append(rows)
    whole = found[0]
    for page in found[1:]:
        whole = whole.unionByName(page)
    return whole


for name, descending, backward, order in (("page_sorted", False, False, f"price NULLS LAST, {ROW_ID}"), ("page_sorted_down", True, False, f"price DESC NULLS LAST, {ROW_ID}"), ("page_sorted_back", True, True, f"price ASC NULLS FIRST, {ROW_ID} DESC")):
    add(name, lambda s, d, x=descending, y=backward: _walked(s, d, x, y), f"SELECT * FROM ({PRICED}) ORDER BY {order} LIMIT 5 * (SELECT greatest(1, count(*) // 8) FROM orders)")

# --- groups of matches --------------------------------------------------------------------------------


def _alike(s: SparkSession, d: str) -> DataFrame:
    return matching.find_duplicates(_named(s, d), "v", "first_2_chars", maybe=97.0)


#: Chains by recursion: what each row reaches.
GROUPED = f"""WITH RECURSIVE {NAMED}, p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {JW} AS s FROM n a JOIN n b ON a.v[1:2] = b.v[1:2] AND a.id < b.id WHERE {JW} >= 0.97),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen), g AS MATERIALIZED (SELECT id AS row_id, min(seen) AS "group" FROM r GROUP BY id) """
add("match_groups", lambda s, d: matching.groups(_alike(s, d)), f"{GROUPED} SELECT * FROM g")
add("match_groups_merged", lambda s, d: matching.merge_groups(_named(s, d), _alike(s, d))[0], f"{GROUPED} SELECT id AS {ROW_ID}, v FROM n WHERE id NOT IN (SELECT row_id FROM g WHERE row_id <> \"group\")")
add("match_groups_details", lambda s, d: matching.merge_groups(_named(s, d), _alike(s, d), match_column="v")[1].select("pair_index", "similarity", F.get_json_object("kept_row_data", "$.v").alias("kept"), F.get_json_object("deleted_row_data", "$.v").alias("deleted")), f"""{GROUPED}
SELECT row_number() OVER (ORDER BY "group", row_id) - 1 AS pair_index, (SELECT round(max(round(s * 100, 1)))::INT FROM p WHERE row_id IN (a, b)) AS similarity, k.v AS kept, x.v AS deleted FROM g JOIN n k ON k.id = "group" JOIN n x ON x.id = row_id WHERE row_id <> "group\"""")


def _chained(s: SparkSession, d: str) -> DataFrame:
    """Merges one after the other: every third customer into the next, and that into the one after."""
    c = _numbered(s, d)
    k = F.col(ROW_ID) / 100
    pairs = c.where(k % 3 != 2).select((F.col(ROW_ID) + 100).alias("kept_id"), F.col(ROW_ID).alias("deleted_id"), F.lit(90.0).alias("similarity"), F.lit("c_name").alias("match_column"))
    return apply(c, "merge", pairs=pairs.join(c.select(F.col(ROW_ID).alias("kept_id")), "kept_id"))


add("merge_chains", _chained, f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID}, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 2 OR c_custkey = (SELECT max(c_custkey) FROM customer)")


# --- profiles -----------------------------------------------------------------------------------------


def _profiled(s: SparkSession, d: str) -> DataFrame:
    """Every column of lineitem by states for each file; an estimate within 2 % is told as the exact number."""
    t = table(s, d, "lineitem").withColumn("file", F.col("_metadata.file_name"))
    found = profile.profile(profile.states(t.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")), part="file"))
    names = [c for c in t.columns if c != "file"]
    exact = profile.distinct_counts(t, names)
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1), 0.02 * F.col("exact"))
    return found.join(exact, "column_name").select("column_name", "n_rows", "n_nulls", F.when(near, F.col("exact")).otherwise(F.col("n_distinct")).alias("n_distinct"))


LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
add("profile_columns", _profiled, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in LINE))
add("profile_common", lambda s, d: profile.profile(profile.states(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])).select("column_name", "least", "greatest", F.explode("common").alias("c")).select("column_name", "least", "greatest", F.col("c.item").alias("value"), F.col("c.count").alias("n")), " UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT min({c}) FROM lineitem) AS least, (SELECT max({c}) FROM lineitem) AS greatest, {c} AS value, count(*) AS n FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")))

# --- checkpoints and the status of steps ------------------------------------------------------


def _checkpoints(s: SparkSession, d: str) -> str:
    """A checkpoint of edited customers, worked on and kept once more: the path of the second."""
    at = scratch(s)
    line = history.Timeline(_numbered(s, d))
    line.run("lowercase", column="c_mktsegment")
    line.run("replace", column="c_mktsegment", find="building", to="house")
    line.run("delete_row", row_ids=[100, 800])
    kept = checkpoints.checkpoint(line, f"{at}/1", "customer")
    kept.run("title_case", column="c_mktsegment")
    kept.run("hash", column="c_name", secret="s3cret")
    checkpoints.checkpoint(kept, f"{at}/2", "customer_1", parent=f"{at}/1")
    return f"{at}/2"


LEFT = "FROM customer WHERE c_custkey NOT IN (1, 8)"
add("checkpoint_rows", lambda s, d: checkpoints.read(s, _checkpoints(s, d)).select(ROW_ID, "c_mktsegment"), f"SELECT c_custkey::BIGINT * 100 AS {ROW_ID}, CASE WHEN c_mktsegment = 'BUILDING' THEN 'House' ELSE c_mktsegment[1] || lower(c_mktsegment[2:]) END AS c_mktsegment {LEFT}")
TOLD = (
    (1, 1, "customer", "lowercase", '{"column": "c_mktsegment"}', "FROM customer"),
    (1, 2, "customer", "replace", '{"column": "c_mktsegment", "find": "building", "to": "house"}', "FROM customer WHERE c_mktsegment = 'BUILDING'"),
    (1, 3, "customer", "delete_row", '{"row_ids": [100, 800]}', "FROM customer WHERE c_custkey IN (1, 8)"),
    (2, 1, "customer_1", "title_case", '{"column": "c_mktsegment"}', LEFT),
    (2, 2, "customer_1", "hash", '{"column": "c_name"}', LEFT),
)
add("checkpoint_lineage", lambda s, d: checkpoints.lineage(s, _checkpoints(s, d)).drop("checkpointed_at"), " UNION ALL ".join(f"SELECT {g} AS generation, {n} AS step, '{t}' AS source, '{a}' AS action, '{x}' AS details, count(*) AS rows_affected {rows}" for g, n, t, a, x, rows in TOLD))


def _statuses(s: SparkSession, d: str) -> DataFrame:
    """Steps of a recipe that calls the segment by another name: their status, and the rows that each would still change."""
    line = history.Timeline(_numbered(s, d))
    line.run("lowercase", column="c_mktsegment")
    line.run("uppercase", column="c_name")
    line.run("replace", column="c_mktsegment", find="building", to="house")
    names = {"segment": "c_mktsegment"}
    rows = []
    for step in (Step("lowercase", {"column": "segment"}), Step("uppercase", {"column": "c_name"}), Step("title_case", {"column": "segment"})):
        column = names.get(step.params["column"], step.params["column"])
        rows.append((step.command, line.status(step, names), validation.affected(line.current(), step.command, column).count()))
    return s.createDataFrame(rows, "command string, status string, open long")


add("step_status", _statuses, "SELECT 'lowercase' AS command, 'modified_since' AS status, 0 AS open UNION ALL SELECT 'uppercase', 'already_applied', 0 UNION ALL SELECT 'title_case', 'not_applied', count(*) FROM customer")
