"""Queries for joins by time and by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from .catalogue import add, table

#: Orders moved into the month of the events, at noon of one of its days; many of a user fall on one.
MOVED = "TIMESTAMP '2024-01-01 12:00:00' + to_days((o_orderdate::DATE - DATE '1995-01-01')::INT % 30)"
SIDES = f"WITH e AS (SELECT event_id, user_id, ts FROM events), o AS (SELECT o_custkey AS user_id, {MOVED} AS placed, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) "


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 30
    placed = F.timestamp_add("DAY", day, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    return events, table(s, d, "orders").select(F.col("o_custkey").alias("user_id"), placed.alias("placed"), "o_orderkey")


def _asof(**options):
    return lambda s, d: temporal.asof_join(*_sides(s, d), ["user_id"], "ts", "placed", order=["o_orderkey"], **options)


FOUND = "e.event_id, e.user_id, e.ts"
add("asof_backward", _asof(), f"{SIDES} SELECT {FOUND}, o.placed, o.o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.placed")
add("asof_forward", _asof(direction="forward"), f"{SIDES} SELECT {FOUND}, o.placed, o.o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts <= o.placed")
add("asof_tolerance", _asof(tolerance=7200, how="inner"), f"{SIDES} SELECT {FOUND}, o.placed, o.o_orderkey FROM e ASOF JOIN o ON e.user_id = o.user_id AND e.ts >= o.placed WHERE e.ts - o.placed <= INTERVAL 2 HOURS")
add("asof_nearest", _asof(direction="nearest"), f"""{SIDES}, b AS (SELECT {FOUND}, o.placed, o.o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.placed),
f AS (SELECT {FOUND}, o.placed, o.o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts <= o.placed),
x AS (SELECT b.*, f.placed AS fp, f.o_orderkey AS fo, b.placed IS NULL OR f.placed - f.ts < b.ts - b.placed AS ahead FROM b JOIN f USING (event_id))
SELECT event_id, user_id, ts, CASE WHEN ahead THEN fp ELSE placed END AS placed, CASE WHEN ahead THEN fo ELSE o_orderkey END AS o_orderkey FROM x""")
#: Equal times: rows of one table by itself, each with the one before it.
add("asof_strict_self", lambda s, d: (lambda o: temporal.asof_join(o, o.select("user_id", F.col("placed").alias("earlier"), F.col("o_orderkey").alias("last")), ["user_id"], "placed", "earlier", exact=False, order=["last"]))(_sides(s, d)[1]), f"""WITH a AS (SELECT o_custkey AS user_id, {MOVED} AS placed, o_orderkey FROM orders), o AS (SELECT user_id, placed AS earlier, max(o_orderkey) AS last FROM a GROUP BY ALL)
SELECT a.*, o.earlier, o.last FROM a ASOF LEFT JOIN o ON a.user_id = o.user_id AND a.placed > o.earlier""")


def _spans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders open for days or for years, by customer, and lines for as many days as pieces, by supplier of the same number."""
    day = lambda c: F.col(c).cast("date")
    open_ = F.when(F.col("o_orderkey") % 97 == 0, 2000).otherwise(F.col("o_orderkey") % 30).cast("int")
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", day("o_orderdate").alias("lo"), F.date_add(day("o_orderdate"), open_).alias("hi"))
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate").alias("from"), F.date_add(day("l_shipdate"), F.col("l_quantity").cast("int")).alias("to"))
    return orders, lines


SPANS = """WITH a AS (SELECT o_custkey AS k, o_orderkey, o_orderdate::DATE AS lo, o_orderdate::DATE + (CASE WHEN o_orderkey % 97 = 0 THEN 2000 ELSE o_orderkey % 30 END)::INT AS hi FROM orders),
b AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS "from", l_shipdate::DATE + l_quantity::INT AS "to" FROM lineitem) """
add("interval_overlaps", lambda s, d: temporal.interval_join(*_spans(s, d), ["k"], ("lo", "hi"), ("from", "to")), f"{SPANS} SELECT a.*, b.* EXCLUDE (k) FROM a JOIN b ON a.k = b.k AND lo <= \"to\" AND \"from\" <= hi")
add("interval_overlaps_open", lambda s, d: temporal.interval_join(*_spans(s, d), ["k"], ("lo", "hi"), ("from", "to"), closed=False).groupBy("k").agg(F.count("*").alias("n")), f"{SPANS} SELECT a.k, count(*) AS n FROM a JOIN b ON a.k = b.k AND lo < \"to\" AND \"from\" < hi GROUP BY 1")
add("range_prices", lambda s, d: temporal.range_join(table(s, d, "part").select("p_partkey", "p_retailprice"), table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + F.col("s_suppkey") % 40).alias("hi")), [], "p_retailprice", ("lo", "hi")).select("p_partkey", "s_suppkey"), "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + s_suppkey % 40")
