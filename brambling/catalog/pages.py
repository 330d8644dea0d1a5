"""Ordered pages, totals beside pages, first rows of groups, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pages
from .registry import Tables, query


@query("ordered_limit", "SELECT event_id, ts FROM events WHERE event_type = 'click' AND user_id < 50 ORDER BY ts DESC, event_id LIMIT 10")
def ordered_limit(t: Tables):
    return pages.ordered(t.events.filter("event_type = 'click' AND user_id < 50").select("event_id", "ts"), [F.desc_nulls_last("ts"), F.asc("event_id")], 10)


@query("ordered_offset", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20 OFFSET 30")
def ordered_offset(t: Tables):
    return pages.ordered(t.events.select("event_id", "value"), [F.asc_nulls_last("value"), F.asc("event_id")], 20, 30)


@query("ordered_nulls", "SELECT event_id, nullif(user_id % 7, 0) AS g FROM events ORDER BY g DESC NULLS FIRST, event_id LIMIT 15")
def ordered_nulls(t: Tables):
    rows = t.events.select("event_id", F.nullif(F.col("user_id") % 7, F.lit(0)).alias("g"))
    return pages.ordered(rows, [F.desc_nulls_first("g"), F.asc("event_id")], 15)


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 OR o_totalprice = 100000 AND o_orderkey > 5 ORDER BY o_totalprice, o_orderkey LIMIT 20")
def keyset_page(t: Tables):
    return pages.after(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 100000.0, "o_orderkey", 5, 20)


@query("page_with_total", "SELECT event_id, ts, count(*) OVER () AS total FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 10 OFFSET 5")
def page_with_total(t: Tables):
    return pages.page_with_total(t.events.filter("event_type = 'view'").select("event_id", "ts"), [F.asc_nulls_last("ts"), F.asc("event_id")], 10, 5)


@query("latest_per_group", "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_group(t: Tables):
    return pages.latest(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("first_rows", "SELECT event_type, event_id, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS int) AS rn FROM events) WHERE rn <= 3")
def first_rows(t: Tables):
    return pages.first_rows(t.events, ["event_type"], [F.desc_nulls_last("value"), F.asc("event_id")], 3).select("event_type", "event_id", "rn")


@query("group_extremes", "SELECT user_id, min(ts) AS first_at, max(value) AS most FROM events GROUP BY 1")
def group_extremes(t: Tables):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("value").alias("most"))


@query(
    "window_functions",
    """SELECT event_id, CAST(rank() OVER w AS int) AS r, lag(event_id) OVER w AS before, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bigint) AS near
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def window_functions(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.rank().over(w).alias("r"), F.lag("event_id").over(w).alias("before"), F.count("*").over(w.rowsBetween(-2, 0)).alias("near"))


@query("set_operations", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def set_operations(t: Tables):
    kept = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(t.customer.filter("c_acctbal > 0").select("c_custkey"))
    return kept.exceptAll(t.supplier.select("s_suppkey").distinct()).unionAll(t.nation.select(F.col("n_nationkey").cast("long")))
