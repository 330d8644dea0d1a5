"""Groups, distinct counts, grouping sets and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import counts, slices
from .registry import Tables, query


def _key():
    return F.nullif(F.col("user_id") % 7, F.lit(0))


_SQL_KEY = "nullif(user_id % 7, 0)"


@query("group_filtered", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def group_filtered(t: Tables):
    return counts.group_counts(t.events, "event_type", condition=F.col("value") > 50)


@query("group1", f"SELECT {_SQL_KEY} AS g, count(*) AS n FROM events GROUP BY 1")
def group1(t: Tables):
    return counts.group_counts(t.events, _key().alias("g"))


@query("group_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def group_users(t: Tables):
    return counts.group_counts(t.events, "user_id")


@query("group2", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group2(t: Tables):
    return counts.group_counts(t.lineitem, "l_returnflag", "l_linestatus")


@query("group3", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY ALL")
def group3(t: Tables):
    return counts.group_counts(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber", condition="l_quantity < 25")


@query("group_inlist", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def group_inlist(t: Tables):
    return counts.group_counts(t.orders, "o_orderpriority", condition=F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))


@query("group_coalesce", f"SELECT coalesce({_SQL_KEY}, 3) AS g, count(*) AS n FROM events GROUP BY 1")
def group_coalesce(t: Tables):
    return counts.group_counts(t.events, F.coalesce(_key(), F.lit(3)).alias("g"))


@query("group_expr", "SELECT user_id % 10 AS g, CAST(year(o.o_orderdate) AS int) AS y, count(*) AS n FROM events e JOIN orders o ON o.o_orderkey = e.event_id GROUP BY ALL")
def group_expr(t: Tables):
    both = t.events.join(t.orders, F.col("o_orderkey") == F.col("event_id"))
    return counts.group_counts(both, (F.col("user_id") % 10).alias("g"), F.year("o_orderdate").alias("y"))


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def group_having(t: Tables):
    return counts.group_counts(t.orders, "o_custkey", having="n > 15")


@query(
    "group_cells",
    """SELECT CASE WHEN event_type = 'click' THEN 2 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id IN (1, 2, 3) THEN 4 ELSE 0 END AS score,
    count(*) AS n FROM events GROUP BY 1""",
)
def group_cells(t: Tables):
    return counts.cells(t.events, {"click": (F.col("event_type") == "click", 2), "dear": (F.col("value") > 50, 1), "early": (F.col("user_id").isin(1, 2, 3), 4)})


@query(
    "filtered_counts",
    """SELECT event_type, count(*) FILTER (WHERE value > 90) AS dear, count(*) FILTER (WHERE user_id = 8) AS of8,
    count(*) FILTER (WHERE value > 90 AND user_id < 10) AS both FROM events GROUP BY 1""",
)
def filtered_counts(t: Tables):
    return counts.filtered_counts(t.events, {"dear": "value > 90", "of8": "user_id = 8", "both": "value > 90 AND user_id < 10"}, "event_type")


@query(
    "case_forms",
    """SELECT count(CASE WHEN value > 50 THEN 1 END) AS by_count, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS bigint) AS by_sum,
    CAST(sum(CASE WHEN value > 1e9 THEN 1 END) AS bigint) AS never FROM events""",
)
def case_forms(t: Tables):
    dear = F.col("value") > 50
    return t.events.agg(
        F.count(F.when(dear, 1)).alias("by_count"), F.sum(F.when(dear, 1).otherwise(0)).alias("by_sum"), F.sum(F.when(F.col("value") > 1e9, 1)).alias("never")
    )


@query("distinct_count", "SELECT count(DISTINCT user_id) AS n_distinct FROM events WHERE event_type = 'click'")
def distinct_count(t: Tables):
    return counts.distinct_count(t.events.filter("event_type = 'click'"), "user_id")


@query("distinct_grouped", f"SELECT event_type, count(DISTINCT {_SQL_KEY}) AS n_distinct FROM events GROUP BY 1")
def distinct_grouped(t: Tables):
    return counts.distinct_count(t.events.withColumn("g", _key()), "g", "event_type")


@query("distinct_unique", "SELECT event_type, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY 1")
def distinct_unique(t: Tables):
    return counts.distinct_count(t.events, "event_id", "event_type", unique=True)


@query("distinct_several", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_linenumber) AS l, count(*) AS n FROM lineitem GROUP BY 1")
def distinct_several(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("s"), F.countDistinct("l_linenumber").alias("l"), F.count("*").alias("n"))


@query("select_distinct", "SELECT DISTINCT event_type, user_id FROM events WHERE value > 20")
def select_distinct(t: Tables):
    return counts.select_distinct(t.events.filter("value > 20"), "event_type", "user_id")


_SETS = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS grouping_id, count(*) AS n, CAST(sum(l_linenumber) AS bigint) AS sum_l_linenumber FROM lineitem GROUP BY "


@query("gsets_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)")
def gsets_rollup(t: Tables):
    keys = ["l_returnflag", "l_linestatus"]
    return counts.grouping_sets(t.lineitem, keys, counts.rollup_sets(keys), ["l_linenumber"])


@query("gsets_cube", _SETS + "CUBE (l_returnflag, l_linestatus)")
def gsets_cube(t: Tables):
    keys = ["l_returnflag", "l_linestatus"]
    return counts.grouping_sets(t.lineitem, keys, counts.cube_sets(keys), ["l_linenumber"])


@query("gsets_sets", _SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def gsets_sets(t: Tables):
    return counts.grouping_sets(t.lineitem, ["l_returnflag", "l_linestatus"], [["l_returnflag"], ["l_linestatus"], []], ["l_linenumber"])


@query(
    "gsets_null_keys",
    f"SELECT g, event_type, grouping(g, event_type) AS grouping_id, count(*) AS n FROM (SELECT {_SQL_KEY} AS g, event_type FROM events) GROUP BY ROLLUP (g, event_type)",
)
def gsets_null_keys(t: Tables):
    keys = ["g", "event_type"]
    return counts.grouping_sets(t.events.withColumn("g", _key()), keys, counts.rollup_sets(keys))


@query(
    "gsets_native",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi,
    bool_and(l_quantity > 1) AS every_more, count(*) FILTER (WHERE l_quantity > 40) AS many FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def gsets_native(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("s"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"),
        F.bool_and(F.col("l_quantity") > 1).alias("every_more"), F.count_if(F.col("l_quantity") > 40).alias("many"),
    )


@query("percent_of_total", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM events GROUP BY 1")
def percent_of_total(t: Tables):
    counted = counts.group_counts(t.events, "event_type")
    # The window sees one row for each group.
    return counted.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query(
    "slice_aggregate",
    """SELECT count(p_size) AS n, CAST(sum(p_size) AS decimal(38,0)) AS total, avg(p_size) AS mean, min(p_size) AS least, max(p_size) AS most
    FROM part WHERE p_type = 'ECONOMY'""",
)
def slice_aggregate(t: Tables):
    return slices.slice_aggregate(t.part, "p_size", "p_type = 'ECONOMY'")


@query(
    "slice_aggregate_groups",
    """SELECT l_returnflag, l_linestatus, count(l_linenumber) AS n, CAST(sum(l_linenumber) AS decimal(38,0)) AS total, avg(l_linenumber) AS mean,
    min(l_linenumber) AS least, max(l_linenumber) AS most FROM lineitem WHERE l_quantity < 10 GROUP BY ALL""",
)
def slice_aggregate_groups(t: Tables):
    return slices.slice_aggregate(t.lineitem, "l_linenumber", "l_quantity < 10", ["l_returnflag", "l_linestatus"])


@query("slice_text", "SELECT count(l_linenumber) AS n, CAST(sum(l_linenumber) AS decimal(38,0)) AS total, CAST(min(l_linenumber) AS varchar) AS least, CAST(max(l_linenumber) AS varchar) AS most FROM lineitem WHERE l_linestatus = 'F'")
def slice_text(t: Tables):
    return slices.aggregate_as_text(t.lineitem, "l_linenumber", "l_linestatus = 'F'")


@query("slice_filter", "SELECT event_type, CAST(sum(user_id) FILTER (WHERE value > 50) AS bigint) AS s, min(user_id) FILTER (WHERE value > 99) AS m FROM events GROUP BY 1")
def slice_filter(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.when(F.col("value") > 50, F.col("user_id"))).alias("s"), F.min(F.when(F.col("value") > 99, F.col("user_id"))).alias("m"))


@query("bit_slice_sum", "SELECT count(user_id) AS n, CAST(sum(user_id) AS decimal(38,0)) AS total FROM events")
def bit_slice_sum(t: Tables):
    return slices.sum_from_slices(slices.bit_slices(t.events, "user_id", "event_id"), "bigint")


@query("minmax_beside_count", "SELECT count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_type = 'error'")
def minmax_beside_count(t: Tables):
    return t.events.filter("event_type = 'error'").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("key_aggregates", "SELECT CAST(sum(p_size * 2) AS bigint) AS s, avg(p_size) AS a, min(p_size % 7) AS lo, max(-p_size) AS hi, bool_or(p_size > 49) AS any_big, bool_and(p_size > 0) AS all_some FROM part")
def key_aggregates(t: Tables):
    size = F.col("p_size")
    return t.part.agg(F.sum(size * 2).alias("s"), F.avg(size).alias("a"), F.min(size % 7).alias("lo"), F.max(-size).alias("hi"), F.bool_or(size > 49).alias("any_big"), F.bool_and(size > 0).alias("all_some"))


@query("bit_aggregates", "SELECT p_type, bit_and(p_size) AS a, bit_or(p_size) AS o, bool_and(p_size > 2) AS e FROM part GROUP BY 1")
def bit_aggregates(t: Tables):
    return t.part.groupBy("p_type").agg(F.bit_and("p_size").alias("a"), F.bit_or("p_size").alias("o"), F.every(F.col("p_size") > 2).alias("e"))


@query("topk_groups", "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY n DESC, user_id NULLS LAST LIMIT 10")
def topk_groups(t: Tables):
    return counts.top_groups(t.events, ["user_id"], 10, F.col("event_type") != "view")


@query("capped_count", "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem WHERE l_quantity > 10 LIMIT 1000)")
def capped_count(t: Tables):
    return counts.capped_count(t.lineitem.filter("l_quantity > 10"), 1000)


@query("group_stats", f"SELECT count(*) AS n_groups, CAST(sum(n) AS bigint) AS n_rows FROM (SELECT {_SQL_KEY} AS g, count(*) AS n FROM events WHERE value > 10 GROUP BY 1)")
def group_stats(t: Tables):
    return counts.group_stats(t.events.withColumn("g", _key()), "g", "value > 10")


@query("two_level", "SELECT n, count(*) AS groups FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def two_level(t: Tables):
    return counts.group_counts(t.orders, "o_custkey").groupBy("n").agg(F.count("*").alias("groups"))


@query("collation_groups", "SELECT min(lower(p_brand)) AS brand, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS p_brand FROM part) GROUP BY lower(p_brand)")
def collation_groups(t: Tables):
    mixed = t.part.withColumn("b", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")))
    return mixed.groupBy(F.collate("b", "UTF8_LCASE").alias("b")).agg(F.count("*").alias("n")).select(F.lower(F.collate("b", "UTF8_BINARY")).alias("brand"), "n")
