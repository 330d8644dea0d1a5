"""Counting joins, semi and anti joins, labels, ordered joins, lateral subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts, joins, pages
from .registry import Tables, query


@query("fk_count", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def fk_count(t: Tables):
    return joins.join_counts(t.orders, t.customer, "o_custkey", "c_custkey", ["c_mktsegment"])


@query("fk_count_key", "SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def fk_count_key(t: Tables):
    return joins.join_counts(t.orders, t.customer, "o_custkey", "c_custkey", ["c_custkey"])


@query("fk_count_both", "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10 GROUP BY ALL")
def fk_count_both(t: Tables):
    return joins.join_counts(t.orders, t.customer.filter("c_nationkey < 10"), "o_custkey", "c_custkey", ["c_mktsegment"], ["o_orderstatus"])


@query("fk_sums", "SELECT p_brand, count(*) AS n, CAST(sum(l_linenumber) AS bigint) AS sum_l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def fk_sums(t: Tables):
    return joins.join_counts(t.lineitem, t.part, "l_partkey", "p_partkey", ["p_brand"], sums=["l_linenumber"])


@query(
    "fk_repeating_key",
    "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_nationkey GROUP BY 1",
)
def fk_repeating_key(t: Tables):
    return joins.join_counts(t.events, t.customer, "user_id", "c_nationkey", ["c_mktsegment"])


@query("fk_aggregates", "SELECT c_nationkey, count(DISTINCT o_orderstatus) AS d, min(o_orderdate) AS lo, max(c_mktsegment) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def fk_aggregates(t: Tables):
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("c_nationkey").agg(F.countDistinct("o_orderstatus").alias("d"), F.min("o_orderdate").alias("lo"), F.max("c_mktsegment").alias("hi"))


@query("fact_semi", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') GROUP BY 1")
def fact_semi(t: Tables):
    return joins.having_match(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("semi_repeating", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_repeating(t: Tables):
    return counts.count_where(joins.having_match(t.customer, t.orders.filter("o_totalprice > 200000"), "c_custkey", "o_custkey"))


@query("dim_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def dim_anti(t: Tables):
    return joins.lacking_match(t.customer, t.orders, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("left_is_null", "SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL")
def left_is_null(t: Tables):
    return counts.count_where(joins.lacking_match(t.customer, t.orders.filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey"))


@query("anti_condition", "SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)")
def anti_condition(t: Tables):
    return counts.count_where(joins.lacking_match(t.orders, t.lineitem.select("l_orderkey", "l_shipdate"), "o_orderkey", "l_orderkey", F.col("l_shipdate") > F.col("o_orderdate")))


@query("not_in", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_in(t: Tables):
    return counts.count_where(joins.not_in(t.customer, t.orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey"))


@query("not_in_null", "SELECT count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_nationkey < 5)")
def not_in_null(t: Tables):
    keys = t.nation.filter("n_nationkey < 5").select(F.nullif(F.col("n_nationkey"), F.lit(3)).alias("k"))
    return counts.count_where(joins.not_in(t.customer, keys, "c_nationkey", "k"))


@query("left_zero", "SELECT c_custkey, count(*) AS n_rows, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1")
def left_zero(t: Tables):
    return joins.dimension_counts(t.customer, t.orders.filter("o_orderstatus = 'O'"), "c_custkey", "o_custkey", ["c_custkey"])


@query("values_dim", "SELECT label, count(*) AS n FROM events JOIN (VALUES ('click', 'a'), ('click', 'b'), ('view', 'a'), ('none', 'c'), (NULL, 'd')) v(k, label) ON event_type = k GROUP BY 1")
def values_dim(t: Tables):
    dim = joins.values_dimension(t.events, [("click", "a"), ("click", "b"), ("view", "a"), ("none", "c"), (None, "d")], "k string, label string")
    return joins.join_counts(t.events, dim, "event_type", "k", ["label"])


@query(
    "star_count",
    """SELECT l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE p_type = 'ECONOMY' AND s_nationkey IN (1, 2, 3, 4, 5) GROUP BY 1""",
)
def star_count(t: Tables):
    dims = [(t.part.filter("p_type = 'ECONOMY'"), "l_partkey", "p_partkey"), (t.supplier.filter("s_nationkey IN (1, 2, 3, 4, 5)"), "l_suppkey", "s_suppkey")]
    return joins.star_counts(t.lineitem, dims, ["l_returnflag"])


@query(
    "snowflake_count",
    "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
def snowflake_count(t: Tables):
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.join_counts(t.orders, places, "o_custkey", "c_custkey", ["r_name"])


@query(
    "label_counts",
    """SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'other' END AS label, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey AND s_acctbal < 5000) GROUP BY 1""",
)
def label_counts(t: Tables):
    labels = {"debt": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING"}
    return joins.label_counts(t.orders, t.customer, "o_custkey", "c_custkey", labels, "other", (t.supplier.filter("s_acctbal < 5000"), "s_suppkey"))


@query(
    "ordered_join_page",
    """SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""",
)
def ordered_join_page(t: Tables):
    page = joins.ordered_page(t.orders, t.customer.filter("c_mktsegment = 'MACHINERY'"), "o_custkey", "c_custkey", [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 25)
    return page.select("o_orderkey", "o_orderdate", "c_name")


@query(
    "ordered_split_page",
    "SELECT c_mktsegment, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_mktsegment, o_totalprice DESC, o_orderkey LIMIT 40",
)
def ordered_split_page(t: Tables):
    page = joins.ordered_page(t.orders, t.customer, "o_custkey", "c_custkey", [F.asc("c_mktsegment"), F.desc("o_totalprice"), F.asc("o_orderkey")], 40)
    return page.select("c_mktsegment", "o_orderkey", "o_totalprice")


@query(
    "lateral_counts",
    """SELECT c_custkey, n, last_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_at FROM orders GROUP BY 1) ON o_custkey = c_custkey
    WHERE c_nationkey = 7""",
)
def lateral_counts(t: Tables):
    found = joins.lateral_counts(t.customer.filter("c_nationkey = 7"), t.orders, "c_custkey", "o_custkey", [F.count("*").alias("n"), F.max("o_orderdate").alias("last_at")])
    return found.select("c_custkey", "n", "last_at")


@query(
    "lateral_top",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    ON o_custkey = c_custkey WHERE rn <= 2 AND c_nationkey = 7""",
)
def lateral_top(t: Tables):
    wanted = t.customer.filter("c_nationkey = 7")
    top = pages.first_rows(joins.having_match(t.orders, wanted, "o_custkey", "c_custkey"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return top.join(wanted, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("full_join", "SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_suppkey < 9) FULL JOIN nation ON s_nationkey = n_nationkey")
def full_join(t: Tables):
    return t.supplier.filter("s_suppkey < 9").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "full").select("s_suppkey", "n_nationkey")


@query("join_partials", "SELECT coalesce(CAST(sum(n) AS bigint), 0) AS total, CAST(sum(s) AS bigint) AS s FROM (SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderstatus = '?' GROUP BY 1)")
def join_partials(t: Tables):
    parts = t.orders.filter("o_orderstatus = '?'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))
    return parts.agg(joins.join_count("n").alias("total"), joins.join_sum("s").alias("s"))
