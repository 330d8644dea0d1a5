"""Counts under predicates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import days
from ..functions import predicates as p
from ..operators import counts
from ..plans.ranges import range_filter
from .registry import Tables, query


def _user():
    """NULL in a seventh of the values."""
    return F.nullif(F.col("user_id") % 7, F.lit(0))


_SQL_USER = "nullif(user_id % 7, 0)"


@query("count_eq", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def count_eq(t: Tables):
    return counts.count_where(t.events, F.col("event_type") == "click")


@query("count_eq_unique", "SELECT count(*) AS n FROM events WHERE event_id = 77")
def count_eq_unique(t: Tables):
    return counts.count_where(t.events, F.col("event_id") == 77)


@query("count_and2", "SELECT count(*) AS n FROM events WHERE event_type = 'view' AND user_id = 8")
def count_and2(t: Tables):
    return counts.count_where(t.events, (F.col("event_type") == "view") & (F.col("user_id") == 8))


@query("count_and3", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 3")
def count_and3(t: Tables):
    return counts.count_where(t.lineitem, (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 3))


@query("count_in", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view', NULL) AND user_id IN (1, 2, 3, 5, 8, 13)")
def count_in(t: Tables):
    return counts.count_where(t.events, p.among(F.col("event_type"), ["click", "view", None]) & p.among(F.col("user_id"), [1, 2, 3, 5, 8, 13]))


@query("count_in_long", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT 3 * i FROM range(1500) r(i))")
def count_in_long(t: Tables):
    return counts.count_where(p.filter_in(t.orders, "o_custkey", [3 * i for i in range(1500)]))


@query("count_not_in_long", "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT 3 * i FROM range(1500) r(i))")
def count_not_in_long(t: Tables):
    return counts.count_where(p.filter_in(t.orders, "o_custkey", [3 * i for i in range(1500)], negate=True))


@query("count_or", "SELECT count(*) AS n FROM events WHERE event_type = 'error' OR user_id = 8")
def count_or(t: Tables):
    return counts.count_where(t.events, (F.col("event_type") == "error") | (F.col("user_id") == 8))


@query("count_ne", f"SELECT count(*) AS n FROM events WHERE {_SQL_USER} <> 3")
def count_ne(t: Tables):
    return counts.count_where(t.events, _user() != 3)


@query("count_not_in", "SELECT count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def count_not_in(t: Tables):
    return counts.count_where(t.orders, p.not_among(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]))


@query("count_is_distinct", f"SELECT count(*) AS n FROM events WHERE {_SQL_USER} IS DISTINCT FROM 3")
def count_is_distinct(t: Tables):
    return counts.count_where(t.events, p.distinct_from(_user(), 3))


@query("count_not_distinct", f"SELECT count(*) AS n FROM events WHERE {_SQL_USER} IS NOT DISTINCT FROM 3")
def count_not_distinct(t: Tables):
    return counts.count_where(t.events, p.not_distinct_from(_user(), 3))


@query("count_null", f"SELECT count(*) FILTER (WHERE {_SQL_USER} IS NULL) AS n_null, count({_SQL_USER}) AS n_known, count(*) AS n FROM events")
def count_null(t: Tables):
    return t.events.agg(F.count_if(_user().isNull()).alias("n_null"), F.count(_user()).alias("n_known"), F.count("*").alias("n"))


@query("count_range", "SELECT count(*) AS n FROM events WHERE value > 50 AND value <= 90")
def count_range(t: Tables):
    return counts.count_where(t.events, (F.col("value") > 50) & (F.col("value") <= 90))


@query("count_between", "SELECT count(*) AS n FROM orders WHERE o_custkey BETWEEN 100 AND 400")
def count_between(t: Tables):
    return counts.count_where(t.orders, F.col("o_custkey").between(100, 400))


def _flag():
    return F.when(F.col("user_id") % 7 != 0, F.col("value") > 50)


_SQL_FLAG = "(CASE WHEN user_id % 7 <> 0 THEN value > 50 END)"


@query(
    "count_bool_tests",
    f"""SELECT count(*) FILTER (WHERE {_SQL_FLAG}) AS n_true, count(*) FILTER (WHERE NOT {_SQL_FLAG}) AS n_not,
    count(*) FILTER (WHERE {_SQL_FLAG} IS NOT TRUE) AS n_is_not_true, count(*) FILTER (WHERE {_SQL_FLAG} IS FALSE) AS n_is_false,
    count(*) FILTER (WHERE {_SQL_FLAG} IS NULL) AS n_unknown FROM events""",
)
def count_bool_tests(t: Tables):
    tests = {"n_true": _flag(), "n_not": ~_flag(), "n_is_not_true": p.distinct_from(_flag(), True), "n_is_false": p.not_distinct_from(_flag(), False), "n_unknown": _flag().isNull()}
    return counts.filtered_counts(t.events, tests)


@query("count_complement_or", f"SELECT count(*) AS n FROM events WHERE {_SQL_USER} <> 5 OR {_SQL_USER} IS NULL")
def count_complement_or(t: Tables):
    return counts.count_where(t.events, (_user() != 5) | _user().isNull())


@query("count_exclusions", "SELECT count(*) AS n FROM events WHERE event_type <> 'click' AND event_type <> 'view' AND user_id <> 8")
def count_exclusions(t: Tables):
    return counts.count_where(t.events, (F.col("event_type") != "click") & (F.col("event_type") != "view") & (F.col("user_id") != 8))


@query("count_like_prefix", "SELECT count(*) AS n FROM part WHERE p_name LIKE 'red%'")
def count_like_prefix(t: Tables):
    return counts.count_where(t.part, p.starts_with(F.col("p_name"), "red"))


@query("count_like_exact", "SELECT count(*) AS n FROM part WHERE p_name LIKE 'red widget'")
def count_like_exact(t: Tables):
    return counts.count_where(t.part, F.col("p_name").like("red widget"))


@query("count_key_tests", "SELECT count(*) AS n FROM part WHERE lower(p_brand) = 'brand#7' AND p_type ILIKE 'e%' AND p_size % 5 = 0 AND regexp_matches(p_name, '^[a-m]')")
def count_key_tests(t: Tables):
    return counts.count_where(t.part, (F.lower("p_brand") == "brand#7") & F.col("p_type").ilike("e%") & (F.col("p_size") % 5 == 0) & F.col("p_name").rlike("^[a-m]"))


@query("count_residual", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity * l_discount > 2.005")
def count_residual(t: Tables):
    return counts.count_where(t.lineitem, (F.col("l_returnflag") == "R") & (F.col("l_quantity") * F.col("l_discount") > 2.005))


@query("count_day_cast", "SELECT count(*) AS n FROM events WHERE CAST(ts AS date) >= DATE '2024-01-10' AND CAST(ts AS date) < DATE '2024-01-13'")
def count_day_cast(t: Tables):
    ts = F.col("ts")
    return counts.count_where(t.events, days.day_compare(ts, ">=", date(2024, 1, 10)) & days.day_compare(ts, "<", date(2024, 1, 13)))


@query("count_trunc_month", "SELECT count(*) AS n FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1997-05-01'")
def count_trunc_month(t: Tables):
    return counts.count_where(range_filter(t.orders, "date_trunc('month', o_orderdate) = timestamp '1997-05-01'"))


@query(
    "count_trunc_forms",
    """SELECT count(*) FILTER (WHERE date_trunc('week', ts) = TIMESTAMP '2024-01-08') AS week_eq,
    count(*) FILTER (WHERE date_trunc('week', ts) = TIMESTAMP '2024-01-09') AS week_never,
    count(*) FILTER (WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-09 10:30:00') AS hour_gt,
    count(*) FILTER (WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-09 10:30:00') AS hour_ge,
    count(*) FILTER (WHERE date_trunc('day', ts) <= TIMESTAMP '2024-01-09 10:30:00') AS day_le,
    count(*) FILTER (WHERE date_trunc('day', ts) < TIMESTAMP '2024-01-09 10:30:00') AS day_lt,
    count(*) FILTER (WHERE date_trunc('quarter', ts) <> TIMESTAMP '2024-01-01') AS quarter_ne,
    count(*) FILTER (WHERE date_trunc('decade', ts) = TIMESTAMP '2020-01-01') AS decade_eq,
    count(*) FILTER (WHERE date_trunc('century', ts) <= TIMESTAMP '2001-01-01') AS century_le FROM events""",
)
def count_trunc_forms(t: Tables):
    def test(unit, sign, at):
        return days.unit_compare(F.col("ts"), unit, sign, at)

    half = datetime(2024, 1, 9, 10, 30)
    tests = {
        "week_eq": test("week", "=", date(2024, 1, 8)), "week_never": test("week", "=", date(2024, 1, 9)),
        "hour_gt": test("hour", ">", half), "hour_ge": test("hour", ">=", half), "day_le": test("day", "<=", half), "day_lt": test("day", "<", half),
        "quarter_ne": test("quarter", "<>", date(2024, 1, 1)), "decade_eq": test("decade", "=", date(2020, 1, 1)), "century_le": test("century", "<=", date(2001, 1, 1)),
    }
    return counts.filtered_counts(t.events, tests)


@query(
    "day_bounds",
    """SELECT DISTINCT CAST(o_orderdate AS date) AS day, CAST(CAST(o_orderdate AS date) AS timestamp) AS first_at,
    CAST(CAST(o_orderdate AS date) AS timestamp) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS last_at FROM orders WHERE o_custkey < 100""",
)
def day_bounds(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.filter("o_custkey < 100").select(day.alias("day"), days.day_first(day).alias("first_at"), days.day_last(day).alias("last_at")).distinct()


@query(
    "unit_bounds",
    """SELECT event_id, CASE WHEN date_trunc('month', ts) = ts THEN ts ELSE date_trunc('month', ts) + INTERVAL 1 MONTH END AS month_first,
    date_trunc('week', ts) + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS week_last, date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS hour_last,
    date_trunc('decade', ts) AS decade, make_timestamp((year(ts) - 1) // 100 * 100 + 101, 1, 1, 0, 0, 0.0) AS next_century FROM events WHERE user_id < 5""",
)
def unit_bounds(t: Tables):
    ts = F.col("ts")
    return t.events.filter("user_id < 5").select(
        "event_id", days.first_reaching("month", ts).alias("month_first"), days.last_within("week", ts).alias("week_last"), days.last_within("hour", ts).alias("hour_last"),
        days.unit_start("decade", ts).alias("decade"), days.unit_end("century", ts).alias("next_century"),
    )


@query("count_text_filter", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'error') AND NOT (user_id BETWEEN 5 AND 20) OR value IS NULL")
def count_text_filter(t: Tables):
    return counts.count_where(p.set_filter(t.events, "event_type IN ('click', 'error') AND NOT (user_id BETWEEN 5 AND 20) OR value IS NULL"))


@query("count_cross_type", "SELECT count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-01' AND o_custkey = CAST(77 AS smallint)")
def count_cross_type(t: Tables):
    return counts.count_where(t.orders, (F.col("o_orderdate") < F.lit(date(1998, 1, 1))) & (F.col("o_custkey") == F.lit(77).cast("smallint")))


@query("count_params", "SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value >= 25.5")
def count_params(t: Tables):
    return t.spark.sql("SELECT count(*) AS n FROM {events} WHERE event_type = :kind AND value >= :least", args={"kind": "purchase", "least": 25.5}, events=t.events)


@query(
    "key_functions",
    """SELECT upper(p_type) AS u, length(p_brand) AS n_brand, left(p_brand, 5) AS l5, right(p_name, 4) AS r4, substr(p_name, 2, 3) AS s3,
    trim(p_name) || '!' AS joined, p_size // 7 AS d7, count(*) AS n FROM part GROUP BY ALL""",
)
def key_functions(t: Tables):
    keys = [
        F.upper("p_type").alias("u"), F.length("p_brand").cast("long").alias("n_brand"), F.left("p_brand", F.lit(5)).alias("l5"), F.right("p_name", F.lit(4)).alias("r4"),
        F.substring("p_name", 2, 3).alias("s3"), F.concat(F.trim("p_name"), F.lit("!")).alias("joined"), F.expr("cast(p_size div 7 as int)").alias("d7"),
    ]
    return counts.group_counts(t.part, *keys)
