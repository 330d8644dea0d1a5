"""Arrays, JSON documents and facets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays, documents
from ..operators import counts, facets
from .registry import Tables, query


def _tags() -> Column:
    """A part's tags: its name's words, with NULL arrays, empty arrays and NULL elements mixed in."""
    return (
        F.when(F.col("p_partkey") % 23 == 0, F.lit(None))
        .when(F.col("p_partkey") % 19 == 0, F.array().cast("array<string>"))
        .when(F.col("p_partkey") % 11 == 0, F.concat(F.split("p_name", " "), F.array(F.lit(None).cast("string"), F.lit("red"))))
        .otherwise(F.concat(F.split("p_name", " "), F.array(F.col("p_type"))))
    )


_SQL_TAGS = """(SELECT *, CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST([] AS varchar[])
    WHEN p_partkey % 11 = 0 THEN list_concat(string_split(p_name, ' '), [NULL, 'red']) ELSE list_concat(string_split(p_name, ' '), [p_type]) END AS tags FROM part)"""


def _tagged(t: Tables):
    return t.part.withColumn("tags", _tags())


def _has(value: str) -> str:
    return f"coalesce(list_contains(tags, '{value}'), false)"


@query(
    "array_predicates",
    f"""SELECT count(*) FILTER (WHERE tags IS NOT NULL AND {_has('red')} AND {_has('ECONOMY')}) AS both_,
    count(*) FILTER (WHERE tags IS NOT NULL AND NOT ({_has('red')})) AS lacks_red,
    count(*) FILTER (WHERE tags IS NOT NULL AND ({_has('red')} OR {_has('bolt')})) AS any_,
    count(*) FILTER (WHERE len(list_filter(tags, lambda x: x IS NULL OR x NOT IN ('red', 'bolt', 'SMALL', 'ring'))) = 0) AS within_,
    count(*) FILTER (WHERE false) AS with_null, count(*) FILTER (WHERE tags IS NOT NULL) AS with_none,
    count(*) FILTER (WHERE tags = ['red', 'bolt', 'SMALL']) AS same_ FROM {_SQL_TAGS}""",
)
def array_predicates(t: Tables):
    tags = F.col("tags")
    tests: dict[str, Column] = {
        "both_": arrays.contains_all(tags, ["red", "ECONOMY"]),
        "lacks_red": ~arrays.contains_all(tags, ["red"]),
        "any_": arrays.overlaps(tags, ["red", "bolt", None]),
        "within_": arrays.contained_by(tags, ["red", "bolt", "SMALL", "ring"]),
        "with_null": arrays.contains_all(tags, ["red", None]),
        "with_none": arrays.contains_all(tags, []),
        "same_": arrays.same_array(tags, ["red", "bolt", "SMALL"]),
    }
    return counts.filtered_counts(_tagged(t), tests)


@query(
    "array_any_forms",
    f"""SELECT count(*) FILTER (WHERE list_contains(tags, 'red')) AS eq_any,
    count(*) FILTER (WHERE tags IS NOT NULL AND ({_has('red')} AND {_has('bolt')} OR {_has('ring')})) AS contains_any FROM {_SQL_TAGS}""",
)
def array_any_forms(t: Tables):
    tags = F.col("tags")
    return counts.filtered_counts(_tagged(t), {"eq_any": arrays.any_equals(tags, "red"), "contains_any": arrays.contains_any_of(tags, [["red", "bolt"], ["ring"]])})


@query(
    "array_emptiness",
    f"""SELECT count(*) FILTER (WHERE len(tags) > 0) AS some, count(*) FILTER (WHERE len(tags) = 0) AS none,
    count(*) FILTER (WHERE tags IS NULL OR len(tags) > 0) AS not_empty_value, count(*) FILTER (WHERE tags IS NULL OR len(tags) = 0) AS none_or_null,
    count(*) FILTER (WHERE tags IS NULL) AS unknown FROM {_SQL_TAGS}""",
)
def array_emptiness(t: Tables):
    tags = F.col("tags")
    tests = {"some": arrays.non_empty(tags), "none": arrays.is_empty(tags), "not_empty_value": arrays.distinct_from_empty(tags), "none_or_null": arrays.empty_or_null(tags), "unknown": tags.isNull()}
    return counts.filtered_counts(_tagged(t), tests)


@query("facet_array", f"SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS key FROM {_SQL_TAGS} WHERE p_size < 30) GROUP BY 1 ORDER BY n DESC, key LIMIT 8")
def facet_array(t: Tables):
    return facets.facets(_tagged(t), "tags", 8, "p_size < 30", "array")


@query("facet_scalar", "SELECT CAST(nullif(user_id % 7, 0) AS varchar) AS key, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def facet_scalar(t: Tables):
    rows = t.events.withColumn("g", F.nullif(F.col("user_id") % 7, F.lit(0)))
    return facets.facets(rows, "g", None, "event_type IN ('click', 'view')")


@query(
    "cells_of_arrays",
    f"""SELECT CASE WHEN tags IS NOT NULL AND {_has('red')} THEN 2 ELSE 0 END + CASE WHEN tags IS NOT NULL AND {_has('bolt')} THEN 1 ELSE 0 END + CASE WHEN p_size > 25 THEN 4 ELSE 0 END AS score,
    count(*) AS n FROM {_SQL_TAGS} GROUP BY 1""",
)
def cells_of_arrays(t: Tables):
    tags = F.col("tags")
    return counts.cells(_tagged(t), {"red": (arrays.contains_all(tags, ["red"]), 2), "bolt": (arrays.contains_all(tags, ["bolt"]), 1), "big": (F.col("p_size") > 25, 4)})


@query("json_field", "SELECT count(*) AS n FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_field(t: Tables):
    return counts.count_where(t.events, documents.field_equals(F.col("props"), "k", "42"))


@query("json_field_range", "SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS int) > 50 GROUP BY 1")
def json_field_range(t: Tables):
    return counts.group_counts(t.events, "event_type", condition=documents.field_as(F.col("props"), "k", "int") > 50)


@query("json_contains", "SELECT count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS int) = 42")
def json_contains(t: Tables):
    return counts.count_where(t.events, documents.contains(F.col("props"), {"k": 42.0}))


def _doc() -> Column:
    """A nested document for each part."""
    return F.to_json(F.struct(F.col("p_brand").alias("cat"), F.col("p_size").alias("n"), F.split("p_name", " ").alias("tags"), F.struct(F.col("p_type").alias("t")).alias("in")))


_SQL_DOC = "part"


@query(
    "json_nested",
    f"""SELECT count(*) FILTER (WHERE p_brand = 'Brand#7' AND p_type = 'SMALL') AS both_,
    count(*) FILTER (WHERE list_contains(string_split(p_name, ' '), 'red')) AS tagged,
    count(*) FILTER (WHERE p_size = 11) AS sized, count(*) AS has_keys, count(*) FILTER (WHERE false) AS no_key FROM {_SQL_DOC}""",
)
def json_nested(t: Tables):
    doc = F.col("doc")
    tests = {
        "both_": documents.contains(doc, {"cat": "Brand#7", "in": {"t": "SMALL"}}), "tagged": documents.contains(doc, {"tags": ["red"]}), "sized": documents.contains(doc, {"n": 11}),
        "has_keys": documents.has_all_keys(doc, ["cat", "tags"]) & documents.has_any_key(doc, ["zz", "in"]), "no_key": documents.has_key(doc, "t"),
    }
    return counts.filtered_counts(t.part.withColumn("doc", _doc()), tests)


@query(
    "json_path",
    f"""SELECT count(*) FILTER (WHERE p_size > 40) AS above, count(*) FILTER (WHERE list_contains(string_split(p_name, ' '), 'bolt')) AS bolts,
    count(*) FILTER (WHERE p_brand LIKE 'Brand#1%' AND p_size < 10) AS both_, count(*) FILTER (WHERE p_type = 'SMALL') AS anywhere FROM {_SQL_DOC}""",
)
def json_path(t: Tables):
    doc = F.col("doc")
    tests = {
        "above": documents.path_match(doc, "$.n > 40"), "bolts": documents.path_exists(doc, '$.tags[*] ? (@ == "bolt")'),
        "both_": documents.path_match(doc, '$.cat starts with "Brand#1" && $.n < 10'), "anywhere": documents.path_exists(doc, '$.** ? (@ == "SMALL")'),
    }
    tested = t.part.select(_doc().alias("doc")).select(*[test.alias(k) for k, test in tests.items()])
    return tested.agg(*[F.count_if(k).alias(k) for k in tests])


@query("json_canonical", "SELECT count(DISTINCT CAST(json_extract_string(props, '$.k') AS int)) AS n FROM events")
def json_canonical(t: Tables):
    spelled = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}", ".0}")).otherwise(F.regexp_replace("props", ": ", ":"))
    return t.events.agg(F.countDistinct(documents.canonical(spelled)).alias("n"))


@query(
    "facet_json",
    """SELECT key, count(*) AS n FROM (SELECT '$."k" == ' || CAST(CAST(json_extract_string(props, '$.k') AS int) AS varchar) AS key FROM events UNION ALL SELECT '? "k"' FROM events)
    GROUP BY 1 ORDER BY n DESC, key LIMIT 12""",
)
def facet_json(t: Tables):
    return facets.facets(t.events, "props", 12, None, "json")
