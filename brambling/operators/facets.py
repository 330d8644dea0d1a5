"""Facets: how many rows hold each key of a column, most frequent first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, documents, text
from ..functions.predicates import set_filter


def facets(df: DataFrame, column: str, k: int | None = None, filter: str | None = None, kind: str = "scalar") -> DataFrame:
    """``key, n``: the ``k`` keys of most rows; ties go to smaller keys, the NULL key comes last.

    ``kind``: ``scalar`` (NULL is a key), ``array`` (distinct elements), ``tokens`` (lexemes) or
    ``json`` (path predicates).  A key is counted once for each row; ``filter`` is text of the
    restricted grammar.
    """
    rows = set_filter(df, filter)
    c = F.col(column)
    if kind == "scalar":
        keys = rows.select(c.cast("string").alias("key"))
    elif kind == "array":
        keys = rows.select(F.explode(F.transform(arrays.keys_of(c), lambda x: x.cast("string"))).alias("key"))
    elif kind == "tokens":
        keys = rows.select(F.explode(text.lexemes(c)).alias("key"))
    elif kind == "json":
        keys = rows.select(F.explode(documents.facet_keys(c)).alias("key"))
    else:
        raise ValueError(f"unknown kind: {kind}")
    counted = keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("key"))
    return counted if k is None else counted.limit(k)
