"""Counting joins: facts are grouped by key before they meet dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(fact: DataFrame, key: str, also: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return fact.filter(F.col(key).isNotNull()).groupBy(key, *also).agg(F.count("*").alias("n_"), *[F.sum(s).alias(f"s_{s}") for s in sums])


def join_counts(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, by: Sequence[str], fact_by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """``count(*)`` (and sums of fact columns) of ``fact JOIN dim``, grouped by dimension columns.

    The fact table is counted by its key first (partial counts before the shuffle), so the join has a
    row for each key instead of each fact; a hot key costs no more than others.  A dimension key that
    repeats counts its facts once for each repetition.
    """
    small = _counted(fact, fact_key, fact_by, sums)
    joined = small.join(dim, small[fact_key] == dim[dim_key])
    return joined.groupBy(*by, *fact_by).agg(F.sum("n_").alias("n"), *[F.sum(f"s_{s}").alias(f"sum_{s}") for s in sums])


def dimension_counts(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str, by: Sequence[str]) -> DataFrame:
    """``dim LEFT JOIN fact``: ``n_rows`` counts a lonely dimension row once, ``n`` its facts (0)."""
    small = _counted(fact, fact_key, (), ())
    joined = dim.join(small, dim[dim_key] == small[fact_key], "left")
    return joined.groupBy(*by).agg(F.sum(F.coalesce("n_", F.lit(1))).alias("n_rows"), F.sum(F.coalesce("n_", F.lit(0))).alias("n"))


def having_match(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """``EXISTS``: rows with a match, once each."""
    keys = other.select(F.col(other_key).alias("k_"))
    return df.join(keys, F.col(key) == F.col("k_"), "left_semi")


def lacking_match(df: DataFrame, other: DataFrame, key: str, other_key: str, condition: Column | None = None) -> DataFrame:
    """``NOT EXISTS``, also for ``LEFT JOIN ... IS NULL``: rows with a NULL key are kept."""
    same = F.col(key) == F.col(other_key)
    return df.join(other, same if condition is None else same & condition, "left_anti")


def not_in(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """``NOT IN``: a NULL on the other side leaves no row, a NULL key is dropped unless that side is empty."""
    keys = other.select(F.col(other_key).alias("k_"))
    facts = keys.agg(F.count("*").alias("rows"), F.count_if(F.col("k_").isNull()).alias("nulls")).first()
    if not facts["rows"]:
        return df
    if facts["nulls"]:
        return df.filter(F.lit(False))
    return df.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("k_"), "left_anti")


def values_dimension(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A list of values as a dimension; repeated values count twice."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def star_counts(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], by: Sequence[str]) -> DataFrame:
    """Count of a fact table over several filtered dimensions (dimension, fact key, dimension key), grouped by fact columns.

    Dimensions with unique keys only restrict facts, so they are semi joins.
    """
    for dim, fact_key, dim_key in dims:
        fact = having_match(fact, dim, fact_key, dim_key)
    return fact.groupBy(*by).agg(F.count("*").alias("n"))


def label_counts(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, labels: Mapping[str, Column], otherwise: str, blocked: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Facts by a label of their dimension row: the first condition that holds names it."""
    label = F.lit(otherwise)
    for name, test in reversed(list(labels.items())):
        label = F.when(test, F.lit(name)).otherwise(label)
    named = dim.select(F.col(dim_key).alias("d_"), label.alias("label"))
    rows = fact if blocked is None else lacking_match(fact, blocked[0].select(F.col(blocked[1]).alias("b_")), fact_key, "b_")
    counted = _counted(rows, fact_key, (), ())
    return counted.join(named, F.col(fact_key) == F.col("d_")).groupBy("label").agg(F.sum("n_").alias("n"))


def ordered_page(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of ``fact JOIN dim`` in a total order; each task keeps ``k`` rows."""
    return fact.join(dim, fact[fact_key] == dim[dim_key]).orderBy(*order).limit(k)


def lateral_counts(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, aggregates: Sequence[Column]) -> DataFrame:
    """A grouped subquery joined to its outer rows: only groups that an outer row asks for are made."""
    wanted = outer.select(F.col(outer_key).alias("w_")).distinct()
    grouped = inner.join(wanted, F.col(inner_key) == F.col("w_"), "left_semi").groupBy(F.col(inner_key).alias("g_")).agg(*aggregates)
    return outer.join(grouped, F.col(outer_key) == F.col("g_"), "left").drop("g_")


def join_count(n: str) -> Column:
    """Aggregate of partial counts: 0 over no rows."""
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def join_sum(n: str) -> Column:
    """Aggregate of partial sums: NULL over no rows."""
    return F.sum(n)
