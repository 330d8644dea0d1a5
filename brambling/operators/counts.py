"""Counts, groups, distinct counts, grouping sets, top groups and capped counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import filter_in


def count_where(df: DataFrame, condition: Column | str | None = None) -> DataFrame:
    """One row ``n``: rows that satisfy the condition."""
    return (df if condition is None else df.filter(condition)).agg(F.count("*").alias("n"))


def count_key(df: DataFrame, column: str, key) -> int:
    """Rows whose column equals ``key``; a NULL key counts 0."""
    return 0 if key is None else df.filter(F.col(column) == key).count()


def count_keys(df: DataFrame, first: str, key, second: str, other) -> int:
    """Rows in which both columns equal their keys."""
    return 0 if key is None or other is None else df.filter((F.col(first) == key) & (F.col(second) == other)).count()


def count_any(df: DataFrame, column: str, keys: Sequence) -> int:
    """Rows whose column is among ``keys``, of any number."""
    return filter_in(df, column, keys).count()


def group_stats(df: DataFrame, column: str, condition: Column | str | None = None) -> DataFrame:
    """One row: number of groups (NULL is one) and of rows."""
    rows = df if condition is None else df.filter(condition)
    return rows.groupBy(column).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def group_counts(df: DataFrame, *keys: Column | str, condition: Column | str | None = None, having: Column | str | None = None) -> DataFrame:
    rows = df if condition is None else df.filter(condition)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted if having is None else counted.filter(having)


def filtered_counts(df: DataFrame, conditions: Mapping[str, Column | str], *keys: Column | str) -> DataFrame:
    """``count(*) FILTER (WHERE ...)`` for several conditions in one pass."""
    tests = {k: F.expr(c) if isinstance(c, str) else c for k, c in conditions.items()}
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


def distinct_count(df: DataFrame, column: str, *keys: str, unique: bool = False) -> DataFrame:
    """``count(DISTINCT column)``; a column known to be unique is only counted.

    Distinct pairs are made before groups are counted, so a group of most rows is spread over all
    tasks by its values and counted in parts.
    """
    if unique:
        return df.groupBy(*keys).agg(F.count(column).alias("n_distinct"))
    pairs = df.select(*keys, column).distinct()
    return pairs.groupBy(*keys).agg(F.count(column).alias("n_distinct"))


def grouping_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], sums: Sequence[str] = ()) -> DataFrame:
    """Counts and sums over grouping sets, from the finest grouping.

    Rows are grouped once by all keys; only groups, not rows, are expanded to the sets.
    ``grouping_id`` has a bit for each key that a set leaves out, the first key's highest.
    """
    finest = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(s).alias(f"sum_{s}") for s in sums])
    absent = [k for s in sets for k in s if k not in keys]
    if absent:
        raise ValueError(f"not among the keys: {', '.join(absent)}")
    # A struct for each set; whether a key is NULL as a value or left out is told by the bits.
    rows = [
        F.struct(
            *[(F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys],
            F.lit(sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)).cast("long").alias("grouping_id"),
        )
        for s in sets
    ]
    spread = finest.withColumn("set_", F.explode(F.array(*rows))).select("set_.*", "n", *[f"sum_{s}" for s in sums])
    out = spread.groupBy(*keys, "grouping_id").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{s}").alias(f"sum_{s}") for s in sums])
    if any(not s for s in sets) and df.isEmpty():
        # The empty set has a row even over no rows.
        blank = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
        one = df.sparkSession.range(1).select(*blank, F.lit((1 << len(keys)) - 1).cast("long").alias("grouping_id"), F.lit(0).cast("long").alias("n"), *[F.lit(None).cast(out.schema[f"sum_{s}"].dataType).alias(f"sum_{s}") for s in sums])
        out = out.unionByName(one)
    return out


def rollup_sets(keys: Sequence[str]) -> list[list[str]]:
    return [list(keys[:i]) for i in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[list[str]]:
    return [[k for i, k in enumerate(keys) if not bits >> (len(keys) - 1 - i) & 1] for bits in range(1 << len(keys))]


def top_groups(df: DataFrame, keys: Sequence[str], k: int, condition: Column | str | None = None) -> DataFrame:
    """The ``k`` largest groups; ties go to smaller keys, NULL last."""
    return group_counts(df, *keys, condition=condition).orderBy(F.desc("n"), *[F.asc_nulls_last(c) for c in keys]).limit(k)


def capped_count(df: DataFrame, most: int) -> DataFrame:
    """One row ``n``: rows, but ``most`` at most; each task stops at ``most`` rows."""
    return df.select(F.lit(1).alias("one")).limit(most).agg(F.count("*").alias("n"))


def select_distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def cells(df: DataFrame, leaves: Mapping[str, tuple[Column, int]], name: str = "score") -> DataFrame:
    """Groups by a weighted sum of predicates: each leaf adds its weight where it is true."""
    total = sum((F.when(test, F.lit(weight)).otherwise(F.lit(0)) for test, weight in leaves.values()), F.lit(0))
    return df.groupBy(total.alias(name)).agg(F.count("*").alias("n"))
