"""Ordered pages, pages with totals, and first rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    """``ORDER BY ... LIMIT k OFFSET offset``; the order should be total."""
    if k < 0 or offset < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    page = df.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(k)


def after(df: DataFrame, column: str, last, tie: str, last_tie, k: int) -> DataFrame:
    """The keyset page behind (last, last_tie) in ascending order."""
    c, t = F.col(column), F.col(tie)
    return df.filter((c > last) | ((c == last) & (t > last_tie))).orderBy(c, t).limit(k)


def page_with_total(df: DataFrame, order: Sequence[Column], k: int, offset: int = 0, name: str = "total") -> DataFrame:
    """A page beside ``count(*) OVER ()``: the total is a scalar subquery, no window sees all rows."""
    return ordered(df, order, k, offset).withColumn(name, df.agg(F.count("*").alias("n_")).scalar())


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """``row_number() <= k`` in each group; groups are cut to ``k`` rows before the shuffle, too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", place).filter(F.col("rn") <= k)


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``DISTINCT ON (keys) ... ORDER BY by DESC``: one row a group as a partial aggregate, without a sort.

    NULLs in ``by`` count as smallest; ``by`` should order a group's rows totally.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*by)).alias("row_")
    return df.groupBy(*keys).agg(best).select(*keys, "row_.*").select(*df.columns)
