"""Aggregates of integer-like columns: exact sums, and optional tables with a bitmap for each bit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = {"smallint": 16, "int": 32, "date": 32, "bigint": 64}


def slice_aggregate(df: DataFrame, column: str, condition: Column | str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``count, sum, avg, min, max`` of a column; the sum is decimal and can't overflow."""
    rows = df if condition is None else df.filter(condition)
    c = F.col(column)
    return rows.groupBy(*keys).agg(
        F.count(c).alias("n"), F.sum(c.cast("decimal(38,0)")).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most")
    )


def aggregate_as_text(df: DataFrame, column: str, condition: Column | str | None = None) -> DataFrame:
    """One row: count, decimal sum, and extremes as text."""
    found = slice_aggregate(df, column, condition)
    return found.select("n", "total", F.col("least").cast("string").alias("least"), F.col("most").cast("string").alias("most"))


def bit_slices(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """``bit, bucket, bitmap``: rows whose value has the bit set; bit -1 holds rows with a value.

    Values are offset by half their range, so order is that of unsigned numbers.  ``row_id`` must be
    a stable number of the row from 0; a bucket covers 32,768 of them.
    """
    kind = df.schema[column].dataType.simpleString()
    if kind not in _BITS:
        raise ValueError(f"{kind} has no bit slices")
    width = _BITS[kind]
    value = F.datediff(F.col(column), F.lit("1970-01-01").cast("date")) if kind == "date" else F.col(column)
    flipped = value.cast("long").bitwiseXOR(F.lit(-(1 << 63) if width == 64 else 1 << (width - 1)).cast("long"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.getbit(F.col("v_"), b) == 1)
    rows = df.filter(F.col(column).isNotNull()).select(F.col(row_id).cast("long").alias("row"), flipped.alias("v_"))
    spread = rows.select("row", F.explode(F.concat(F.array(F.lit(-1)), bits)).alias("bit"))
    return spread.groupBy("bit", F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bitmap"))


def sum_from_slices(slices: DataFrame, kind: str) -> DataFrame:
    """One row ``n, total``: the exact sum of the values from their bits' cardinalities."""
    width = _BITS[kind]
    each = slices.groupBy("bit").agg(F.sum(F.bitmap_count("bitmap")).alias("c"))
    weight = F.get(F.array(*[F.lit(str(1 << i)).cast("decimal(20,0)") for i in range(width)]), F.col("bit"))
    offset = F.lit(str(1 << (width - 1))).cast("decimal(20,0)")
    total = F.sum(F.when(F.col("bit") >= 0, (weight * F.col("c")).cast("decimal(38,0)")).otherwise((-offset * F.col("c")).cast("decimal(38,0)")))
    n = F.coalesce(F.sum(F.when(F.col("bit") == -1, F.col("c"))), F.lit(0))
    return each.agg(n.alias("n"), total.cast("decimal(38,0)").alias("total"))
