"""Optional materialised bitmaps: which rows hold each key, as ordinary tables.

A posting table has ``column, key, bucket, bitmap``: bit p of bucket b stands for a row number, and a
bucket covers 32,768 rows.  Counts, conjunctions, disjunctions and differences are bitmap aggregates,
which Spark combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays


def posting_table(df: DataFrame, columns: Sequence[str], row_id: str, array_columns: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of all keys of the columns; NULL is a key.  ``row_id`` is a stable number from 0."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in columns]
    scalar = df.select(F.col(row_id).cast("long").alias("row"), F.explode(F.array(*entries)).alias("e")).select("row", "e.*") if columns else None
    for c in array_columns:
        part = df.select(F.col(row_id).cast("long").alias("row"), F.lit(c).alias("column"), F.explode(F.transform(arrays.keys_of(F.col(c)), lambda x: x.cast("string"))).alias("key"))
        scalar = part if scalar is None else scalar.unionByName(part)
    if scalar is None:
        raise ValueError("no columns")
    return scalar.groupBy("column", "key", F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bitmap"))


def key_summary(postings: DataFrame) -> DataFrame:
    """``column, key, n``: rows of every key."""
    return postings.groupBy("column", "key").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def rows_of(postings: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """``bucket, bitmap`` of rows that hold any of the keys."""
    known = [str(k) for k in keys if k is not None]
    return postings.filter((F.col("column") == column) & F.col("key").isin(known)).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def conjunction(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows that all parts hold."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("c")).filter(F.col("c") == len(parts)).select("bucket", "bitmap")


def cardinality(part: DataFrame) -> DataFrame:
    """One row ``n``."""
    return part.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


def count_and(postings: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose columns all hold one of their keys."""
    return cardinality(conjunction([rows_of(postings, c, keys) for c, keys in wanted.items()]))


def count_and_not(postings: DataFrame, column: str, keys: Sequence, other: str, without: Sequence) -> DataFrame:
    """Rows that hold one of ``keys`` and none of ``without``: |A| - |A and B|."""
    a = rows_of(postings, column, keys)
    both = cardinality(conjunction([a, rows_of(postings, other, without)])).scalar()
    return cardinality(a).select((F.col("n") - both).alias("n"))


def merged(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Postings of old and appended rows together."""
    return postings.unionByName(more).groupBy("column", "key", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def verify(postings: DataFrame, df: DataFrame, column: str) -> None:
    """Raise unless the table's counts are those of the data."""
    held = key_summary(postings.filter(F.col("column") == column)).select("key", "n")
    real = df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
    if not (held.exceptAll(real).isEmpty() and real.exceptAll(held).isEmpty()):
        raise ValueError(f"postings of {column} differ from the data")
