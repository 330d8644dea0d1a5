"""Reading and writing tables: Parquet files with declared partitioning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share: in ``spark.checkpoint.dir``, or a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="brambling-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, for work that costs more than moving its rows.

    A file is read by one task for each row group at most.  A table with as many splits as there are
    cores, as any large one has, is left as it is: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def save_partitioned(df: DataFrame, path: str, by: Sequence[str], files: int | None = None, mode: str = "overwrite") -> None:
    """Write a table partitioned by a column of few values, so filters on it skip folders.

    Without ``files`` adaptive execution rebalances rows: a value with most rows gets several files.
    """
    ready = df.hint("rebalance", *by) if files is None else df.repartition(files, *by)
    ready.write.mode(mode).partitionBy(*by).parquet(path)


def save_bucketed(df: DataFrame, table: str, by: Sequence[str], buckets: int, sort: bool = True) -> None:
    """Write a table bucketed by join keys, so that later joins and groupings on them don't shuffle."""
    writer = df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by)
    (writer.sortBy(*by) if sort else writer).saveAsTable(table)


def describe_keys(df: DataFrame, column: str, kind: str = "scalar") -> DataFrame:
    """One row of statistics of a key column: rows, NULLs, empties, entries, distinct keys, largest key's rows.

    ``kind``: ``scalar`` or ``array`` (an entry for each row and distinct element).
    """
    c = F.col(column)
    if kind == "array":
        facts = df.agg(F.count("*").alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), F.count_if(F.size(c) == 0).alias("n_empty"))
        keys = df.select(F.explode(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))).alias("key"))
    elif kind == "scalar":
        facts = df.agg(F.count("*").alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), F.lit(0).cast("long").alias("n_empty"))
        keys = df.filter(c.isNotNull()).select(c.alias("key"))
    else:
        raise ValueError(f"unknown kind: {kind}")
    counted = keys.groupBy("key").agg(F.count("*").alias("n"))
    each = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.count("*").alias("n_distinct"), F.max("n").alias("n_largest"))
    return facts.join(F.broadcast(each), F.lit(True))  # one row beside one row
