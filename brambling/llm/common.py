"""Shared plumbing: Arrow batching and shared storage."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import batched, ship

#: Text bytes handled at once inside a Python worker; bounds its memory whatever the batch size.
SLICE_BYTES = 1 << 20
#: The same for encoding, where each slice's distinct pieces are looked up once.
ENCODED_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and keep Arrow batches small."""
    return batched(ship(spark))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests) a
    local folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="brambling-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written to the shared folder."""
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a Python worker's free memory to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def tidily(batches: Iterator[pa.RecordBatch], function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``function`` of every batch; memory goes back when a task is done."""
    try:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
    finally:
        give_back()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts reach ``most`` bytes, about."""
    sizes = [len(s) if s is not None else 0 for s in batch.column(column).to_pylist()]
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [s if s is not None else "" for s in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """Apply ``function`` to byte-bounded slices of each Arrow batch."""

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, most=most):
            out = function(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(lambda batches: tidily(batches, parts), schema)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Keep only the named columns; name those that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def filter_texts(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Rows (all columns unchanged) for which ``keep`` holds; it gets byte-bounded slices."""

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            kept = part.filter(pa.array(keep(part), pa.bool_()))
            if kept.num_rows:
                yield kept

    return df.mapInArrow(lambda batches: tidily(batches, parts), df.schema)
