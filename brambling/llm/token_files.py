"""Token-id files: Parquet list columns with dictionary or delta encoding and page indexes.

Documents are ordered by ``doc_id`` before they are encoded, so the ids themselves are written where
they are made.  Each file holds one range of ``doc_id``; row groups and pages are small enough for
selective reads: the page index (written by default) lets a reader fetch ids or metadata of a few
documents, and metadata columns never touch id pages.

Defined results: null text is the empty text (the end id alone); null ``doc_id`` come first; equal
``doc_id`` keep a stable order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ENCODED_BYTES, map_texts, prepare, require, shared_folder
from .tokens import Encoder, vocabulary_path

#: Bytes of text that one file takes at most, about; small inputs get a file for each shuffle partition.
FILE_BYTES = 64 << 20
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10


def write_token_files(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    vocabulary: str | None = None,
    encoding: str = "dictionary",
    n_files: int | None = None,
) -> None:
    """Write ``doc_id, part, n_tokens, ids`` in ascending ``doc_id`` order.

    ``encoding``: ``dictionary`` (bit-packed indexes into each row group's ids) or ``delta``
    (DELTA_BINARY_PACKED).  ``part`` numbers the files in order.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    spark = prepare(docs.sparkSession)
    if n_files is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # The row number makes the order total, so one hot doc_id can be cut between files.
    ordered = (
        require(docs, "doc_id", "text")
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(n_files, F.asc_nulls_first("doc_id"), "row")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "row")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.of(vocabulary or vocabulary_path())
        ids, offsets = encoder.encode([s or "" for s in batch.column("text").to_pylist()])
        ends = offsets[1:]
        with_end = np.insert(ids, ends, np.uint32(end_id)).astype(np.int32)
        bounds = offsets + np.arange(len(offsets))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(with_end))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(np.diff(bounds)), lists],
            names=["doc_id", "part", "n_tokens", "ids"],
        )

    dictionary = encoding == "dictionary"
    (
        map_texts(ordered, encode, "doc_id long, part long, n_tokens long, ids array<int>", ENCODED_BYTES)
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.writer.version", "PARQUET_1_0" if dictionary else "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read_token_digests(spark, path: str) -> DataFrame:
    """Position, length and crc32 of every document's ids, from the files alone."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy().astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        lengths = np.diff(bounds)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(lengths), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
        )

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield digest(batch)

    files = spark.read.schema("doc_id long, part long, n_tokens long, ids array<int>").parquet(path)
    # A file's blocks are read in order, so a split's first row position orders its documents.
    numbered = files.select("doc_id", "part", F.col("_metadata.row_index").alias("row"), "ids")
    rows = numbered.mapInArrow(run, "doc_id long, part long, row long, n_tokens long, ids_crc32 long")
    # One row for each file: their running total is short whatever the corpus.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "part",
        (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy("row")
    return (
        rows.join(before, "part")
        .withColumn("start", F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    path = shared_folder(docs.sparkSession, "tokens")
    write_token_files(docs, path, **options)
    return read_token_digests(docs.sparkSession, path)


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return token_round_trip(documents(spark, sf_dir))
