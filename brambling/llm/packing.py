"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

A document's ids (with its end id) are cut into full pieces and one remainder in the same pass that
encodes it, so only piece descriptions, never ids, are shuffled.  Pieces go to randomised groups of
at most about ``group_pieces``; each group is packed on its own.  The tree keeps the largest free capacity
below every node, so the leftmost bin that fits is found in O(log bins).

Defined results: null text is the empty text (one piece with the end id); a null ``doc_id`` stays
null; repeated rows are packed separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENCODED_BYTES, map_texts, prepare, require
from .tokens import Encoder, vocabulary_path

#: Pieces of a group: enough for little padding, few enough for one task's memory.
GROUP_PIECES = 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Leftmost bin with enough room; bins open as they are needed."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free room before) of the first bin that takes ``size``."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        room = free[node]
        leaf, free[node] = node - self.leaves, room - size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return leaf, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in the order given."""
    tree = TournamentTree(len(sizes), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        leaf, room = tree.place(sizes[i])
        out[i] = leaf, capacity - room
    return out


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """Piece descriptions of every document: full pieces, then the remainder."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.of(vocabulary or vocabulary_path())
        ids, offsets = encoder.encode([s or "" for s in batch.column("text").to_pylist()])
        rows: list[tuple] = []
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            stream = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
            total = len(stream)
            whole = zlib.crc32(stream)
            for start in range(0, total, capacity):
                part = stream[start : start + capacity]
                rows.append((doc, start, len(part), zlib.crc32(part), total, hash((whole, start))))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return map_texts(require(docs, "doc_id", "text"), cut, _PIECES, ENCODED_BYTES)


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    group_pieces: int = GROUP_PIECES,
    seed: int = 20,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row for each piece."""
    prepare(docs.sparkSession)
    # A row has one remainder, and a full piece for each ``capacity`` ids, of two bytes or more as a rule:
    # very long texts bring more groups, not larger ones.
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_groups = max(1, -(-(rows + size // (2 * capacity)) // group_pieces))

    def pack_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["salt", "grp"]).sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        placed = first_fit_decreasing(table["length"].to_pylist(), capacity)
        first = key[0].as_py() << 32
        table = table.append_column("sequence_id", pa.array([first + b for b, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    # The row's place in its task is part of the salt, so copies of one row spread over all groups.
    salted = pieces(docs, capacity, end_id, vocabulary).withColumn(
        "grp", F.pmod(F.xxhash64("salt", "doc_id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(n_groups))
    )
    return salted.groupBy("grp").applyInArrow(pack_group, _PACKED)


def padding(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, ids and padding ids; a sequence whose length is a power of two isn't padded."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    exact = F.bit_count("used") == 1
    return used.agg(
        F.count("*").alias("n_sequences"),
        F.sum("used").alias("n_ids"),
        F.sum(F.when(exact, 0).otherwise(capacity - F.col("used"))).alias("n_padding"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return pack(documents(spark, sf_dir))
