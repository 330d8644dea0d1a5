"""A lexeme index as ordinary tables, for searches that are asked again and again.

``postings`` has a row for each lexeme and block of documents that were read together: an array
of their keys, and packed lengths, occurrences and positions.  Its folders are buckets of lexemes and its files are sorted,
so a search reads the folders and row groups of its own words and never the texts.  ``lexemes`` and
``documents`` hold what statistics and negations need.  A lexeme of most documents has a row for each
block, and its folder several files, so no task gets it whole.
Appended rows are further files; counts are added up when they are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from ..functions import folded, text
from ..functions.text import And, Not, Or, Phrase, Query, Term
from ..session import batched, ship
from .ranking import B, K1, Statistics, formula

#: Folders that lexemes are dealt to; one more has a row for each document.
BUCKETS = 64
#: Lexemes that a prefix is expanded to at most; a wider one is a range filter on all folders.
EXPANSIONS = 1000
#: Bytes of text, or tokens, that are grouped at once: documents of one block.
BLOCK = 16 << 20
#: More than any number of a place.
RING = 1 << 33


def _bucket(lexeme: str) -> int:
    return zlib.crc32(lexeme.encode()) % BUCKETS


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Numbers of up to 35 bits, seven bits a byte from the lowest; a binary for each range of ``offsets``."""
    values = values.astype("uint64")
    sizes = np.ones(len(values), "int64")
    for bits in (7, 14, 21, 28):
        sizes += values >= 1 << bits
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], "uint8")
    for k in range(sizes.max(initial=0)):
        longer = sizes > k
        out[bounds[:-1][longer] + k] = (values[longer] >> np.uint64(7 * k)) & np.uint64(127) | (sizes[longer] > k + 1).astype("uint64") << np.uint64(7)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(bounds[offsets].astype("int32")), pa.py_buffer(out)])


def _unpacked(column: pa.Array) -> np.ndarray:
    """The numbers of all rows, one after another."""
    data = np.frombuffer(b"".join(column.to_pylist()), "uint8")
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    sizes, out = ends - starts, np.zeros(len(ends), "int64")
    for k in range(sizes.max(initial=0)):
        longer = sizes > k
        out[longer] |= (data[starts[longer] + k] & 127).astype("int64") << 7 * k
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``BLOCK`` bytes of text, or tokens, or a little more; a row is never cut."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        column = batch.column(1)
        sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        reached = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype("int64"))
        start = 0
        while start < batch.num_rows:
            before = int(reached[start - 1]) if start else 0
            end = min(int(np.searchsorted(reached, before + BLOCK - total)) + 1, batch.num_rows)
            held.append(batch.slice(start, end - start))
            total += int(reached[end - 1]) - before
            start = end
            if total >= BLOCK:
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def _rows(lists: pa.Array) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def _worded(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Row, lexeme and position of each word of folded texts, in order."""
    parts = pc.split_pattern(column, "  ")
    lexemes = parts.flatten()
    kept = pc.greater(pc.binary_length(lexemes), 0)
    row = _rows(parts)[kept.to_numpy(zero_copy_only=False)]
    starts = np.searchsorted(row, np.arange(len(column)))
    return row, lexemes.filter(kept), pa.array(np.arange(1, len(row) + 1) - starts[row], pa.int32())


def _placed(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Row, lexeme, position and weight of each token of arrays, by place in each row."""
    flat = column.flatten()
    each = pa.table({"row": _rows(column), **{n: pc.struct_field(flat, n) for n in ("lex", "pos", "w")}})
    # No search names a NULL lexeme.
    each = each.filter(pc.is_valid(each["lex"]))
    # NULL positions and weights are first.
    by = [("row", "ascending"), ("has_pos", "ascending"), ("pos", "ascending"), ("has_w", "ascending"), ("w", "ascending")]
    each = each.append_column("has_pos", pc.is_valid(each["pos"])).append_column("has_w", pc.is_valid(each["w"])).sort_by(by).combine_chunks()
    lexemes, positions, weights = (each.column(n).combine_chunks() for n in ("lex", "pos", "w"))
    return each.column("row").to_numpy(), lexemes, positions, weights


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A block for each lexeme, and one without a lexeme for all rows that aren't NULL."""
    keys, column = batch.columns
    if pa.types.is_list(column.type):
        row, lexemes, positions, weights = _placed(column)
        lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    else:
        (row, lexemes, positions), weights = _worded(column), None
        lengths = np.bincount(row, minlength=len(keys))
    coded = pc.dictionary_encode(lexemes)
    code = coded.indices.to_numpy(zero_copy_only=False)
    # Tokens are in order of rows and places, and stay so for each lexeme.
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    every = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    rows = np.concatenate([row[first], every])
    places = np.concatenate([first, np.full(len(every) + 1, len(row))])
    block = np.concatenate([np.searchsorted(code[first], np.arange(len(coded.dictionary) + 1)), [len(rows)]])
    offsets = pa.array(block, pa.int32())
    # 0 is a token without a position.
    stood = np.where(pc.is_valid(positions).to_numpy(zero_copy_only=False), positions.fill_null(0).to_numpy(zero_copy_only=False).astype("int64") % (1 << 32) + 1, 0)[order]
    # Steps from the token before, in a ring: they are small, as places ascend, and any number comes back.
    steps = np.diff(stood, prepend=0)
    steps[first] = stood[first]
    if weights is None:
        weighed = pa.nulls(len(block) - 1, pa.list_(pa.list_(pa.string())))
    else:
        weighed = pa.ListArray.from_arrays(offsets, pa.ListArray.from_arrays(pa.array(places, pa.int32()), weights.take(pa.array(order))))
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]),
            pa.array(np.diff(block), pa.int32()),
            pa.ListArray.from_arrays(offsets, keys.take(pa.array(rows))),
            _packed(lengths[rows], block),
            _packed(np.diff(places), block),
            _packed(steps % RING, places[block]),
            weighed,
        ],
        ["lexeme", "documents", "key", "length", "tf", "places", "weights"],
    )


def _postings(blocks: DataFrame, placed: bool = False, weighted: bool = False) -> DataFrame:
    """A row for each lexeme and document of blocks; positions and weights only where they are asked for."""
    columns = ["lexeme", "documents", "key", "length", "tf"] + ["places"] * placed + ["weights"] * weighted

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = dict(zip(columns, batch.columns))
        row, tf = np.repeat(np.arange(batch.num_rows), of["documents"].to_numpy()), _unpacked(of["tf"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(tf)]), pa.int32())
        out = [of["lexeme"].take(pa.array(row)), of["key"].flatten(), pa.array(_unpacked(of["length"]), pa.int32()), pa.array(tf, pa.int32())]
        if placed:
            steps = np.concatenate([[0], np.cumsum(_unpacked(of["places"]))])
            stood = (steps[1:] - np.repeat(steps[offsets.to_numpy()[:-1]], tf)) % RING
            out.append(pa.ListArray.from_arrays(offsets, pa.array((stood - 1).astype("uint32").astype("int32"), pa.int32(), mask=stood == 0)))
        if weighted:
            # Blocks of texts have none: all are D.
            each = [pa.repeat("D", n) if w is None else pa.array([x for xs in w for x in xs], pa.string()) for w, n in zip(of["weights"].to_pylist(), np.bincount(row, tf, batch.num_rows).astype(int).tolist())]
            out.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(each)))
        return pa.RecordBatch.from_arrays(out, kept.names)

    kept = StructType().add("lexeme", "string").add("key", blocks.schema["key"].dataType.elementType).add("length", "integer").add("tf", "integer")
    for name, kind in [("places", IntegerType())] * placed + [("weights", StringType())] * weighted:
        kept = kept.add(name, ArrayType(kind))
    return blocks.select(*columns).mapInArrow(lambda batches: (opened(b) for b in batches if b.num_rows), kept)


def _schema(key: DataType) -> StructType:
    """Columns of a block."""
    out = StructType().add("lexeme", "string").add("documents", "integer").add("key", ArrayType(key))
    for name in ("length", "tf", "places"):
        out = out.add(name, "binary")
    return out.add("weights", ArrayType(ArrayType(StringType())))


def write_index(df: DataFrame, key: str, tokens: Column, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Index the token arrays or the texts of a table; with ``mode='append'`` rows of new keys join an index.

    NULL tokens are documents that match nothing, not even a negation.  A document is read once: its tokens
    are grouped where it lies, and blocks are moved once, to their folders' files.  Adaptive execution bounds
    these by bytes, whatever a lexeme has; ``files`` is how many parts it begins with.
    """
    spark = batched(ship(df.sparkSession))
    own = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    if isinstance(own.schema["tokens"].dataType, StringType):
        own = own.withColumn("tokens", folded.fold(F.col("tokens")))
    each = own.mapInArrow(lambda batches: map(_blocks, _gathered(batches)), _schema(own.schema["key"].dataType))
    ready = each.withColumn("bucket", F.coalesce((F.crc32("lexeme") % BUCKETS).cast("int"), F.lit(BUCKETS)))
    dealt = ready.hint("rebalance", *([] if files is None else [files]), "bucket")
    dealt.sortWithinPartitions("bucket", "lexeme").write.mode(mode).partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    # An index is read back once it is written; rows that join one are counted by themselves.
    made = ready if mode == "append" else spark.read.schema(ready.schema).parquet(f"{path}/postings")
    counted = made.filter(F.col("bucket") < BUCKETS).groupBy("lexeme").agg(F.sum("documents").alias("documents"))
    counted.repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.mode(mode).parquet(f"{path}/lexemes")
    known = _postings(made.filter(F.col("bucket") == BUCKETS)).select("key", "length")
    known.write.mode(mode).parquet(f"{path}/documents")


def _terms(query: Query | None) -> Iterable[Term]:
    if isinstance(query, Term):
        yield query
    elif isinstance(query, Not):
        yield from _terms(query.part)
    elif query is not None:
        yield from _terms(query.left)
        yield from _terms(query.right)


def _true_of_nothing(query: Query | None) -> bool:
    """Whether a document without any of the query's words matches."""
    if isinstance(query, Not):
        return not _true_of_nothing(query.part)
    if isinstance(query, (And, Phrase)):
        return _true_of_nothing(query.left) and _true_of_nothing(query.right)
    if isinstance(query, Or):
        return _true_of_nothing(query.left) or _true_of_nothing(query.right)
    return False


class TextIndex:
    """Searches over an index folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        spark = batched(ship(spark))
        self.documents = spark.read.parquet(f"{path}/documents")
        # A partitioned table of no rows has no file that tells its schema.
        schema = _schema(self.documents.schema["key"].dataType).add("bucket", "integer")
        self.blocks = spark.read.schema(schema).parquet(f"{path}/postings")
        self.lexemes = spark.read.parquet(f"{path}/lexemes").groupBy("lexeme").agg(F.sum("documents").alias("documents"))

    def _of(self, terms: Iterable[Term], placed: bool = False, weighted: bool = False) -> DataFrame:
        """Postings of all lexemes that the terms name; with ``places`` and ``weights`` where they are asked for."""
        known, prefixes = set(), []
        for t in terms:
            if not t.prefix:
                known.add(t.lexeme)
                continue
            found = self.lexemes.filter(F.col("lexeme").startswith(t.lexeme)).select("lexeme").limit(EXPANSIONS + 1).collect()
            if len(found) > EXPANSIONS:
                prefixes.append(t.lexeme)
            else:
                known |= {r["lexeme"] for r in found}
        test = F.col("bucket").isin(sorted({_bucket(w) for w in known})) & F.col("lexeme").isin(sorted(known))
        for p in prefixes:
            test = test | F.col("lexeme").startswith(p)
        return _postings(self.blocks.filter(test), placed, weighted)

    def statistics(self, query: str | Query) -> Statistics:
        """What ``ranking.statistics`` finds, from the small tables alone."""
        terms = text.scoring_terms(query)
        total = self.documents.filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        found = {r["lexeme"]: r["documents"] for r in self.lexemes.filter(F.col("lexeme").isin(terms)).collect()}
        return Statistics(total["n"], total["mean"] or 1.0, {w: found.get(w, 0) for w in terms})

    def matching(self, query: str | Query | None) -> DataFrame:
        """``key`` of documents that satisfy the query, as ``text.matches`` of their tokens has it.

        A document's tokens are put together from the postings of the query's words alone.
        """
        parsed = text.parse_query(query) if isinstance(query, str) else query
        if parsed is None:
            return self.documents.select("key").limit(0)
        # Positions are only read for phrases and weights.
        weighted = any(t.weights for t in _terms(parsed))
        placed = weighted or _has_phrase(parsed)
        def tokens_of(own: Column) -> Column:
            def token(pos: Column, w: Column) -> Column:
                return F.struct(own["lexeme"].alias("lex"), pos.cast("int").alias("pos"), w.cast("string").alias("w"))

            if not placed:
                return F.array(token(F.lit(None), F.lit(None)))
            return F.transform(own["places"], lambda p, i: token(p, F.get(own["weights"], i) if weighted else F.lit(None)))

        # What is moved is one entry for each word, not one for each token.
        own = F.struct("lexeme", *["places"] * placed, *["weights"] * weighted)
        held = self._of(_terms(parsed), placed, weighted).groupBy("key").agg(F.collect_list(own).alias("own"))
        tokens = held.select("key", F.flatten(F.transform("own", tokens_of)).alias("tokens"))
        test = text.matches(F.col("tokens"), parsed)
        if _true_of_nothing(parsed):
            return self.documents.select("key").join(tokens.filter(~test).select("key"), "key", "left_anti")
        return tokens.filter(test).select("key")

    def bm25(self, query: str | None, k: int | None, k1: float = K1, b: float = B, match: bool = False, known: Statistics | None = None) -> DataFrame:
        """``key, score`` of the ``k`` best documents, as ``ranking.bm25`` gives them."""
        if query is None or k is None:
            return self.documents.select("key", F.lit(0.0).alias("score")).limit(0)
        known = known or self.statistics(query)
        words = list(known.frequencies)
        rows = self._of([Term(w) for w in words])
        # One count for each word and document: they are added in the query's order whatever comes first.
        counts = [F.coalesce(F.sum(F.when(F.col("lexeme") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}_") for i, w in enumerate(words)]
        held = rows.groupBy("key").agg(F.max("length").alias("length_"), *counts)
        if match:
            held = held.join(self.matching(query), "key", "left_semi")
        score = formula(known, F.col("length_"), {w: F.col(f"tf{i}_") for i, w in enumerate(words)}, k1, b)
        return held.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)


def _has_phrase(query: Query | None) -> bool:
    if isinstance(query, Phrase):
        return True
    if isinstance(query, Not):
        return _has_phrase(query.part)
    return isinstance(query, (And, Or)) and (_has_phrase(query.left) or _has_phrase(query.right))
