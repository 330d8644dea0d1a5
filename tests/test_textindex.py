"""The lexeme index gives what a scan of the tokens gives."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brambling.functions import text
from brambling.functions.text import Term
from brambling.operators import ranking
from brambling.operators.textindex import BLOCK, TextIndex, _gathered, _packed, _unpacked, write_index
from brambling.sources.tables import load

WORDS = [f"w{i}" for i in range(7)] + ["wide", "é"]
QUERIES = [
    "w1", "absent", "w1 & w2", "w1 | é", "w1 & !w2", "!w3", "!(w1 & w2)", "w1 <-> w2", "w1 <2> w3", "w1 <-> !w2", "!w1 <-> w2", "wi:*", "w:* & !w5",
    "w1:A", "w1:B <-> w2", "(w1 | w2) <-> (w3 & !w4)", "!absent", "absent:*",
]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        words = ["w0"] * (i % 3 == 0) + [r.choice(WORDS) for _ in range(r.choice([0, 1, 4, 9, 20]))]
        rows.append((i, None if i % 41 == 7 else [(w, p + 1, r.choice("ABD")) for p, w in enumerate(words)]))
    return spark.createDataFrame(rows, "id long, tok array<struct<lex:string,pos:int,w:string>>").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "whole")
    write_index(docs, "id", F.col("tok"), path, files=6)
    return TextIndex(spark, path)


@pytest.mark.parametrize("query", QUERIES)
def test_matching(index, docs, query):
    want = sorted(r["id"] for r in docs.filter(text.matches(F.col("tok"), query)).collect())
    assert sorted(r["key"] for r in index.matching(query).collect()) == want


@pytest.mark.parametrize("query", ["w1 | w2", "w0", "w3 & !w1", "absent", "w1 <-> w2"])
def test_ranking(index, docs, query):
    for match in (False, True):
        want = [(r["id"], r["score"]) for r in ranking.bm25(docs, "id", F.col("tok"), query, 12, match=match).collect()]
        assert [(r["key"], r["score"]) for r in index.bm25(query, 12, match=match).collect()] == want
    assert index.statistics(query) == ranking.statistics(docs, F.col("tok"), query)
    assert index.bm25(None, 3).count() == index.bm25(query, None).count() == 0


def test_only_folders_of_the_words_are_read(index):
    plan = index.matching("w1 & w2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(lexeme, [w1,w2])" in plan and "places" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_appended_rows(spark, docs, index, tmp_path):
    path = str(tmp_path / "parts")
    write_index(docs.filter("id < 100"), "id", F.col("tok"), path)
    write_index(docs.filter("id >= 100"), "id", F.col("tok"), path, mode="append")
    grown = TextIndex(spark, path)
    assert grown.statistics("w1 | w2") == index.statistics("w1 | w2")
    for query in ("w1 <-> w2", "!w3"):
        assert sorted(map(tuple, grown.matching(query).collect())) == sorted(map(tuple, index.matching(query).collect()))
    assert sorted(map(tuple, grown.lexemes.collect())) == sorted(map(tuple, index.lexemes.collect()))


def test_empty_tables(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    write_index(docs.limit(0), "id", F.col("tok"), path)
    none = TextIndex(spark, path)
    assert none.matching("!w1").count() == none.matching("w1").count() == none.bm25("w1", 5).count() == 0
    assert none.matching("").count() == 0


def test_texts_are_indexed_as_their_tokens(spark, small_dir, tmp_path):
    """Also texts that are NULL, have no word, or one word alone, in letters that change when folded."""
    odd = [(-1, None), (-2, ""), (-3, " .,! "), (-4, "The"), (-5, "İstanbul, the ΣΑΣ straße; of the of"), (-6, "the " * 5000 + "with")]
    docs = load(spark, small_dir, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    docs = docs.repartition(5).cache()
    write_index(docs, "doc_id", F.col("text"), str(tmp_path / "texts"))
    index, tokens = TextIndex(spark, str(tmp_path / "texts")), text.vector(F.col("text"))
    for query in ("of <-> the & !with", "!(the | les)", "the:D & with:A", "i:* | strasse | straße", "the <2> of"):
        want = sorted(r[0] for r in docs.filter(text.matches(tokens, query)).select("doc_id").collect())
        assert sorted(r["key"] for r in index.matching(query).collect()) == want
    assert index.statistics("the | with") == ranking.statistics(docs, tokens, "the | with")
    want = [tuple(r) for r in ranking.bm25(docs, "doc_id", tokens, "the | with", 20).collect()]
    assert [tuple(r) for r in index.bm25("the | with", 20).collect()] == want
    assert docs.filter("text is not null").count() == index.documents.count()


def test_stripped_tokens(spark, docs, tmp_path):
    """Tokens without positions and weights match words alone."""
    bare = docs.select("id", text.strip(F.col("tok")).alias("tok"))
    write_index(bare, "id", F.col("tok"), str(tmp_path / "bare"))
    index = TextIndex(spark, str(tmp_path / "bare"))
    for query in ("w1 & !w2", "w1 <-> w2", "w1:A", "w:* & !w5"):
        want = sorted(r["id"] for r in bare.filter(text.matches(F.col("tok"), query)).collect())
        assert sorted(r["key"] for r in index.matching(query).collect()) == want


def test_each_document_is_read_once(spark, docs, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(key):
        read.add(1)
        return key

    tokens = F.when(F.col("seen") >= 0, F.col("tok"))
    write_index(docs.withColumn("seen", seen("id")), "id", tokens, str(tmp_path / "once"))
    assert read.value == docs.count()


def test_blocks():
    """Rows aren't cut, blocks reach their size at most by a row, and packed numbers come back."""
    sizes = [5, BLOCK // 2, BLOCK // 2, 0, BLOCK * 2, 7, 7]
    whole = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * n for n in sizes])], ["key", "tokens"])
    batches = [whole.slice(0, 2), whole.slice(2, 0), whole.slice(2)]
    assert [b.column(0).to_pylist() for b in _gathered(iter(batches))] == [[0, 1, 2], [3, 4], [5, 6]]
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, 1 << 28, 1 << 32, 5], "int64")
    packed = _packed(numbers, np.array([0, 3, 3, 9, 10]))
    assert len(packed) == 4 and _unpacked(packed).tolist() == numbers.tolist()
    assert _unpacked(packed.slice(2, 1)).tolist() == numbers[3:9].tolist()
    assert not len(_unpacked(_packed(numbers[:0], np.array([0, 0]))))


def test_a_common_lexeme_has_a_row_for_each_block(index, docs):
    found = index.blocks.filter("lexeme = 'w0'").select("documents").collect()
    assert len(found) == docs.rdd.getNumPartitions() > 1
    assert sum(r["documents"] for r in found) == docs.filter(text.holds(F.col("tok"), "w0")).count()


def test_entries_of_words_are_moved(index):
    """The shuffle of a phrase search has a word's places as they are stored; tokens are made behind it."""
    plan = index.matching("w1 <-> w2")._jdf.queryExecution().executedPlan().toString()
    partial = [line for line in plan.split("\n") if "partial_collect_list" in line]
    assert len(partial) == 1 and "pos" not in partial[0] and "collect_list(struct(lexeme, lexeme" in partial[0], plan


def test_any_places(spark, tmp_path):
    """Positions that don't ascend from 1, repeat or are missing come back."""
    rows = [(1, [("a", -5, "A"), ("a", 7, None), ("b", 8, "B")]), (2, [("a", None, None), ("a", 2**31 - 1, "D"), ("b", -(2**31), "D")]), (3, [("a", 3, "C"), ("a", 3, "A")])]
    docs = spark.createDataFrame(rows, "id long, tok array<struct<lex:string,pos:int,w:string>>")
    write_index(docs, "id", F.col("tok"), str(tmp_path / "any"))
    found = TextIndex(spark, str(tmp_path / "any"))._of([Term("a"), Term("b")], placed=True, weighted=True)
    got = sorted((r["key"], r["lexeme"], r["places"], r["weights"]) for r in found.collect())
    assert got == [
        (1, "a", [-5, 7], ["A", None]), (1, "b", [8], ["B"]), (2, "a", [None, 2**31 - 1], [None, "D"]),
        (2, "b", [-(2**31)], ["D"]), (3, "a", [3, 3], ["A", "C"]),
    ]
