"""Language identification: held-out accuracy, calibration, the rows it may learn from."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from brambling.llm import language_id as g


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = g.train(docs)
    got = g.identify(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang_pred"] != g.UNDETERMINED]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang_pred"] == r["lang"] for r in held])) < 0.05
    assert np.mean(model.weights == 0) > 0.3  # the penalty makes weights exactly zero


def test_held_out_rows_teach_nothing(spark, documents):
    changed = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "zz").otherwise(F.col("lang")))
    a, b = g.train(documents), g.train(changed)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_counts_cover_all_rows(spark, documents):
    total, frequency = g.document_frequencies(documents)
    naive = np.zeros(1 << g.BITS)
    for r in documents.collect():
        naive[np.unique(g.ngram_codes(r["text"], g.BITS))] += 1
    assert total == documents.count() and np.array_equal(frequency, naive)


def test_edges(edges, nothing):
    model = g.train(edges)
    got = {(r["doc_id"], r["lang_pred"]): r for r in g.identify(edges, model).collect()}
    assert g.identify(edges, model).count() == edges.count()
    for doc in (2, 3, 4):
        assert got[doc, g.UNDETERMINED]["score"] == 0
    assert all(not r["held_out"] for (doc, _), r in got.items() if doc is None)
    assert g.identify(nothing, model).count() == 0
    empty = g.train(nothing)
    assert {r["lang_pred"] for r in g.identify(edges, empty).collect()} == {g.UNDETERMINED}
    kept = g.keep_identified(edges, model)
    assert kept.columns == edges.columns and kept.filter("text is null or trim(text) = ''").count() == 0


def test_temperature():
    logits = np.array([[4.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    assert g.temperature_of(logits, np.array([0, 0, 1, 1])) > 1
    assert g.temperature_of(np.zeros((0, 2)), np.array([], int)) == 1.0


def test_rare_languages_are_learned(spark):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "zwölf boxkämpfer jagen viktor", "cc": "ωμέγα άλφα βήτα γάμμα"}
    rows = [(i, f"{words[k]} {i} {words[k]}", k) for i, k in enumerate(["aa"] * 3000 + ["bb"] * 3000 + ["cc"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = g.train(docs, most=200)
    assert model.languages == ["aa", "bb", "cc"]
    assert model.predict("γάμμα βήτα ωμέγα")[0] == "cc" and model.predict("viktor jagen")[0] == "bb"
    sample = {r["lang"]: r["count"] for r in g.language_sample(docs, 200, 50).groupBy("lang").count().collect()}
    assert sample["cc"] == 6 and 30 <= sample["aa"] <= 300 and 30 <= sample["bb"] <= 300
