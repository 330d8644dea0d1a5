"""The pipeline: each stage's decision takes effect, rows are whole, run() equals the stages in turn."""

from __future__ import annotations

import corpus_pipeline
from brambling.llm import cotraining, hyperminhash, language_id, packing, pii_feistel
from brambling.llm.common import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small_dir, tmp_path):
    docs = documents(spark, small_dir)
    labels = documents(spark, small_dir, "labels")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "language", "near_duplicates", "pii", "packing"]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small_dir)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == COLUMNS
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            seen[name] = (seen[name][0], docs)

    def ids(df, test="true"):
        return {r["doc_id"] for r in df.filter(test).select("doc_id").collect()}

    before, after = seen["quality"]
    assert ids(after) == ids(cotraining.score(before, cotraining.train(before, labels)), "kept")
    before, after = seen["language"]
    judged = language_id.identify(before, language_id.train(before))
    assert ids(after) == ids(judged, f"lang_pred <> 'und' and score >= {language_id.LEAST_SCORE}")
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(hyperminhash.near_duplicates(before, 5, 80), "kept")
    before, after = seen["pii"]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, pii_feistel.pseudonymise(before, pii_feistel.TEST_KEY).collect()))
    before, after = seen["packing"]
    assert ids(after) == ids(before)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, small_dir).collect()))
    assert whole == sorted(map(tuple, packing.pack(before).collect()))


def test_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = documents(spark, folder), documents(spark, folder, "labels")
    kept = corpus_pipeline.language(spark, corpus_pipeline.quality(spark, docs, folder), folder)
    good = labels.filter("quality = 1").select("doc_id")
    lost = good.join(kept, "doc_id", "left_anti").count()
    assert lost <= 0.02 * good.count()


def test_edges(spark, edges, nothing, small_dir):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, edges, small_dir)
        assert got.count() >= 1
        assert name == "packing" or got.columns == edges.columns
        assert stage(spark, nothing, small_dir).count() == 0
