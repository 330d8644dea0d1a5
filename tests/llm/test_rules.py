"""Decision lists: statistics by brute force, learning on planted rules, and the verdict."""

from __future__ import annotations

import random
import re

import pytest

from brambling.llm import decision_list as d

from .conftest import odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, edges, documents):
    r = random.Random(3)
    repeats = [" ".join(r.choice("abc") for _ in range(r.choice([4, 5, 6, 30, 200]))) for _ in range(60)]
    lines = ["\n".join(r.choice(["x y", "x y ", "", " ", "z"]) for _ in range(20)) for _ in range(20)]
    made = spark.createDataFrame(list(enumerate(odd_texts(60, 5) + repeats + lines)), "doc_id long, text string")
    for docs in (made, edges, documents):
        want = sorted(((x["doc_id"], *brute(x["text"])) for x in docs.select("doc_id", "text").collect()), key=repr)
        stats = d.with_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted((tuple(x) for x in stats.collect()), key=repr) == want


def planted(n: int) -> list[d.Row]:
    r = random.Random(1)
    rows = []
    for _ in range(n):
        row = {f: r.random() for f in d.FEATURES}
        rows.append((row, row["symbol_share"] > 0.8 or row["mean_word"] > 0.7 and row["dup_line_share"] > 0.6))
    return rows


def test_rules_are_found():
    rules = d.learn(planted(3000))
    assert 1 <= len(rules) <= 12
    fresh = planted(500)
    covered = [any(all(c.holds(row) for c in rule) for rule in rules) for row, _ in fresh]
    assert sum(c == bad for c, (_, bad) in zip(covered, fresh)) >= 475


@pytest.mark.parametrize("rows", [[], [({f: 0.0 for f in d.FEATURES}, True)] * 5, [({f: 0.0 for f in d.FEATURES}, False)] * 5])
def test_nothing_to_learn(rows):
    assert all(isinstance(rule, tuple) for rule in d.learn(rows))


def test_plan_is_native(documents):
    rules = [(d.Condition("symbol_share", True, 0.2), d.Condition("n_words", False, 50)), (d.Condition("exclaim_share", True, 0.1),)]
    judged = d.apply_rules(documents, rules)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))
    features = {r["doc_id"]: r for r in d.with_features(d.with_statistics(documents)).collect()}
    for r in judged.collect():
        first = next((i for i, rule in enumerate(rules, 1) if all(c.holds(features[r["doc_id"]].asDict()) for c in rule)), 0)
        assert r["rule"] == first and r["kept"] == (not r["base_failed"] and not first)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 0, 0), (5, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = d.quality_rules(edges, labels)
    assert got.count() == edges.count()
    assert {r["kept"] for r in got.filter("text is null" if "text" in got.columns else "n_words = 0").collect()} == {False}
    assert d.quality_rules(nothing, labels).count() == 0
    assert d.quality_rules(edges, labels.limit(0)).filter("rule > 0").count() == 0


def test_query(spark, small_dir):
    got = d.op2(spark, small_dir)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    good = got.join(labels.filter("quality = 1"), "doc_id")
    assert good.filter("not kept").count() <= 0.05 * good.count()
