"""Operators against naive forms: the same rows both ways, with NULLs, ties, hot keys and empty inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambling.functions import text
from brambling.operators import counts, facets, joins, neighbours, pages, postings, ranking, slices
from brambling.sources import tables
from brambling.streaming import maintained

from .conftest import rows


@pytest.fixture(scope="module")
def facts(spark):
    """5,000 rows, a third on one key, NULL keys and dangling keys."""
    return spark.range(5000).select(
        F.col("id"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 120).cast("int").alias("fk"),
        (F.col("id") % 10).cast("int").alias("x"),
        F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("id") % 5).cast("int").alias("y"),
    ).cache()


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(1, 101).select(
        F.col("id").cast("int").alias("pk"),
        F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("id") % 7).cast("int").alias("attr"),
        F.when(F.col("id") % 3 == 0, "eu").otherwise("us").alias("region"),
    )


def same(a, b) -> bool:
    b = b.select(*a.columns)
    return rows(a) == rows(b)


def test_join_counts(facts, dim):
    naive = facts.join(dim, F.col("fk") == F.col("pk")).groupBy("attr", "y").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"))
    assert same(joins.join_counts(facts, dim, "fk", "pk", ["attr"], ["y"], ["x"]), naive)


def test_join_counts_with_repeating_keys(facts, dim):
    twice = dim.unionAll(dim.filter("pk < 20"))
    naive = facts.join(twice, F.col("fk") == F.col("pk")).groupBy("region").agg(F.count("*").alias("n"))
    assert same(joins.join_counts(facts, twice, "fk", "pk", ["region"]), naive)


def test_join_of_empty_tables(facts, dim):
    none = facts.limit(0)
    assert rows(joins.join_counts(none, dim, "fk", "pk", ["region"])) == []
    zero = rows(joins.dimension_counts(dim, none, "pk", "fk", ["region"]).select("region", "n_rows", "n"))
    assert zero == [("eu", 33, 0), ("us", 67, 0)]


def test_left_counts(facts, dim):
    naive = dim.join(facts, F.col("fk") == F.col("pk"), "left").groupBy("region").agg(F.count("*").alias("n_rows"), F.count("id").alias("n"))
    assert same(joins.dimension_counts(dim, facts, "pk", "fk", ["region"]), naive)


def test_semi_and_anti(facts, dim):
    matched = joins.having_match(facts, dim, "fk", "pk").count()
    lacking = joins.lacking_match(facts, dim, "fk", "pk").count()
    assert matched + lacking == 5000 and lacking >= 100  # NULL keys are kept by the anti join
    assert joins.not_in(facts, dim, "fk", "pk").count() == lacking - 100
    assert joins.not_in(facts, dim.limit(0), "fk", "pk").count() == 5000
    assert joins.not_in(facts, dim.select(F.lit(None).cast("int").alias("pk")), "fk", "pk").count() == 0


def test_lateral(facts, dim):
    wanted = dim.filter("region = 'eu' AND pk < 30")
    got = joins.lateral_counts(wanted, facts, "pk", "fk", [F.count("*").alias("n")]).select("pk", "n")
    naive = wanted.join(facts.groupBy("fk").agg(F.count("*").alias("n")), F.col("pk") == F.col("fk"), "left").select("pk", "n")
    assert same(got, naive)


@pytest.mark.parametrize("sets", [[["x", "y"], ["x"], []], [["y"]], [["x", "y"], ["x"], ["y"], []], [[]]])
def test_grouping_sets(spark, facts, sets):
    facts.createOrReplaceTempView("facts_")
    spelled = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    used = {k for s in sets for k in s}
    if used == {"x", "y"}:
        naive = spark.sql(f"SELECT x, y, grouping_id(x, y) AS grouping_id, count(*) AS n, sum(id) AS sum_id FROM facts_ GROUP BY x, y GROUPING SETS ({spelled})")
        assert same(counts.grouping_sets(facts, ["x", "y"], sets, ["id"]), naive)
    else:
        total = counts.grouping_sets(facts, ["x", "y"], sets, ["id"]).agg(F.sum("n"), F.sum("sum_id")).first()
        assert tuple(total) == (5000, 4999 * 2500)


def test_grouping_sets_over_nothing(facts):
    assert rows(counts.grouping_sets(facts.limit(0), ["x"], [["x"], []], ["id"])) == [(None, 1, 0, None)]


def test_sets_of_keys():
    assert counts.rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []]
    assert sorted(map(tuple, counts.cube_sets(["a", "b"]))) == [(), ("a",), ("a", "b"), ("b",)]


def test_distinct_counts(facts):
    naive = facts.groupBy("x").agg(F.countDistinct("y").alias("n_distinct"))
    assert same(counts.distinct_count(facts, "y", "x"), naive)
    assert counts.distinct_count(facts.limit(0), "y").first()[0] == 0


def test_counts(facts):
    assert counts.count_key(facts, "fk", 7) == facts.filter("fk = 7").count() > 1600
    assert counts.count_key(facts, "fk", None) == 0
    assert counts.count_keys(facts, "fk", 7, "x", 1) == facts.filter("fk = 7 AND x = 1").count()
    assert counts.count_any(facts, "fk", [7, None, 9]) == facts.filter("fk IN (7, 9)").count()
    assert counts.capped_count(facts, 100).first()[0] == 100 and counts.capped_count(facts.limit(3), 100).first()[0] == 3
    assert rows(counts.group_stats(facts, "y")) == [(6, 5000)]


def test_top_groups_break_ties_by_key(facts):
    assert rows(counts.top_groups(facts, ["x"], 3)) == [(0, 500), (1, 500), (2, 500)]


def test_facets(spark):
    df = spark.createDataFrame([(1, ["a", "a", None]), (2, ["a", "b"]), (3, []), (4, None), (5, ["c"])], "g int, tags array<string>")
    assert [tuple(r) for r in facets.facets(df, "tags", None, None, "array").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert [tuple(r) for r in facets.facets(df, "tags", 1, "g > 1", "array").collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        facets.facets(df, "tags", 1, "g + 1 > 1", "array")
    nulls = spark.createDataFrame([(None,), (None,), (1,), (2,)], "g int")
    assert [tuple(r) for r in facets.facets(nulls, "g").collect()] == [(None, 2), ("1", 1), ("2", 1)]


def test_pages(facts):
    page = pages.page_with_total(facts, [F.desc_nulls_last("y"), F.asc("id")], 5, 2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and all(r["total"] == 5000 for r in page.collect())
    first = pages.first_rows(facts, ["x"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert first.count() == 20
    assert rows(pages.latest(facts, ["x"], ["id"]).select("x", "id")) == [(x, 4990 + x) for x in range(10)]
    assert [r["id"] for r in pages.after(facts, "x", 8, "id", 4988, 3).collect()] == [4998, 9, 19]
    with pytest.raises(ValueError):
        pages.ordered(facts, [F.asc("id")], -1)


@pytest.mark.parametrize("kind,values", [("smallint", [-32768, 32767, 0, -1, None, 5]), ("int", [-(2**31), 2**31 - 1, 7, None]), ("bigint", [-(2**63), 2**63 - 1, 2**63 - 1, 3, None]), ("bigint", [])])
def test_bit_slices(spark, kind, values):
    df = spark.createDataFrame(list(enumerate(values)), f"id long, v {kind}")
    known = [v for v in values if v is not None]
    got = slices.sum_from_slices(slices.bit_slices(df, "v", "id"), kind).first()
    assert got["n"] == len(known) and (int(got["total"] or 0)) == sum(known)
    exact = slices.aggregate_as_text(df, "v").first()
    assert int(exact["total"] or 0) == sum(known)


def test_postings(facts):
    table = postings.posting_table(facts, ["fk", "y"], "id").cache()
    postings.verify(table, facts, "fk")
    postings.verify(table, facts, "y")
    with pytest.raises(ValueError):
        postings.verify(table, facts.filter("id > 3"), "y")
    assert postings.count_and(table, {"fk": [7, 8], "y": [1]}).first()[0] == facts.filter("fk IN (7, 8) AND y = 1").count()
    assert postings.count_and_not(table, "fk", [7], "y", [1, 2]).first()[0] == facts.filter("fk = 7 AND (y IS NULL OR y NOT IN (1, 2))").count()
    assert postings.count_and(table, {"fk": [-5], "y": [1]}).first()[0] == 0
    halves = [postings.posting_table(facts.filter(f"id {s} 2500"), ["y"], "id") for s in ("<", ">=")]
    assert same(postings.key_summary(postings.merged(*halves)), postings.key_summary(table.filter("column = 'y'")))


def test_bm25(spark):
    docs = [(0, "a b a c"), (1, "a"), (2, "b b b"), (3, ""), (4, None), (5, "d c")]
    df = spark.createDataFrame(docs, "id int, t string").select("id", text.vector(F.col("t")).alias("tok"))
    lists = {i: (t or "").split() for i, t in docs}
    full = [x for x in lists.values() if x]
    n, mean = len(full), sum(map(len, full)) / len(full)

    def score(words, terms):
        total = 0.0
        for w in terms:
            tf, d = words.count(w), sum(w in x for x in full)
            if tf:
                total += math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        return total

    got = ranking.bm25(df, "id", F.col("tok"), "a | b", 10).collect()
    want = sorted(((i, score(x, "ab")) for i, x in lists.items() if set("ab") & set(x)), key=lambda r: (-r[1], r[0]))
    assert [r["id"] for r in got] == [i for i, _ in want]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in want])
    assert ranking.bm25(df, "id", F.col("tok"), None, 10).count() == 0
    assert [r["id"] for r in ranking.bm25(df, "id", F.col("tok"), "a & b & !d", 10, match=True).collect()] == [0]


def test_neighbours(spark):
    r = np.random.RandomState(3)
    x = (r.randn(2000, 16) + 4 * np.repeat(r.randn(10, 16), 200, axis=0)).astype(np.float32)
    data = [(i, i % 4, v.tolist()) for i, v in enumerate(x)] + [(2000, 0, None)]
    df = spark.createDataFrame(data, "id int, g int, v array<float>").cache()
    query = x[17].astype(float).tolist()
    exact = [row["id"] for row in neighbours.nearest(df, "id", "v", query, 10).collect()]
    brute = np.argsort(((x.astype(float) - x[17].astype(float)) ** 2).sum(1), kind="stable")[:10].tolist()
    assert exact == brute
    centres = neighbours.fit_centroids(df, "v", partitions=20)
    parts = neighbours.partitioned(df, "v", centres).cache()
    assert parts.count() == 2001 and parts.filter("part = -1").count() == 1
    hits = 0
    for q in range(0, 2000, 100):
        near = {row["id"] for row in neighbours.nearest_probed(parts, "id", "v", centres, x[q].astype(float).tolist(), 10, nprobe=8).collect()}
        hits += len(near & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:10].tolist()))
    assert hits / 200 >= 0.9
    few = neighbours.nearest_probed(parts, "id", "v", centres, query, 3, condition="g = 1").collect()
    assert len(few) == 3
    assert neighbours.nearest(df, "id", "v", query, 2001).collect()[-1]["id"] == 2000  # NULL comes last
    assert neighbours.fit_centroids(df.limit(0), "v").size == 0


def test_streamed_counts(spark, facts, tmp_path):
    source = str(tmp_path / "in")
    facts.filter("id < 2000").write.parquet(source)
    stream = lambda: spark.readStream.schema(facts.schema).parquet(source)
    for k, part in enumerate(["id < 2000", "id >= 2000"]):
        if k:
            facts.filter(part).write.mode("append").parquet(source)
        maintained.maintain_counts(stream(), ["x"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        maintained.maintain_postings(stream(), ["y"], "id", f"{tmp_path}/post", f"{tmp_path}/cp2").awaitTermination()
    assert same(maintained.current_counts(spark, f"{tmp_path}/out", ["x"]), facts.groupBy("x").agg(F.count("*").alias("n")))
    postings.verify(spark.read.parquet(f"{tmp_path}/post").drop("batch"), facts, "y")


def test_windowed_stream(spark, tmp_path):
    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") % 2).alias("k"))
    events.write.parquet(str(tmp_path / "in"))
    counted = maintained.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "at", ["k"], "10 minutes", "5 minutes")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("windowed_").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windowed_").agg(F.sum("n"), F.count("*")).first() == (100, 20)


def test_tables(spark, facts, tmp_path):
    tables.save_partitioned(facts, str(tmp_path / "p"), ["x"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert same(back.select(*facts.columns), facts)
    assert "PartitionFilters: [isnotnull(x" in back.filter("x = 3")._jdf.queryExecution().executedPlan().toString()
    assert rows(tables.describe_keys(facts, "y")) == [(5000, 556, 0, 4444, 5, facts.groupBy("y").count().filter("y is not null").agg(F.max("count")).first()[0])]
    lists = spark.createDataFrame([([1, 1, None],), ([],), (None,)], "a array<int>")
    assert rows(tables.describe_keys(lists, "a", "array")) == [(3, 1, 1, 1, 1, 1)]


def test_bucketed_joins_do_not_shuffle(spark, facts, dim):
    tables.save_bucketed(facts.filter("fk is not null"), "facts_bucketed", ["fk"], 4)
    tables.save_bucketed(dim, "dim_bucketed", ["pk"], 4)
    joined = spark.table("facts_bucketed").hint("merge").join(spark.table("dim_bucketed"), F.col("fk") == F.col("pk"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE facts_bucketed")
    spark.sql("DROP TABLE dim_bucketed")
