"""Neighbours over partitions against all rows, on the query's own table."""

from __future__ import annotations

import numpy as np
import pytest

from brambling import catalog
from brambling.operators import neighbours

from .conftest import DATA


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(str(DATA / "sf0.1" / "embeddings.parquet")).cache()


def test_probed_query(spark):
    """The query finds what the exact one finds."""
    exact, probed = (catalog.QUERIES[name](spark, str(DATA / "sf0.1")).collect() for name in ("knn_l2", "knn_probed"))
    assert probed == exact


def test_recall_of_probed_query(vectors):
    """Every 50th row as query, with the registered query's partitions and probes."""
    rows = vectors.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    centres = neighbours.fit_centroids(vectors, "embedding", partitions=16)
    parts = neighbours.partitioned(vectors, "embedding", centres).cache()
    reach = neighbours.radii(parts, "embedding", centres)
    hits = 0
    for q in range(0, len(x), 50):
        want = ids[np.lexsort((ids, ((x - x[q]) ** 2).sum(1)))[:10]].tolist()
        hits += len({r["vec_id"] for r in neighbours.nearest_probed(parts, "vec_id", "embedding", centres, x[q].tolist(), 10, nprobe=6, reach=reach).collect()} & set(want))
    assert hits / (10 * len(range(0, len(x), 50))) >= 0.9


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_bounds(spark, metric):
    """No row is nearer than its partition's bound, and bounds leave out partitions of clustered rows."""
    r = np.random.RandomState(5)
    x = (np.repeat(5 * r.randn(40, 8), 50, axis=0) + 0.3 * r.randn(2000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [float("nan")] * 8)], "id int, v array<float>")
    centres = neighbours.fit_centroids(df.filter("id < 2000"), "v", partitions=40)
    parts = neighbours.partitioned(df, "v", centres).cache()
    reach = neighbours.radii(parts, "v", centres)
    owner = {row["id"]: row["part"] for row in parts.select("id", "part").collect()}
    for q in (x[3], x[777] * 0.1, -x[1500], r.randn(8)):
        q = np.array(q, float).tolist()
        least = neighbours.least_distances(centres, reach, q, metric)
        every = neighbours.nearest(df.filter("id < 2000"), "id", "v", q, 2000, metric).collect()
        assert all(row["distance"] >= least[owner[row["id"]]] for row in every)
        assert (least > every[9]["distance"]).sum() >= 10
        assert neighbours.nearest_probed(parts, "id", "v", centres, q, 10, 2, metric, reach=reach).collect() == every[:10]
    assert [row["id"] for row in neighbours.nearest_probed(parts, "id", "v", centres, q, 2002, 2, metric).collect()][2000:] == [2001, 2000]


def test_many_partitions(vectors):
    """As many partitions as a large table gets by default, few of them probed at first."""
    rows = vectors.select("vec_id", "embedding").collect()
    centres = neighbours.fit_centroids(vectors, "embedding", partitions=int(8 * len(rows) ** 0.5))
    parts = neighbours.partitioned(vectors, "embedding", centres).cache()
    reach = neighbours.radii(parts, "embedding", centres)
    for row in rows[::400]:
        found = neighbours.nearest_probed(parts, "vec_id", "embedding", centres, row["embedding"], 10, reach=reach).collect()
        assert found == neighbours.nearest(vectors, "vec_id", "embedding", row["embedding"], 10).collect()


def test_filter_far_from_the_query(spark):
    """More than exact_rows rows satisfy the condition, most of them in partitions far from the query."""
    r = np.random.RandomState(0)
    spots = 20 * r.randn(30, 16)
    x = (np.repeat(spots, 100, axis=0) + r.randn(3000, 16)).astype(np.float32)
    near = np.argsort(((spots - spots[0]) ** 2).sum(1))[:5]
    df = spark.createDataFrame([(i, i // 100 in near, v.tolist()) for i, v in enumerate(x)], "id int, close boolean, v array<float>").cache()
    centres = neighbours.fit_centroids(df, "v", partitions=30)
    parts = neighbours.partitioned(df, "v", centres).cache()
    query = x[0].astype(float).tolist()
    found = neighbours.nearest_probed(parts, "id", "v", centres, query, 10, nprobe=4, condition="not close").collect()
    assert found == neighbours.nearest(df, "id", "v", query, 10, condition="not close").collect()
    assert len(found) == 10
