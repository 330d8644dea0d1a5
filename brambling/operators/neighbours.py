"""Nearest neighbours: exact, filtered, within a distance, and over partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import METRICS, vector
from ..session import ship

#: Vectors that centroids are fitted on, for each partition and at most.
SAMPLE_EACH, SAMPLE_MOST = 64, 200_000


def nearest(df: DataFrame, key: str, column: str, query: Sequence[float], k: int, metric: str = "l2", condition: Column | str | None = None) -> DataFrame:
    """``key, distance``: the ``k`` nearest rows among those of ``condition``; exact.

    NULL vectors come last, then NaN (zero vectors under cosine distance) before NULL.
    """
    rows = df if condition is None else df.filter(condition)
    return rows.select(key, METRICS[metric](F.col(column), vector(query)).alias("distance")).orderBy(F.asc_nulls_last("distance"), key).limit(k)


def within(df: DataFrame, key: str, column: str, query: Sequence[float], most: float, metric: str = "l2") -> DataFrame:
    """Rows closer than a bound."""
    d = METRICS[metric](F.col(column), vector(query))
    return df.select(key, d.alias("distance")).filter(F.col("distance") < most)


def fit_centroids(df: DataFrame, column: str, partitions: int | None = None, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means centroids of a bounded sample; by default one for fewer than 10,000 rows, else 8 sqrt(n)."""
    rows = df.filter(F.col(column).isNotNull())
    n = rows.count()
    partitions = partitions or (1 if n < 10_000 else int(8 * math.sqrt(n)))
    most = min(SAMPLE_MOST, max(partitions, SAMPLE_EACH * partitions))
    share = 1.0 if n <= most else min(1.0, 1.2 * most / n)
    found = rows.select(column).sample(fraction=share, seed=seed).limit(most).toArrow().column(0)
    x = np.array(found.to_pylist(), np.float32)
    if not len(x):
        return np.zeros((0, 0), np.float32)
    random = np.random.RandomState(seed)
    centres = x[random.permutation(len(x))[:partitions]]
    for _ in range(rounds):
        owner = assign(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        sizes = np.bincount(owner, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centroid of every row, a block at a time."""
    norms = (centres**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * x[i : i + 4096] @ centres.T, axis=1) for i in range(0, max(1, len(x)), 4096)])


def partitioned(df: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """``df`` with ``part``, each vector's nearest centroid; NULL vectors have part -1.

    Written with ``partitionBy('part')``, a search reads only the folders that it probes.
    """
    shared = ship(df.sparkSession).sparkContext.broadcast(centres)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int"

    def run(batches):
        for batch in batches:
            values = batch.column(column).to_pylist()
            good = [i for i, v in enumerate(values) if v is not None]
            part = np.full(len(values), -1, np.int32)
            if good:
                part[good] = assign(np.array([values[i] for i in good], np.float32), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    return df.mapInArrow(run, schema)


def probes(centres: np.ndarray, query: Sequence[float], n: int) -> list[int]:
    """The ``n`` partitions nearest to the query."""
    d = ((centres - np.array(query, np.float32)) ** 2).sum(1)
    return [int(i) for i in np.argsort(d, kind="stable")[:n]]


def radii(parts: DataFrame, column: str, centres: np.ndarray) -> np.ndarray:
    """Largest distance from its centroid of a vector of each partition; below zero where there is none.

    Vectors with NaN elements don't count: they come last at any distance.
    """
    shared = ship(parts.sparkSession).sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            good = [(p, v) for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None]
            if good:
                part = np.array([p for p, _ in good])
                with np.errstate(invalid="ignore"):
                    gap = np.sqrt(((np.array([v for _, v in good], float) - shared.value[part]) ** 2).sum(1))
                most = np.full(len(shared.value), -np.inf)
                np.fmax.at(most, part, gap)
                held = np.unique(part)
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(most[held])], names=["part", "gap"])

    out = np.full(len(centres), -np.inf)
    for r in parts.select("part", column).mapInArrow(run, "part int, gap double").groupBy("part").agg(F.max("gap").alias("gap")).collect():
        out[r["part"]] = r["gap"]
    return out


def least_distances(centres: np.ndarray, reach: np.ndarray, query: Sequence[float], metric: str) -> np.ndarray:
    """What a row of each partition is away from the query at least (less rounding); NaN if nothing is known."""
    c, q = centres.astype(float), np.array(query, float)
    size, own = np.sqrt((c**2).sum(1)), math.sqrt((q**2).sum())
    with np.errstate(all="ignore"):
        if metric == "l2":
            least = np.sqrt(((c - q) ** 2).sum(1)) - reach - 1e-9 * (size + own + reach)
        elif metric == "ip":
            least = -(c @ q) - own * reach - 1e-9 * own * (size + reach)
        elif metric == "cosine":
            # The ball around a centroid lies in a cone around it, unless it holds the origin.
            cone = np.where(reach < size, np.arcsin(np.clip(reach / size, 0, 1)), math.pi)
            between = np.arccos(np.clip(c @ q / (size * own), -1, 1))
            least = 1 - np.cos(np.maximum(0, between - cone)) - 1e-7
        else:
            raise ValueError(f"unknown metric: {metric}")
    return np.where(reach < 0, np.inf, least)


def nearest_probed(
    parts: DataFrame, key: str, column: str, centres: np.ndarray, query: Sequence[float], k: int, nprobe: int = 8,
    metric: str = "l2", condition: Column | str | None = None, exact_rows: int = 2000, reach: np.ndarray | None = None,
) -> DataFrame:
    """``nearest`` over partitions; exact at any size, with and without a condition.

    The ``nprobe`` partitions near the query are read, then all others that can hold a row as near as
    the k-th found.  ``reach``: ``radii`` of the partitions, found here (all rows are read) if not given.

    With a condition, a set of at most ``exact_rows`` rows is searched whole instead.
    """
    rows = parts if condition is None else parts.filter(condition)
    if condition is not None and rows.limit(exact_rows + 1).count() <= exact_rows:
        return nearest(rows, key, column, query, k, metric)
    if k < 1 or len(centres) <= nprobe:
        return nearest(rows, key, column, query, k, metric)
    first = probes(centres, query, nprobe)
    found = nearest(rows.filter(F.col("part").isin(first)), key, column, query, k, metric)
    found = found.filter("not isnan(distance)").agg(F.count("distance").alias("n"), F.max("distance").alias("last")).first()
    if found["n"] < k:
        return nearest(rows, key, column, query, k, metric)
    least = least_distances(centres, radii(parts, column, centres) if reach is None else reach, query, metric)
    near = [i for i in range(len(centres)) if i in first or not least[i] > found["last"]]
    return nearest(rows.filter(F.col("part").isin(near)), key, column, query, k, metric)
