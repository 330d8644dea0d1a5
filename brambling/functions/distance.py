"""Vector distances as expressions over float arrays, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A query vector as a literal array of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -_sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NaN where a vector is all zeros."""
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - _sum(a, b, lambda x, y: x * y) / norms)


METRICS = {"l2": l2, "ip": negative_inner_product, "cosine": cosine}
