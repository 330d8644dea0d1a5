"""Hashed character n-grams and bounded hash samples, shared by the learned operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def ngram_codes(text: str, bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text; white space counts as one blank, digits as 0."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points < 33] = 32
    points[(points >= 48) & (points <= 57)] = 48
    out, rolled = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(orders) + 1):
        rolled = (rolled[: len(points) - n + 1] * np.uint32(31) + points[n - 1 :]) * _MULTIPLIERS[n % 4]
        if n in orders:
            out.append((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits))
    return np.concatenate(out)


def counted(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of codes, buckets ascending."""
    counts = np.bincount(codes, minlength=1 << bits)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), counts[buckets].astype(np.float32)


def hash_sample(rows: DataFrame, most: int, total: int, *by: str | Column) -> DataFrame:
    """About ``most`` of ``total`` rows, chosen by a hash of ``by``; never more than twice as many."""
    if total <= most:
        return rows.limit(2 * most)
    part = F.pmod(F.xxhash64(*by, F.lit(31)), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total))
    return rows.filter(part).limit(2 * most)
