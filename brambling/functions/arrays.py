"""Array predicates: NULL arrays give NULL, NULL elements never match, duplicates count once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(array: Column, test: Column) -> Column:
    """``test`` where the array isn't NULL."""
    return F.when(array.isNotNull(), test)


def _holds(array: Column, value) -> Column:
    return F.exists(array, lambda x: x.eqNullSafe(value))


def contains_all(array: Column, values: Sequence) -> Column:
    """``array @> values``; a NULL among the values is never contained, an empty list always."""
    if any(v is None for v in values):
        return _of(array, F.lit(False))
    return _of(array, reduce(lambda a, b: a & b, (_holds(array, v) for v in dict.fromkeys(values)), F.lit(True)))


def overlaps(array: Column, values: Sequence) -> Column:
    """``array && values``."""
    known = [v for v in dict.fromkeys(values) if v is not None]
    return _of(array, F.exists(array, lambda x: F.coalesce(x.isin(known), F.lit(False))) if known else F.lit(False))


def contained_by(array: Column, values: Sequence) -> Column:
    """``array <@ values``; an empty array is contained in any."""
    known = [v for v in values if v is not None]
    if not known:
        return _of(array, F.size(array) == 0)
    return _of(array, F.forall(array, lambda x: F.coalesce(x.isin(known), F.lit(False))))


def same_array(array: Column, values: Sequence) -> Column:
    """``array = values``: same elements in the same order, NULLs equal to NULLs."""
    if not values:
        return _of(array, F.size(array) == 0)
    pairs = [F.get(array, i).eqNullSafe(v) for i, v in enumerate(values)]
    return _of(array, (F.size(array) == len(values)) & reduce(lambda a, b: a & b, pairs))


def any_equals(array: Column, value) -> Column:
    """``value = ANY(array)``: NULL where nothing matches and an element is NULL."""
    return F.array_contains(array, value)


def contains_any_of(array: Column, lists: Sequence[Sequence]) -> Column:
    """``array @> ANY(lists)``."""
    return reduce(lambda a, b: a | b, (contains_all(array, x) for x in lists), _of(array, F.lit(False)))


def non_empty(array: Column) -> Column:
    return F.size(array) > 0


def is_empty(array: Column) -> Column:
    return F.size(array) == 0


def distinct_from_empty(array: Column) -> Column:
    """``array IS DISTINCT FROM '{}'``: NULL arrays are kept."""
    return array.isNull() | (F.size(array) > 0)


def empty_or_null(array: Column) -> Column:
    return array.isNull() | (F.size(array) == 0)


def keys_of(array: Column) -> Column:
    """Distinct elements that aren't NULL."""
    return F.array_distinct(F.filter(array, lambda x: x.isNotNull()))
