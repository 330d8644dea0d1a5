"""Day and unit bounds of timestamps, and date filters as ranges that reach the scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")
_YEARS = {"decade": 10, "century": 100, "millennium": 1000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12} | {u: 12 * y for u, y in _YEARS.items()}
_DELTAS = {
    "microsecond": timedelta(microseconds=1), "millisecond": timedelta(milliseconds=1), "second": timedelta(seconds=1),
    "minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(weeks=1),
}


def truncated(unit: str, at: datetime) -> datetime:
    """Start of the unit that holds ``at``; weeks begin on Monday, centuries in year 1."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    if unit in _YEARS:
        years, first = _YEARS[unit], 0 if unit == "decade" else 1
        start = (at.year - first) // years * years + first
        if start < 1:
            raise ValueError(f"no {unit} of {at} within years 1 to 9999")
        return datetime(start, 1, 1)
    if unit in _MONTHS:
        months = _MONTHS[unit]
        return datetime(at.year, (at.month - 1) // months * months + 1, 1)
    if unit == "week":
        return datetime(at.year, at.month, at.day) - timedelta(days=at.weekday())
    step = _DELTAS[unit]
    return at - (at - datetime(1, 1, 1)) % step


def following(unit: str, start: datetime) -> datetime:
    """Start of the next unit."""
    if unit in _DELTAS:
        return start + _DELTAS[unit]
    months = start.month - 1 + _MONTHS[unit]
    return datetime(start.year + months // 12, months % 12 + 1, 1)


def day_first(day: Column) -> Column:
    """First timestamp of a day."""
    return day.cast("date").cast("timestamp_ntz")


def day_last(day: Column) -> Column:
    """Last microsecond of a day."""
    return F.date_add(day.cast("date"), 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND")


def unit_first(unit: str, at: datetime) -> datetime:
    """First timestamp whose unit start is ``at`` or later."""
    start = truncated(unit, at)
    return at if start == at else following(unit, start)


def unit_last(unit: str, at: datetime) -> datetime:
    """Last microsecond whose unit start is ``at`` or earlier."""
    return following(unit, truncated(unit, at)) - timedelta(microseconds=1)


def unit_start(unit: str, ts: Column) -> Column:
    """``date_trunc(unit, ts)`` of a timestamp without time zone, for all units."""
    if unit in _YEARS:
        years, first = _YEARS[unit], 0 if unit == "decade" else 1
        start = F.floor((F.year(ts) - first) / years) * years + first
        return F.make_date(start.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def unit_end(unit: str, ts: Column) -> Column:
    """Start of the unit after the one that holds ``ts``."""
    start = unit_start(unit, ts)
    if unit in _MONTHS:
        return start + F.make_ym_interval(F.lit(0), F.lit(_MONTHS[unit]))
    return start + F.lit(_DELTAS[unit])


def first_reaching(unit: str, ts: Column) -> Column:
    """First timestamp whose unit start is ``ts`` or later."""
    return F.when(unit_start(unit, ts) == ts, ts).otherwise(unit_end(unit, ts))


def last_within(unit: str, ts: Column) -> Column:
    """Last microsecond whose unit start is ``ts`` or earlier."""
    return unit_end(unit, ts) - F.lit(timedelta(microseconds=1))


def _literal(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def unit_compare(column: Column, unit: str, operator: str, value: datetime | date) -> Column:
    """``date_trunc(unit, column) operator value`` as a range on the column itself.

    The scan sees plain comparisons and skips row groups; ``date_trunc`` would hide the column.
    Operators: ``= <> < <= > >=``; NULL stays NULL.
    """
    at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    first, last = unit_first(unit, at), unit_last(unit, at)
    after = last + timedelta(microseconds=1)
    exact = truncated(unit, at) == at
    if operator == "=":
        return (column >= _literal(at)) & (column < _literal(after)) if exact else F.when(column.isNotNull(), F.lit(False))
    if operator == "<>":
        return (column < _literal(at)) | (column >= _literal(after)) if exact else F.when(column.isNotNull(), F.lit(True))
    if operator == "<":
        return column < _literal(first)
    if operator == "<=":
        return column < _literal(after)
    if operator == ">":
        return column >= _literal(after)
    if operator == ">=":
        return column >= _literal(first)
    raise ValueError(f"unknown operator: {operator}")


def day_compare(column: Column, operator: str, value: date) -> Column:
    """``CAST(column AS date) operator value`` as a range on the column."""
    return unit_compare(column, "day", operator, value)


def zoned_bounds(unit: str, value: datetime, zone: str) -> tuple[Column, Column]:
    """First and one-past-last instants of a unit in a time zone, as timestamps with time zone.

    Bounds are made from local wall time, so days of 23 and 25 hours come out whole.
    """
    start = truncated(unit, value)
    return tuple(F.to_utc_timestamp(F.lit(x.isoformat(sep=" ")).cast("timestamp"), zone) for x in (start, following(unit, start)))
