"""Rewrite of date filters in SQL text: ``date_trunc`` and casts to date become ranges."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.days import UNITS, unit_compare

_TIME = r"(?:date|timestamp|timestamp_ntz)?\s*'(?P<at>\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d:\d\d(?:\.\d{1,6})?)?)'"
_TRUNC = r"date_trunc\(\s*'(?P<unit>\w+)'\s*,\s*(?P<column>\w+)\s*\)"
_CAST = r"(?:cast\(\s*(?P<day>\w+)\s+as\s+date\s*\)|(?P<day2>\w+)::date)"
_SIGN = r"(?P<sign><=|>=|<>|!=|=|<|>)"
_CLAUSE = re.compile(rf"^\s*(?:{_TRUNC}|{_CAST})\s*{_SIGN}\s*{_TIME}\s*$", re.I)
_MIRRORED = re.compile(rf"^\s*{_TIME}\s*{_SIGN}\s*(?:{_TRUNC}|{_CAST})\s*$", re.I)
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def range_filter(df: DataFrame, *clauses: str) -> DataFrame:
    """Rows of all clauses; a clause that compares a truncated column is turned into a range.

    Other clauses are kept as they are.
    """
    for clause in clauses:
        m = _CLAUSE.match(clause)
        flipped = None if m else _MIRRORED.match(clause)
        found = m or flipped
        if not found:
            df = df.filter(clause)
            continue
        unit = (found["unit"] or "day").lower()
        if unit not in UNITS:
            raise ValueError(f"unknown unit: {unit}")
        sign = "<>" if found["sign"] == "!=" else found["sign"]
        sign = _FLIP.get(sign, sign) if flipped else sign
        column = found["column"] or found["day"] or found["day2"]
        df = df.filter(unit_compare(F.col(column), unit, sign, datetime.fromisoformat(found["at"])))
    return df
