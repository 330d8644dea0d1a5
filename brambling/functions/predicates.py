"""Predicates with SQL's three-valued logic, and filters given as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest IN list that is kept as an expression; a longer one is joined.
LITERAL_LIST = 1000


def distinct_from(column: Column, value) -> Column:
    """``IS DISTINCT FROM``: rows with NULL are kept."""
    return ~column.eqNullSafe(value)


def not_distinct_from(column: Column, value) -> Column:
    return column.eqNullSafe(value)


def among(column: Column, values: Sequence) -> Column:
    """``IN``; a NULL in the list matches nothing."""
    return column.isin([v for v in values if v is not None])


def not_among(column: Column, values: Sequence) -> Column:
    """``NOT IN``; a NULL in the list leaves no row."""
    return F.lit(None).cast("boolean") if any(v is None for v in values) else ~column.isin(list(values))


def starts_with(column: Column, prefix: str) -> Column:
    """``LIKE 'prefix%'`` with the prefix taken literally; reaches Parquet as a pushed filter."""
    return column.startswith(prefix)


def filter_in(df: DataFrame, column: str, values: Sequence, negate: bool = False) -> DataFrame:
    """``column [NOT] IN values`` for a list of any length.

    Short lists are expressions; long ones become a table that is joined (semi or anti), broadcast
    by Spark itself while it is small.
    """
    if negate and any(v is None for v in values):
        return df.filter(F.lit(False))
    known = list(dict.fromkeys(v for v in values if v is not None))
    if len(known) <= LITERAL_LIST:
        c = F.col(column)
        return df.filter(~c.isin(known) if negate else c.isin(known))
    field = df.schema[column]
    keys = df.sparkSession.createDataFrame([(v,) for v in known], f"key {field.dataType.simpleString()}")
    rows = df.filter(F.col(column).isNotNull()) if negate else df
    return rows.join(keys, rows[column] == keys["key"], "left_anti" if negate else "left_semi")


#: What a filter given as text may consist of.
_NODES = {
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual",
    "In", "IsNull", "IsNotNull", "Like", "Between", "IsTrue", "Cast", "Literal", "UnresolvedAttribute", "UnaryMinus",
}
_FUNCTIONS = {"array_contains", "arrays_overlap", "size", "lower", "upper", "array", "between", "like", "startswith", "exists", "not", "get_json_object", "date"}


def set_filter(df: DataFrame, text: str | None) -> DataFrame:
    """Rows that a filter given as text admits; anything outside the allowed grammar is an error.

    Allowed are comparisons, lists, ranges, NULL and boolean tests, prefixes, array and JSON tests on
    the table's own columns, under AND, OR and NOT.
    """
    if text is None or not text.strip():
        return df
    parsed = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(text)
    columns = {c.lower() for c in df.columns}

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".").lower()
            if name not in _FUNCTIONS:
                raise ValueError(f"filter clause is not supported: {node.sql()}")
        elif kind == "UnresolvedAttribute":
            if node.name().replace("`", "").lower() not in columns:
                raise ValueError(f"filter names an unknown column: {node.sql()}")
        elif kind not in _NODES:
            raise ValueError(f"filter clause is not supported: {node.sql()}")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(parsed)
    return df.filter(F.expr(text))
