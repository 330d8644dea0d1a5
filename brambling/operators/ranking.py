"""BM25 ranking of token columns and of text columns (configuration ``simple``)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import folded, text

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Statistics:
    """Corpus figures of a query: documents with a lexeme, their mean length, and each term's documents."""

    documents: int
    mean_length: float
    frequencies: dict[str, int]


def _read(df: DataFrame, column: Column) -> tuple[DataFrame, Column, object]:
    """The table with the column to search, and the functions that read it: texts are folded once for each row."""
    if not isinstance(df.select(column).schema[0].dataType, StringType):
        return df, column, text
    return folded.with_folded(df, column, "folded_"), F.col("folded_"), folded


def statistics(df: DataFrame, tokens: Column, query: str) -> Statistics:
    """One pass of partial aggregates; one row comes back."""
    terms = text.scoring_terms(query)
    df, column, reader = _read(df.select(tokens.alias("searched_")), F.col("searched_"))
    each = df.select(F.inline(F.array(F.struct(reader.length(column).alias("n"), *[reader.holds(column, w).alias(f"h{i}") for i, w in enumerate(terms)]))))
    row = each.agg(
        F.count_if(F.col("n") > 0).alias("documents"),
        F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean"),
        *[F.count_if(F.col(f"h{i}")).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    return Statistics(row["documents"], row["mean"] or 1.0, {w: row[f"df{i}"] for i, w in enumerate(terms)})


def formula(known: Statistics, length: Column, counts: Mapping[str, Column], k1: float, b: float) -> Column:
    share = length / F.lit(known.mean_length)
    total = F.lit(0.0)
    for word, df in known.frequencies.items():
        tf = counts[word].cast("double")
        idf = F.log(1 + (F.lit(float(known.documents)) - df + 0.5) / (F.lit(float(df)) + 0.5))
        total = total + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * share))).otherwise(0.0)
    return total


def score(tokens: Column, known: Statistics, k1: float = K1, b: float = B) -> Column:
    """The document's score; 0 where no term occurs, NULL for NULL tokens."""
    counts = {w: text.occurrences(tokens, w) for w in known.frequencies}
    return F.when(tokens.isNotNull(), formula(known, text.length(tokens), counts, k1, b))


def text_score(document: Column, known: Statistics, k1: float = K1, b: float = B) -> Column:
    """``score`` of a text column."""
    whole = folded.fold(document)
    counts = {w: folded.occurrences(whole, w) for w in known.frequencies}
    return F.when(document.isNotNull(), formula(known, folded.length(whole), counts, k1, b))


def _may_hold(column: Column, terms: list[str]) -> Column:
    """Texts with the letters of a term somewhere; others needn't be folded."""
    low, test = F.lower(column), F.lit(False)
    for w in terms:
        test = test | F.contains(low, F.lit(w))
    return test


def bm25(
    df: DataFrame, key: str, tokens: Column, query: str | None, k: int | None, k1: float = K1, b: float = B,
    match: bool = False, condition: Column | None = None, known: Statistics | None = None,
) -> DataFrame:
    """``key, score``: the ``k`` best documents that hold a term (``match``: that satisfy the query).

    ``tokens`` is a token array or a text.  Figures are those of the whole table; ``condition`` only
    restricts what is returned, and reaches the scan.  A NULL query or ``k`` gives no rows.  Callers that
    ask again may keep the query's ``statistics`` and pass them as ``known``: documents without a term
    are then dropped by a search of their bytes.
    """
    if query is None or k is None:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    known = known or statistics(df, tokens, query)
    terms = list(known.frequencies)
    narrow = (df if condition is None else df.filter(condition)).select(F.col(key), tokens.alias("searched_"))
    if not match and isinstance(narrow.schema["searched_"].dataType, StringType):
        narrow = narrow.filter(_may_hold(F.col("searched_"), terms))
    rows, column, reader = _read(narrow, F.col("searched_"))
    facts = F.struct(
        F.col(key),
        reader.length(column).alias("length_"),
        *[reader.occurrences(column, w).alias(f"tf{i}_") for i, w in enumerate(terms)],
        (reader.matches(column, query) if match else F.lit(True)).alias("match_"),
    )
    # A generator keeps the filter above it: pushed down, it would read each document again for every term.
    counted = rows.select(F.inline(F.array(facts)))
    held = counted.filter("match_" if match else F.lit(False) if not terms else F.greatest(F.lit(0), *[F.col(f"tf{i}_") for i in range(len(terms))]) > 0)
    value = formula(known, F.col("length_"), {w: F.col(f"tf{i}_") for i, w in enumerate(terms)}, k1, b)
    return held.select(key, value.alias("score")).orderBy(F.desc("score"), key).limit(k)
