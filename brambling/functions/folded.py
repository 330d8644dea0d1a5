"""Full-text search over folded text: a document as one string, searched bytewise.

``fold`` lower-cases a text and writes each word between two blanks of its own, so that a word, a
prefix and a phrase are substrings, and a word's occurrences are what its removal shortens.  These
are compiled tests of one string; nothing is built for each word as in a token array.  Folded texts
have the words of configuration ``simple``, all with weight D.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SEPARATORS, And, Not, Or, Phrase, Query, Term, matches as token_matches, parse_query

#: Most ways to read a phrase with alternatives that are spelled out.
ALTERNATIVES = 64


def fold(text: Column) -> Column:
    """``"  first  second  "``; a text without words is four blanks."""
    return F.concat(F.lit("  "), F.btrim(F.regexp_replace(F.lower(text), SEPARATORS, "  ")), F.lit("  "))


def with_folded(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the folded text as another column.

    A generator makes it, so that filters on it stay above: pushed down, they would fold a text again
    for every word.
    """
    return df.select("*", F.inline(F.array(F.struct(fold(text).alias(name)))))


def tokens(folded: Column) -> Column:
    """The same document as an array of tokens."""
    words = F.filter(F.split(F.btrim(folded), "  "), lambda w: w != "")
    return F.transform(words, lambda w, i: F.struct(w.alias("lex"), (i + 1).alias("pos"), F.lit("D").alias("w")))


def length(folded: Column) -> Column:
    """Number of words."""
    blanks = F.octet_length(folded) - F.octet_length(F.replace(folded, F.lit(" "), F.lit("")))
    return F.when(F.octet_length(folded) == 4, 0).otherwise((blanks / 2).cast("int") - 1)


def _spelled(term: Term) -> str:
    return f" {term.lexeme}" if term.prefix else f" {term.lexeme} "


def holds(folded: Column, word: str) -> Column:
    return F.contains(folded, F.lit(f" {word} "))


def occurrences(folded: Column, word: str) -> Column:
    """How often a word stands in the document."""
    size = len(word.encode()) + 2
    return ((F.octet_length(folded) - F.octet_length(F.replace(folded, F.lit(f" {word} "), F.lit("")))) / size).cast("int")


def _never(term: Term) -> bool:
    return bool(term.weights) and "D" not in term.weights


def _readings(query: Query) -> list[list[tuple[int, Term]]] | None:
    """Rows of words with the distance of each from the one before; None where they don't tell all."""
    if isinstance(query, Term):
        return [] if _never(query) else [[(0, query)]]
    if isinstance(query, (Phrase, Or)):
        left, right = _readings(query.left), _readings(query.right)
        if left is None or right is None:
            return None
        if isinstance(query, Or):
            widths = {sum(d for d, _ in r) for r in left + right}
            # Alternatives of different widths are aligned at their beginnings.
            return left + right if len(widths) < 2 else None
        if len(left) * len(right) > ALTERNATIVES or query.distance < 1:
            return None
        return [a + [(query.distance, b[0][1])] + b[1:] for a, b in product(left, right)]
    return None


def _row_test(folded: Column, row: list[tuple[int, Term]]) -> Column:
    """A phrase of words at fixed distances: one substring where they are neighbours, else a pattern."""
    words = [t for _, t in row]
    if all(d == 1 for d, _ in row[1:]) and not any(t.prefix for t in words[:-1]):
        return F.contains(folded, F.lit(" " + "  ".join(t.lexeme for t in words) + ("" if words[-1].prefix else " ")))
    word = "[^ ]++  "
    pattern = " " + re.escape(words[0].lexeme) + ("[^ ]*+" if words[0].prefix else "") + "  "
    for distance, t in row[1:]:
        pattern += f"(?:{word}){{{distance - 1}}}" * (distance > 1) + re.escape(t.lexeme) + ("[^ ]*+" if t.prefix else "") + "  "
    test = F.rlike(folded, F.lit(pattern))
    for t in words:
        test = F.contains(folded, F.lit(_spelled(t))) & test
    return test


def _needed(query: Query) -> list[Term]:
    """Words without which a query can't hold."""
    if isinstance(query, Term):
        return [query]
    if isinstance(query, (And, Phrase)):
        return _needed(query.left) + _needed(query.right)
    return []


def matches(folded: Column, query: str | Query) -> Column:
    """``matches`` of the document's tokens; NULL gives NULL, an empty query matches nothing."""
    parsed = parse_query(query) if isinstance(query, str) else query

    def truth(q: Query) -> Column:
        if isinstance(q, Term):
            return F.lit(False) if _never(q) else F.contains(folded, F.lit(_spelled(q)))
        if isinstance(q, Not):
            return ~truth(q.part)
        if isinstance(q, And):
            return truth(q.left) & truth(q.right)
        if isinstance(q, Or):
            return truth(q.left) | truth(q.right)
        rows = _readings(q)
        if rows is None:
            # Only documents with all words that the phrase needs are cut into tokens.
            test = F.lit(True)
            for t in _needed(q):
                test = test & truth(t)
            return F.when(test, token_matches(tokens(folded), q)).otherwise(False)
        test = F.lit(False)
        for row in rows:
            test = test | _row_test(folded, row)
        return test

    return F.when(folded.isNotNull(), F.lit(False) if parsed is None else truth(parsed))


def matches_any(folded: Column, queries: list[str]) -> Column:
    """``matches`` of any of the queries."""
    test = F.when(folded.isNotNull(), F.lit(False))
    for q in queries:
        test = test | matches(folded, q)
    return test
