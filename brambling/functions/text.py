"""Full-text search: tokens with positions and weights, and queries compiled to expressions.

A document's tokens are an array of structs (``lex``, ``pos``, ``w``), one for each occurrence;
a stripped document has one for each lexeme, without a position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text in order (configuration ``simple``)."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def vector(text: Column, weight: str = "D") -> Column:
    """The tokens of a text, with positions from 1."""
    return F.transform(words(text), lambda w, i: F.struct(w.alias("lex"), (i + 1).alias("pos"), F.lit(weight).alias("w")))


def set_weight(tokens: Column, weight: str) -> Column:
    if weight not in "ABCD" or len(weight) != 1:
        raise ValueError(f"unknown weight: {weight}")
    return F.transform(tokens, lambda t: F.struct(t["lex"].alias("lex"), t["pos"].alias("pos"), F.lit(weight).alias("w")))


def strip(tokens: Column) -> Column:
    """One token for each lexeme, without position and weight."""
    return F.transform(lexemes(tokens), lambda x: F.struct(x.alias("lex"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("w")))


def joined(a: Column, b: Column) -> Column:
    """``a || b``: the positions of ``b`` follow the last of ``a``."""
    last = F.coalesce(F.array_max(F.transform(a, lambda t: t["pos"])), F.lit(0))

    def moved(by: Column) -> Column:
        return F.transform(b, lambda t: F.struct(t["lex"].alias("lex"), (t["pos"] + by).alias("pos"), t["w"].alias("w")))

    # An array of one binds the last position, which the inner lambda would compute for each token.
    return F.concat(a, F.get(F.transform(F.array(last), moved), 0))


def spelled(tokens: Column) -> Column:
    """The lexemes of all tokens, one for each occurrence."""
    return tokens.getField("lex")


def lexemes(tokens: Column) -> Column:
    return F.array_distinct(spelled(tokens))


def length(tokens: Column) -> Column:
    """Number of tokens."""
    return F.size(tokens)


def holds(tokens: Column, word: str) -> Column:
    return F.array_contains(spelled(tokens), word)


def occurrences(tokens: Column, word: str) -> Column:
    return F.size(spelled(tokens)) - F.size(F.array_remove(spelled(tokens), word))


@dataclass(frozen=True)
class Term:
    lexeme: str
    prefix: bool = False
    weights: str = ""


@dataclass(frozen=True)
class Not:
    part: Query


@dataclass(frozen=True)
class And:
    left: Query
    right: Query


@dataclass(frozen=True)
class Or:
    left: Query
    right: Query


@dataclass(frozen=True)
class Phrase:
    left: Query
    right: Query
    distance: int


Query = Term | Not | And | Or | Phrase
_PIECE = re.compile(r"\s*(?:(?P<op>[()&|!]|<->|<\d+>)|(?:'(?P<quoted>(?:[^']|'')*)'|(?P<word>[\w-]+))(?P<flags>:[*A-Da-d]+)?)")


def parse_query(text: str) -> Query | None:
    """A query: ``!`` binds most, then ``<->``, ``&`` and ``|``; words of ``simple`` are lower-cased."""
    pieces, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            raise ValueError(f"query can't be read at: {text[at:]}")
        pieces.append(m)
        at = m.end()
    if not pieces:
        return None
    place = 0

    def sign() -> str | None:
        return pieces[place]["op"] if place < len(pieces) else None

    def operand() -> Query:
        nonlocal place
        if place >= len(pieces):
            raise ValueError(f"query ends early: {text}")
        m = pieces[place]
        place += 1
        if m["op"] == "!":
            return Not(operand())
        if m["op"] == "(":
            inner = either()
            if sign() != ")":
                raise ValueError(f"query lacks a bracket: {text}")
            place += 1
            return inner
        if m["op"]:
            raise ValueError(f"query has {m['op']} out of place: {text}")
        flags = (m["flags"] or "").upper()
        parts = [p for p in re.split(r"[^\w]+", (m["word"] if m["quoted"] is None else m["quoted"]).replace("''", "'").lower()) if p]
        if not parts:
            raise ValueError(f"query has an empty word: {text}")
        terms = [Term(p, "*" in flags, "".join(sorted(set(flags) & set("ABCD")))) for p in parts]
        return reduce(lambda a, b: Phrase(a, b, 1), terms)

    def chain(next_level, accepts, make) -> Query:
        nonlocal place
        node = next_level()
        while (s := sign()) and accepts(s):
            place += 1
            node = make(node, next_level(), s)
        return node

    def phrase() -> Query:
        return chain(operand, lambda s: s[0] == "<", lambda a, b, s: Phrase(a, b, 1 if s == "<->" else int(s[1:-1])))

    def both() -> Query:
        return chain(phrase, lambda s: s == "&", lambda a, b, s: And(a, b))

    def either() -> Query:
        return chain(both, lambda s: s == "|", lambda a, b, s: Or(a, b))

    out = either()
    if place != len(pieces):
        raise ValueError(f"query has more than can be read: {text}")
    return out


def _is(t: Column, term: Term) -> Column:
    same = t["lex"].startswith(term.lexeme) if term.prefix else t["lex"] == term.lexeme
    # A token without a weight can't show that it has the wrong one only if weights aren't asked for.
    return same & F.coalesce(t["w"].isin(list(term.weights)), F.lit(False)) if term.weights else same


def _moved(positions: Column, n: Column | int) -> Column:
    return positions if isinstance(n, int) and n == 0 else F.transform(positions, lambda p: p + n)


def _found(positions: Column) -> Column:
    return F.size(positions) > 0


@dataclass(frozen=True)
class _Places:
    """Where a part of a phrase ends (``negated``: everywhere else), and how far before that it begins."""

    ends: Column
    width: Column | int
    negated: bool = False


def _wider(a: Column | int, b: Column | int) -> Column | int:
    if isinstance(a, int) and isinstance(b, int):
        return max(a, b)
    return F.greatest(*[F.lit(x) if isinstance(x, int) else x for x in (a, b)])


def _both(left: Column, right: Column, l_not: bool, r_not: bool) -> tuple[Column, bool]:
    """Places of both parts; (places, whether they are those left out)."""
    if l_not and r_not:
        return F.array_union(left, right), True
    if l_not:
        return F.array_except(right, left), False
    return (F.array_except(left, right) if r_not else F.array_intersect(left, right)), False


def _places(tokens: Column, query: Query) -> _Places:
    """Parts of a phrase: words end where they stand, both sides of AND and OR begin together."""
    if isinstance(query, Term):
        hits = F.filter(tokens, lambda t: _is(t, query) & t["pos"].isNotNull())
        return _Places(F.array_distinct(F.transform(hits, lambda t: t["pos"])), 0)
    if isinstance(query, Not):
        part = _places(tokens, query.part)
        fixed = isinstance(part.width, int) and part.width == 0
        return _Places(part.ends, part.width if fixed else F.when(_found(part.ends), part.width).otherwise(0), not part.negated)
    left, right = _places(tokens, query.left), _places(tokens, query.right)
    if isinstance(query, Phrase):
        behind = query.distance + right.width
        ends, negated = _both(_moved(left.ends, behind), right.ends, left.negated, right.negated)
        return _Places(ends, behind + left.width, negated)
    widths = [left.width, right.width]
    if isinstance(query, Or):
        # A part that isn't found has no width.
        widths = [w if p.negated or (isinstance(w, int) and w == 0) else F.when(_found(p.ends), w).otherwise(0) for p, w in zip((left, right), widths)]
    most = _wider(*widths)
    a, b = (_moved(p.ends, most - w) for p, w in zip((left, right), widths))
    if isinstance(query, And):
        ends, negated = _both(a, b, left.negated, right.negated)
        return _Places(ends, most, negated)
    # a OR b is NOT (NOT a AND NOT b).
    ends, negated = (F.array_union(a, b), True) if not (left.negated or right.negated) else _both(a, b, not left.negated, not right.negated)
    return _Places(ends, most, not negated)


def matches(tokens: Column, query: str | Query) -> Column:
    """``tokens @@ query``; NULL tokens give NULL, an empty query matches nothing."""
    parsed = parse_query(query) if isinstance(query, str) else query

    def truth(q: Query) -> Column:
        if isinstance(q, Term):
            # A plain word needs no lambda: the compiled search of an array does.
            return F.exists(tokens, lambda t: _is(t, q)) if q.prefix or q.weights else holds(tokens, q.lexeme)
        if isinstance(q, Not):
            return ~truth(q.part)
        if isinstance(q, And):
            return truth(q.left) & truth(q.right)
        if isinstance(q, Or):
            return truth(q.left) | truth(q.right)
        places = _places(tokens, q)
        return F.lit(True) if places.negated else _found(places.ends)

    return F.when(tokens.isNotNull(), F.lit(False) if parsed is None else truth(parsed))


def matches_any(tokens: Column, queries: list[str]) -> Column:
    """``tokens @@ ANY(queries)``."""
    return reduce(lambda a, b: a | b, (matches(tokens, q) for q in queries), F.when(tokens.isNotNull(), F.lit(False)))


def scoring_terms(query: str | Query) -> list[str]:
    """Distinct lexemes that count for a rank: those not under NOT; a prefix can't be ranked."""
    parsed = parse_query(query) if isinstance(query, str) else query
    out: dict[str, None] = {}

    def walk(q: Query | None) -> None:
        if isinstance(q, Term):
            if q.prefix:
                raise ValueError(f"a prefix can't be ranked: {q.lexeme}:*")
            out[q.lexeme] = None
        elif isinstance(q, (And, Or, Phrase)):
            walk(q.left)
            walk(q.right)

    walk(parsed)
    return list(out)
