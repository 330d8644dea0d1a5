"""Secret scan by assignment-aware lexing.

Three base patterns (named assignments, access key ids, long hex runs) are always reported.  Around
every assignment sign a lexer reads ``name = expression`` in source, JSON, YAML, INI, shell and
environment syntax, with or without a type (``name: Type = expression``).  Expressions are string literals (with
prefixes and triple quotes), bare words, names and ``+`` joins, also over line ends; names propagate
the literals assigned to them earlier in the document.  A literal that reaches a sensitive
name is scored by that name and its own shape, and reported as kind ``literal`` at its place.

Defined results: null text is the empty text; no finding gives zero counts and an empty ``spans``;
equal texts give equal values; repeated rows and other columns are kept apart or ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, prepare, require

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A target name, its assignment sign, and where the expression begins.  A run of name characters is read once.
_TARGET = re.compile(r"""(?<![\w.$-])[\d.-]*+([A-Za-z_$][\w.$-]*+)(?:\[["']([\w.-]++)["']\])?["']?[^\S\n]*+(:=|=>|=|:)(?![=:/])[^\S\n]*+""", re.A)
#: A type between ``:`` and ``=``; without a blank before the sign it is a short word, as padded base64 isn't.
_TYPE = re.compile(r"""(?:&(?:'\w++[^\S\n]++)?)?[A-Za-z_$][\w.$]*+(?:\[[^\n=:;{}"'\]]*+\]|<[^\n=:;{}"'>]*+>)*+[?!]?(?:[^\S\n]*+\|[^\S\n]*+[A-Za-z_$][\w.$]*+)*+([^\S\n]*+)=(?![=:>~])[^\S\n]*+""", re.A)
_SHORT_TYPE = re.compile(r"[A-Za-z_$]{1,7}(?![\w.$])", re.A)
_PREFIX = re.compile(r"""(?:[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF]|u8|[bBfFrRuUL]|[@$]{1,2})?(?=["'`])""")
_STRING = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`""")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@$%^*-]+", re.A)
_NAME = re.compile(r"[A-Za-z_$][\w.$]*", re.A)
_OPEN = re.compile(r"(?:\(\s*+)*+")
_PLUS = re.compile(r"(?:\s|\\\n)*+(?:\+|\.\.)(?:\s|\\\n)*+")
_SIGN = re.compile(r"""["']?[^\S\n]*+(?::=|=>|=|:)(?![=:])""")
_SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Parts of names and their weight; a name's score is that of its best part or pair of parts.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "privatekey": 1.0, "accesskey": 0.9,
    "api key": 1.0, "access key": 0.9, "private key": 1.0, "secret key": 1.0, "signing key": 0.9, "encryption key": 0.9,
    "auth key": 0.9, "client secret": 1.0, "connection string": 0.8,
}
_FRAMED = re.compile(r"^(?:<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|none|null|true|false|undefined)$", re.I)
_PLACEHOLDER = re.compile("example|changeme|placeholder|your[_-]", re.I)
_FILLERS = ({"x", "X"}, {"*"})
#: Characters kept of a value's ends; no placeholder is longer.
_ENDS = 16
THRESHOLD = 1.3


class Value:
    """A literal, or values joined: its places, and what its score needs of its text.

    Joins share their parts, so values that grow by themselves take no more room than their source.
    """

    __slots__ = ("parts", "place", "size", "counts", "head", "tail", "placeholder")

    def __init__(self, text: str = "", place: tuple[int, int] | None = None):
        self.parts: tuple[Value, ...] = ()
        self.place, self.size, self.counts = place, len(text), dict(Counter(text))
        self.head, self.tail = text[:_ENDS], text[-_ENDS:]
        self.placeholder = bool(_PLACEHOLDER.search(text))

    @classmethod
    def joined(cls, parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = cls()
        out.parts = tuple(parts)
        out.counts = dict(parts[0].counts)
        for i, p in enumerate(parts):
            out.placeholder = out.placeholder or p.placeholder or bool(_PLACEHOLDER.search(out.tail + p.head))
            out.size += p.size
            out.head = (out.head + p.head)[:_ENDS]
            out.tail = (out.tail + p.tail)[-_ENDS:]
            for c, n in p.counts.items() if i else ():
                out.counts[c] = out.counts.get(c, 0) + n
        return out


def name_score(name: str) -> float:
    parts = [p.lower() for p in _SPLIT_NAME.findall(name)]
    pairs = [" ".join(p) for p in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *pairs)), default=0.0)


def literal_score(value: Value) -> float:
    """0 to 1: length, mixture of character classes and entropy a character."""
    chars = value.counts
    ends = value.head if value.size <= _ENDS else value.head + value.tail
    if value.size < 8 or value.placeholder or _FRAMED.match(ends) or any(chars.keys() <= f for f in _FILLERS) or any(c.isspace() for c in chars):
        return 0.0
    classes = sum(any(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit)) + (not all(c.isalnum() for c in chars))
    entropy = -sum(n / value.size * math.log2(n / value.size) for n in chars.values())
    return min(1.0, 0.15 * classes + 0.15 * entropy)


def _string(text: str, at: int, unclosed: set[str]) -> tuple[int, int, int] | None:
    """(start, end, place behind the closing quotes) of a string literal; triple quotes may span lines."""
    if not (m := _PREFIX.match(text, at)):
        return None
    mark = text[m.end() : m.end() + 3]
    if mark in ('"""', "'''") and mark not in unclosed:
        if (end := text.find(mark, m.end() + 3)) >= 0:
            return m.end() + 3, end, end + 3
        unclosed.add(mark)
    m = _STRING.match(text, m.end())
    return m and (m.start(m.lastindex), m.end(m.lastindex), m.end())


def _expression(text: str, at: int, known: dict[str, Value], unclosed: set[str]) -> Value | None:
    """The literals that an expression is made of, joined."""
    parts: list[Value] = []
    inner = _OPEN.match(text, at).end()
    opened, at, wrapped = inner > at, inner, False
    while True:
        if found := _string(text, at, unclosed):
            start, stop, end = found
            parts.append(Value(text[start:stop], (start, stop)))
        elif (m := _NAME.match(text, at)) and m[0] in known and not (wrapped and _SIGN.match(text, m.end())):
            parts.append(known[m[0]])
            end = m.end()
        elif not parts and not opened and (m := _BARE.match(text, at)):
            return Value(m[0], m.span())
        else:
            break
        if not (joint := _PLUS.match(text, end)):
            break
        at, wrapped = joint.end(), "\n" in joint[0]
    return Value.joined(parts) if parts else None


def _typed(text: str, at: int) -> int | None:
    """Where the value begins behind an annotation's type."""
    m = _TYPE.match(text, at)
    return m.end() if m and (m[1] or _SHORT_TYPE.match(text, at)) else None


def assignments(text: str) -> list[tuple[str, Value]]:
    """(name, literals that reach it), constants propagated in order."""
    known: dict[str, Value] = {}
    unclosed: set[str] = set()
    out = []
    at = 0
    while m := _TARGET.search(text, at):
        at, value = m.end(), None
        if m[3] == ":" and (behind := _typed(text, at)) and (value := _expression(text, behind, known, unclosed)):
            at = behind
        if value := value or _expression(text, at, known, unclosed):
            known[m[1]] = value
            out.append((m[2] or m[1], value))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns."""
    low = text.lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def literal_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if "=" not in text and ":" not in text:
        return []
    found = set()
    seen: set[Value] = set()
    for name, value in assignments(text):
        if (weight := name_score(name)) and weight + literal_score(value) >= THRESHOLD:
            reached = [value]
            while reached:
                if (v := reached.pop()) not in seen:
                    seen.add(v)
                    reached += v.parts
                    if v.place and v.size:
                        found.add((v.place[0], 3, v.place[1]))
    starts = sorted(base)
    return sorted(s for s in found if not any(a < s[2] and s[0] < b for a, _, b in starts))


def digest(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    spans = sorted(base + literal_spans(text, base))
    joined = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found) for found in (base, spans)]
    count = Counter(k for _, k, _ in base)
    return count[0], count[1], count[2], hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: counts, digest of the base spans, and all spans."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [digest(t or "") for t in batch.column("text").to_pylist()]
        assign, access, hexes, sha, spans = zip(*rows)
        literal = [s.count("literal:") for s in spans]
        long, string = pa.int64(), pa.string()
        columns = [pa.array(c, k) for c, k in ((assign, long), (access, long), (hexes, long), (sha, string), (spans, string), (literal, long))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return map_texts(require(docs, "doc_id", "text"), run, _SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return find_secrets(documents(spark, sf_dir))
