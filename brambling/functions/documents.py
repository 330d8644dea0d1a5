"""JSON documents kept as strings: containment, keys, fields, canonical form, path predicates, facet keys."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from decimal import Decimal
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def field_equals(doc: Column, key: str, value: str) -> Column:
    """``(doc->>'key') = value``."""
    return F.get_json_object(doc, path_of(key)) == value


def field_as(doc: Column, key: str, kind: str) -> Column:
    """``(doc->>'key')::kind``."""
    return F.get_json_object(doc, path_of(key)).cast(kind)


def path_of(*keys: str) -> str:
    """A path of object keys, quoted."""
    return "$" + "".join(f"['{k}']" for k in keys)


def _variant(doc: Column) -> Column:
    return F.try_parse_json(doc)


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _member(v: Column, key: str) -> Column:
    if '"' in key or "\\" in key:
        raise ValueError(f"key can't be addressed: {key}")
    return F.variant_get(v, f'$["{key}"]', "variant")


def _scalar(v: Column, value) -> Column:
    if value is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    if isinstance(value, bool):
        return F.coalesce((_type(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((_type(v) == "STRING") & (F.try_variant_get(v, "$", "string") == value), F.lit(False))
    number = F.coalesce(_type(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    text = format(Decimal(str(value)), "f")
    exact = F.try_variant_get(v, "$", "decimal(38,9)") == F.lit(text).try_cast("decimal(38,9)")
    return number & F.coalesce(exact, F.try_variant_get(v, "$", "double") == F.lit(float(value)), F.lit(False))


def _any_contains(elements: Column, query) -> Column:
    return F.coalesce(F.exists(elements, lambda e: _contains(e, query, False)), F.lit(False))


def _contains(v: Column, query, top: bool) -> Column:
    kind = F.coalesce(_type(v), F.lit(""))
    if isinstance(query, dict):
        parts = [_contains(_member(v, k), q, False) for k, q in query.items()]
        return reduce(lambda a, b: a & b, parts, kind.startswith("OBJECT"))
    elements = F.try_variant_get(v, "$", "array<variant>")
    if isinstance(query, list):
        parts = [_any_contains(elements, q) for q in query]
        return reduce(lambda a, b: a & b, parts, kind.startswith("ARRAY"))
    own = _scalar(v, query)
    # At the top only, an array contains a scalar that is one of its elements.
    return own | F.coalesce(F.exists(elements, lambda e: _scalar(e, query)), F.lit(False)) if top else own


def contains(doc: Column, query: dict | list | str | float | bool | None) -> Column:
    """``doc @> query``: objects contain objects key by key, arrays contain arrays element by element.

    Numbers are equal by value, strings by bytes.  NULL where the document is.
    """
    return F.when(doc.isNotNull(), _contains(_variant(doc), query, True))


def has_key(doc: Column, key: str) -> Column:
    """``doc ? key``: a top-level key, a string element of an array, or the string itself."""
    v = _variant(doc)
    keys = F.array_contains(F.json_object_keys(doc), key)
    element = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda e: _scalar(e, key))
    return F.when(doc.isNotNull(), F.coalesce(keys, F.lit(False)) | F.coalesce(element, F.lit(False)) | _scalar(v, key))


def has_any_key(doc: Column, keys: Sequence[str | None]) -> Column:
    """``doc ?| keys``; NULLs among the keys are skipped."""
    return reduce(lambda a, b: a | b, (has_key(doc, k) for k in keys if k is not None), F.when(doc.isNotNull(), F.lit(False)))


def has_all_keys(doc: Column, keys: Sequence[str | None]) -> Column:
    """``doc ?& keys``; an empty list holds for every document."""
    return reduce(lambda a, b: a & b, (has_key(doc, k) for k in keys if k is not None), F.when(doc.isNotNull(), F.lit(True)))


def canonical(doc: Column) -> Column:
    """One spelling for equal documents: sorted keys, normal numbers, no white space."""
    return F.to_json(_variant(doc))


# Path predicates: a small lax-mode evaluator, run on Arrow batches.

_TOKEN = re.compile(
    r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<op>\*\*|&&|\|\||==|<>|!=|<=|>=|[()\[\].$@?<>!*,:])|(?P<word>[A-Za-z_]\w*))"""
)


_METHODS = ("type", "size", "abs", "floor", "ceiling", "double")


class PathError(ValueError):
    """A path that can't be read."""


class _Reader:
    """Recursive descent over ``[lax] expression``; nodes are tuples."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"path is not supported at: {text[at:]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise PathError(f"path lacks {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def either(self):
        node = self.both()
        while self.peek("||"):
            self.take("||")
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.unary()
        while self.peek("&&"):
            self.take("&&")
            node = ("and", node, self.unary())
        return node

    def unary(self):
        if self.peek("!"):
            self.take("!")
            return ("not", self.unary())
        if self.peek("exists"):
            self.take("exists")
            self.take("(")
            inner = self.operand()
            self.take(")")
            return ("exists", inner)
        if self.peek("("):
            start = self.at
            self.take("(")
            try:
                node = self.either()
                self.take(")")
                if not self.peek("==", "<>", "!=", "<", "<=", ">", ">=", ".", "["):
                    return node
            except PathError:
                pass
            self.at = start
        left = self.operand()
        if self.peek("==", "<>", "!=", "<", "<=", ">", ">="):
            sign = self.take("==", "<>", "!=", "<", "<=", ">", ">=")
            return ("cmp", "<>" if sign == "!=" else sign, left, self.operand())
        if self.peek("starts"):
            self.take("starts")
            self.take("with")
            return ("starts", left, self.operand())
        if self.peek("like_regex"):
            self.take("like_regex")
            return ("regex", left, self.operand())
        return left

    def operand(self):
        if self.at >= len(self.tokens):
            raise PathError("path ends early")
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return ("value", json.loads(value))
        if kind == "num":
            self.at += 1
            return ("value", json.loads(value))
        if value in ("true", "false", "null"):
            self.at += 1
            return ("value", json.loads(value))
        if value == "(":
            self.take("(")
            node = self.operand()
            self.take(")")
            return self.steps(node)
        return self.steps(("root",) if self.take("$", "@") == "$" else ("this",))

    def steps(self, node):
        while True:
            if self.peek("."):
                self.take(".")
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                self.at += 1
                if value == "**":
                    node = ("all", node)
                elif value == "*" and kind == "op":
                    node = ("values", node)
                elif kind == "word" and self.peek("("):
                    if value not in _METHODS:
                        raise PathError(f"method is not supported: {value}()")
                    self.take("(")
                    self.take(")")
                    node = ("method", value, node)
                elif kind in ("word", "str"):
                    node = ("key", json.loads(value) if kind == "str" else value, node)
                else:
                    raise PathError("path lacks a key")
            elif self.peek("["):
                self.take("[")
                if self.peek("*"):
                    self.take("*")
                    node = ("elements", node)
                else:
                    kind, value = self.tokens[self.at]
                    if kind != "num":
                        raise PathError("only numbers index an array")
                    self.at += 1
                    node = ("index", int(value), node)
                self.take("]")
            elif self.peek("?"):
                self.take("?")
                self.take("(")
                node = ("filter", node, self.either())
                self.take(")")
            else:
                return node


@lru_cache(256)
def _parsed(path: str):
    reader = _Reader(re.sub(r"^\s*lax\s+", "", path))
    node = reader.either()
    if reader.at != len(reader.tokens):
        raise PathError(f"path is not supported: {path}")
    return node


_PREDICATES = {"or", "and", "not", "exists", "cmp", "starts", "regex"}


def _kind(x) -> str:
    return {type(None): "null", bool: "boolean", str: "string", list: "array", dict: "object"}.get(type(x), "number")


def _unwrapped(items: Iterator) -> Iterator:
    for x in items:
        if isinstance(x, list):
            yield from x
        else:
            yield x


def _descend(x) -> Iterator:
    yield x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _descend(y)


def _items(node, root, this) -> Iterator:
    kind = node[0]
    if kind in ("root", "this"):
        yield root if kind == "root" else this
    elif kind == "value":
        yield node[1]
    elif kind == "key":
        for x in _unwrapped(_items(node[2], root, this)):
            if isinstance(x, dict) and node[1] in x:
                yield x[node[1]]
    elif kind == "values":
        for x in _unwrapped(_items(node[1], root, this)):
            if isinstance(x, dict):
                yield from x.values()
    elif kind == "elements":
        for x in _items(node[1], root, this):
            yield from x if isinstance(x, list) else [x]
    elif kind == "index":
        for x in _items(node[2], root, this):
            wrapped = x if isinstance(x, list) else [x]
            if -len(wrapped) <= node[1] < len(wrapped) and node[1] >= 0:
                yield wrapped[node[1]]
    elif kind == "all":
        for x in _items(node[1], root, this):
            yield from _descend(x)
    elif kind == "filter":
        for x in _unwrapped(_items(node[1], root, this)):
            if _truth(node[2], root, x) is True:
                yield x
    elif kind == "method":
        found = _items(node[2], root, this)
        for x in found if node[1] in ("type", "size") else _unwrapped(found):
            yield _method(node[1], x)
    else:
        yield _truth(node, root, this)


def _method(name: str, x):
    if name == "type":
        return _kind(x)
    if name == "size":
        return len(x) if isinstance(x, list) else 1
    if name in ("abs", "floor", "ceiling", "double") and (_kind(x) == "number" or name == "double" and isinstance(x, str)):
        return {"abs": abs, "floor": math.floor, "ceiling": math.ceil, "double": float}[name](x)
    raise PathError(f"method {name}() does not apply")


def _compare(sign: str, a, b) -> bool | None:
    if _kind(a) != _kind(b):
        return sign == "<>" if None in (a, b) else None
    if isinstance(a, (list, dict)):
        return None
    if a is None:
        return sign in ("==", "<=", ">=")
    return {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def _truth(node, root, this) -> bool | None:
    """Three-valued; None is unknown."""
    kind = node[0]
    if kind in ("and", "or"):
        a, b = _truth(node[1], root, this), _truth(node[2], root, this)
        decisive = kind == "or"
        return decisive if decisive in (a, b) else None if None in (a, b) else not decisive
    if kind == "not":
        inner = _truth(node[1], root, this)
        return None if inner is None else not inner
    if kind == "exists":
        return any(True for _ in _items(node[1], root, this))
    if kind in ("cmp", "starts", "regex"):
        left, right = node[-2], node[-1]
        found: bool | None = False
        for a in _unwrapped(_items(left, root, this)):
            for b in _unwrapped(_items(right, root, this)):
                if kind == "cmp":
                    one = _compare(node[1], a, b)
                elif not isinstance(a, str) or not isinstance(b, str):
                    one = None
                else:
                    one = a.startswith(b) if kind == "starts" else bool(re.search(b, a))
                if one:
                    return True
                found = None if one is None else found
        return found
    values = list(_items(node, root, this))
    return values[0] if len(values) == 1 and isinstance(values[0], bool) else None


def _judge(path: str, match: bool):
    """A function of one document: truth of the predicate, or whether the path finds anything."""
    node = _parsed(path)

    def judge(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            root = json.loads(text)
            if match:
                return _truth(node, root, root) if node[0] in _PREDICATES or node[0] == "value" else next((x if isinstance(x, bool) else None for x in _items(node, root, root)), None)
            return True if node[0] in _PREDICATES else any(True for _ in _items(node, root, root))
        except (PathError, json.JSONDecodeError):
            return None

    return judge


def _batched(doc: Column, path: str, match: bool) -> Column:
    _parsed(path)  # errors show where the query is made

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        judge = _judge(path, match)
        return pd.Series([judge(t) for t in texts], dtype=object)

    return run(doc)


def path_match(doc: Column, path: str) -> Column:
    """``doc @@ path``: the predicate's truth, NULL where it is unknown."""
    return _batched(doc, path, True)


def path_exists(doc: Column, path: str) -> Column:
    """``doc @? path``: whether the path finds anything."""
    return _batched(doc, path, False)


def _spelled(x, path: tuple[str, ...]) -> Iterator[str]:
    place = "$" + "".join(f".{json.dumps(k, ensure_ascii=False)}" for k in path)
    if isinstance(x, dict):
        if path:
            yield f'{place}.type() == "object"'
        for k, v in x.items():
            yield f"{place} ? {json.dumps(k, ensure_ascii=False)}" if path else f"? {json.dumps(k, ensure_ascii=False)}"
            yield from _spelled(v, (*path, k))
    elif isinstance(x, list):
        yield f'{place}.type() == "array"'
        for v in x:
            yield from _spelled(v, path)
    else:
        yield f"{place} == {json.dumps(x, ensure_ascii=False)}"


def facet_keys(doc: Column) -> Column:
    """Distinct keys of a document, spelled as path predicates, for facets."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else sorted(set(_spelled(json.loads(t), ()))))
            except json.JSONDecodeError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(doc)
