"""Functions against plain Python on small fixtures with NULLs and edges."""

from __future__ import annotations

import itertools
import json
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brambling.functions import arrays, days, distance, documents, folded, predicates, text
from brambling.plans.ranges import range_filter

from .conftest import rows

ARRAYS = [None, [], [None], ["a"], ["a", None], ["a", "a"], ["b", "a"], ["a", "b", "c"], [None, None, "b"]]


def holds(df, test) -> list:
    return [r[0] for r in df.orderBy("id").select(test).collect()]


@pytest.fixture(scope="module")
def tagged(spark):
    return spark.createDataFrame(list(enumerate(ARRAYS)), "id int, a array<string>")


def known(f):
    return [None if x is None else f(x) for x in ARRAYS]


@pytest.mark.parametrize("values", [[], ["a"], ["a", "b"], ["a", None], ["z"], ["a", "a"]])
def test_array_predicates(tagged, values):
    a, real = F.col("a"), {v for v in values if v is not None}
    assert holds(tagged, arrays.contains_all(a, values)) == known(lambda x: None not in values and set(values) <= set(x))
    assert holds(tagged, arrays.overlaps(a, values)) == known(lambda x: bool(real & set(x)))
    assert holds(tagged, arrays.contained_by(a, values)) == known(lambda x: all(v in real for v in x))
    assert holds(tagged, arrays.same_array(a, values)) == known(lambda x: x == values)


def test_array_emptiness(tagged):
    a = F.col("a")
    assert holds(tagged, arrays.non_empty(a)) == known(lambda x: len(x) > 0)
    assert holds(tagged, arrays.is_empty(a)) == known(lambda x: not x)
    assert holds(tagged, arrays.distinct_from_empty(a)) == [x is None or len(x) > 0 for x in ARRAYS]
    assert holds(tagged, arrays.empty_or_null(a)) == [not x for x in ARRAYS]
    assert holds(tagged, arrays.any_equals(a, "a")) == known(lambda x: True if "a" in x else None if None in x else False)
    assert [None if k is None else set(k) for k in holds(tagged, arrays.keys_of(a))] == known(lambda x: set(x) - {None})


def test_lists_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(60)], "id int, v int")
    v = F.col("v")
    assert df.filter(predicates.among(v, [1, None])).count() == sum(i % 5 != 0 and i % 7 == 1 for i in range(60))
    assert df.filter(predicates.not_among(v, [1, None])).count() == 0
    assert df.filter(predicates.not_among(v, [1])).count() == sum(i % 5 != 0 and i % 7 != 1 for i in range(60))
    assert df.filter(predicates.distinct_from(v, 1)).count() == sum(i % 5 == 0 or i % 7 != 1 for i in range(60))
    long = [1, 3, None, *range(100, 2000)]
    assert predicates.filter_in(df, "v", long).count() == sum(i % 5 != 0 and i % 7 in (1, 3) for i in range(60))
    assert predicates.filter_in(df, "v", long, negate=True).count() == 0
    assert predicates.filter_in(df, "v", long[3:] + [1], negate=True).count() == sum(i % 5 != 0 and i % 7 != 1 for i in range(60))
    assert predicates.filter_in(df, "v", []).count() == 0


@pytest.mark.parametrize("clause", ["rand() > 0.5", "id IN (SELECT 1)", "zz = 1", "sum(id) > 1", "id + 1 = 2"])
def test_text_filters_are_restricted(spark, clause):
    with pytest.raises(ValueError):
        predicates.set_filter(spark.range(3), clause)


@pytest.mark.parametrize("clause", ["id IN (1, 2) OR id IS NULL", "NOT (id BETWEEN 1 AND 2)", "id <=> 1 AND id < 5", None, " "])
def test_text_filters_that_are_allowed(spark, clause):
    assert predicates.set_filter(spark.range(3), clause).count() <= 3


MOMENTS = [datetime(2024, 1, 1), datetime(2023, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29, 12, 30, 15, 123456), datetime(2020, 1, 1), datetime(2001, 1, 1), datetime(2000, 12, 31, 7), datetime(1999, 3, 3, 3, 3, 3)]
PLAIN = ["millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year"]


def test_unit_ranges_equal_truncation(spark):
    """Range form against date_trunc itself for all units, signs and edge moments."""
    near = [m + timedelta(microseconds=k) for m in MOMENTS for k in (-1, 0, 1)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate([*near, None])], "id int, ts timestamp_ntz")
    signs = {"=": "=", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
    pairs = []
    for unit, sign, at in itertools.product(PLAIN, signs, MOMENTS[:5]):
        plain = F.expr(f"cast(date_trunc('{unit}', ts) as timestamp_ntz) {sign} timestamp_ntz'{at.isoformat(sep=' ')}'")
        pairs.append(plain.eqNullSafe(days.unit_compare(F.col("ts"), unit, sign, at)))
    for part in range(0, len(pairs), 60):
        assert all(all(r) for r in df.select(*[p.alias(f"c{i}") for i, p in enumerate(pairs[part : part + 60])]).collect())


def test_long_units():
    assert days.truncated("decade", datetime(2029, 5, 5)) == datetime(2020, 1, 1)
    assert days.truncated("century", datetime(2000, 5, 5)) == datetime(1901, 1, 1)
    assert days.truncated("millennium", datetime(2001, 1, 1)) == datetime(2001, 1, 1)
    assert days.following("century", datetime(1901, 1, 1)) == datetime(2001, 1, 1)
    with pytest.raises(ValueError):
        days.truncated("fortnight", datetime(2000, 1, 1))


def test_unit_columns_equal_literals(spark):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(MOMENTS)], "id int, ts timestamp_ntz")
    for unit in days.UNITS:
        got = df.orderBy("id").select(days.unit_start(unit, F.col("ts")), days.first_reaching(unit, F.col("ts")), days.last_within(unit, F.col("ts"))).collect()
        assert [tuple(r) for r in got] == [(days.truncated(unit, m), days.unit_first(unit, m), days.unit_last(unit, m)) for m in MOMENTS], unit


def test_range_filter_reaches_the_scan(spark, small_dir):
    df = range_filter(spark.read.parquet(f"{small_dir}/events.parquet"), "timestamp '2024-01-10' <= date_trunc('day', ts)", "event_type = 'click'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(event_typ" in plan


def test_zoned_days(spark):
    """A day of 23 hours when clocks go forward."""
    first, end = days.zoned_bounds("day", datetime(2024, 3, 31), "Europe/Berlin")
    row = spark.range(1).select((end.cast("long") - first.cast("long")).alias("s")).first()
    assert row["s"] == 23 * 3600


def test_day_bounds(spark):
    df = spark.createDataFrame([(date(2024, 2, 29),), (None,)], "d date")
    got = rows(df.select(days.day_first(F.col("d")), days.day_last(F.col("d"))))
    assert (datetime(2024, 2, 29), datetime(2024, 2, 29, 23, 59, 59, 999999)) in got and (None, None) in got


def test_distances(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "id int, v array<float>")
    q = distance.vector([0.0, 1.0])
    assert holds(df, distance.l2(F.col("v"), q)) == [pytest.approx(18**0.5), 1.0, None]
    assert holds(df, distance.negative_inner_product(F.col("v"), q)) == [-4.0, 0.0, None]
    cosine = holds(df, distance.cosine(F.col("v"), q))
    assert cosine[0] == pytest.approx(0.2) and cosine[1] != cosine[1] and cosine[2] is None


# JSON.

DOCS = [None, "{}", "[]", "1", '"k"', "null", '{"k": 1}', '{"k": 1.0, "j": {"a": [1, "x", null, true]}}', '["k", 1, {"k": "v"}]', '{"k": "1"}', '{"j": {"a": 1, "b": 2}}', '{"j": [{"a": 1}, {"b": 2}]}', '[[1]]']


def json_contains(a, b, top=True) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and json_contains(a[k], v, False) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(json_contains(x, y, False) for x in a) for y in b)
    same = lambda x: type(x) in (int, float) and type(b) in (int, float) and x == b or type(x) is type(b) and x == b
    return same(a) or top and isinstance(a, list) and any(same(x) for x in a)


@pytest.mark.parametrize("query", [{}, [], 1, "k", None, True, {"k": 1}, {"k": "1"}, {"j": {"a": [1]}}, {"j": {"a": ["x", None]}}, ["k"], [1], [{"k": "v"}], {"j": {"a": 1, "b": 2}}, {"j": [{"a": 1, "b": 2}]}, {"j": [{"b": 2}, {"a": 1}]}, [[1]]], ids=json.dumps)
def test_json_containment(spark, query):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, d string")
    assert holds(df, documents.contains(F.col("d"), query)) == [None if d is None else json_contains(json.loads(d), query) for d in DOCS]


def test_json_keys(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, d string")

    def has(d, k):
        x = json.loads(d)
        return k in x if isinstance(x, dict) else k in [e for e in x if isinstance(e, str)] if isinstance(x, list) else x == k

    assert holds(df, documents.has_key(F.col("d"), "k")) == [None if d is None else has(d, "k") for d in DOCS]
    assert holds(df, documents.has_any_key(F.col("d"), ["k", None, "j"])) == [None if d is None else has(d, "k") or has(d, "j") for d in DOCS]
    assert holds(df, documents.has_all_keys(F.col("d"), ["k", None, "j"])) == [None if d is None else has(d, "k") and has(d, "j") for d in DOCS]
    assert holds(df, documents.has_all_keys(F.col("d"), [])) == [None if d is None else True for d in DOCS]


def test_json_canonical(spark):
    same = ['{"b": 1.0, "a": [1,2]}', '{"a":[1, 2.00],"b":1}']
    df = spark.createDataFrame(list(enumerate(same)), "id int, d string")
    assert len(set(holds(df, documents.canonical(F.col("d"))))) == 1


PATHS = {
    "$.k == 1": lambda x: isinstance(x, dict) and type(x.get("k")) in (int, float) and x["k"] == 1,
    'exists($.j.a)': lambda x: isinstance(x, dict) and any("a" in e for e in (x.get("j") if isinstance(x.get("j"), list) else [x.get("j")]) if isinstance(e, dict)),
    "$.type() == \"array\"": lambda x: isinstance(x, list),
}


@pytest.mark.parametrize("path", sorted(PATHS))
def test_json_paths(spark, path):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, d string")
    got = holds(df, documents.path_match(F.col("d"), path))
    assert [bool(g) for g in got] == [d is not None and bool(PATHS[path](json.loads(d))) for d in DOCS]


def test_json_path_finds(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, d string")
    assert holds(df, documents.path_exists(F.col("d"), '$.j.a[*] ? (@ == "x")'))[7] is True
    assert holds(df, documents.path_exists(F.col("d"), "$.j[1].b"))[11] is True
    assert holds(df, documents.path_exists(F.col("d"), '$.** ? (@ == "v")'))[8] is True
    for bad in ("$.k === 1", "strict $.k", "$.k.keyvalue()", "$.k ? (@ > 1", "$[last]", ""):
        with pytest.raises(ValueError):
            documents.path_match(F.col("d"), bad)


# Text.

VOCABULARY = [f"w{i}" for i in range(6)]


def naive(q, tokens) -> bool:
    """A query's truth over (word, position, weight), by its definition."""

    def is_(t, term):
        return (t[0].startswith(term.lexeme) if term.prefix else t[0] == term.lexeme) and (not term.weights or t[2] in term.weights)

    everywhere = set(range(-40, 80))

    def spans(q) -> tuple[set, int]:
        """Where a part begins, of all places there are, and its width (0 if it isn't found)."""
        if isinstance(q, text.Term):
            return {t[1] for t in tokens if is_(t, q)}, 0
        if isinstance(q, text.Not):
            starts, width = spans(q.part)
            return {p - width for p in everywhere - {s + width for s in starts}}, width
        (left, lw), (right, rw) = spans(q.left), spans(q.right)
        if isinstance(q, text.Or):
            return left | right, max(lw, rw)
        if isinstance(q, text.And):
            return left & right, max(lw, rw)
        starts = {p for p in left if p + lw + q.distance in right}
        return starts, lw + q.distance + rw if starts else 0

    if isinstance(q, text.Term):
        return any(is_(t, q) for t in tokens)
    if isinstance(q, text.Not):
        return not naive(q.part, tokens)
    if isinstance(q, text.And):
        return naive(q.left, tokens) and naive(q.right, tokens)
    if isinstance(q, text.Or):
        return naive(q.left, tokens) or naive(q.right, tokens)
    return bool(spans(q)[0])


def random_query(r, depth: int, positional: bool = False) -> str:
    if depth == 0 or r.random() < 0.3:
        w = r.choice([*VOCABULARY, "absent"])
        return w + r.choice(["", "", ":*", ":A", ":BD"]) if not positional else w
    kind = r.choice(["&", "|", "<->", "<2>"]) if not positional else r.choice(["|", "&", "<->", "<->", "<2>"])
    inside = positional or kind[0] == "<"
    part = f"({random_query(r, depth - 1, inside)} {kind} {random_query(r, depth - 1, inside)})"
    return f"!{part}" if r.random() < 0.2 else part


def test_text_fuzz(spark):
    r = random.Random(7)
    docs = []
    for i in range(120):
        n = r.choice([0, 1, 3, 8, 13])
        docs.append([(r.choice(VOCABULARY), p + 1, r.choice("ABCD")) for p in range(n)])
    df = spark.createDataFrame(list(enumerate([*docs, None])), "id int, tok array<struct<lex:string,pos:int,w:string>>")
    queries = [random_query(r, 3) for _ in range(40)]
    got = df.orderBy("id").select(*[text.matches(F.col("tok"), q).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    for i, q in enumerate(queries):
        parsed = text.parse_query(q)
        assert [row[i] for row in got[:-1]] == [naive(parsed, d) for d in docs], q
        assert got[-1][i] is None


def test_folded_fuzz(spark):
    """Folded texts give what their tokens give, for words, prefixes, weights, phrases and negations."""
    r = random.Random(11)
    seen = [*VOCABULARY, "w1x", "é", "日本"]
    docs = [r.choice(["", " ", "-- "]) + r.choice([" ", ", ", "\n\t"]).join(r.choice(seen).upper() for _ in range(r.choice([0, 1, 3, 8, 13]))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate([*docs, None])), "id int, t string").select("id", "t", text.vector(F.col("t")).alias("tok"), folded.fold(F.col("t")).alias("f")).cache()
    queries = [random_query(r, 3) for _ in range(14)] + ["w1 <-> w2", "w1 <3> w2", "w0 <2> (w1 | w3) <-> w2", "w1:* <-> w2", "w1 <-> w2:*", "w1:D <-> w2:A", "é | 日本", "", "!w1 <-> !w2", "w0 <0> w0", "(w1 | w2 <-> !w3) <-> w4"]
    for part in (queries[:14], queries[14:]):
        both = df.orderBy("id").select(*[F.struct(text.matches(F.col("tok"), q), folded.matches(F.col("f"), q)) for q in part]).collect()
        for i, q in enumerate(part):
            assert [x[i][0] for x in both] == [x[i][1] for x in both], q
    facts = df.select(F.struct(F.size("tok"), folded.length(F.col("f"))), *[F.struct(text.occurrences(F.col("tok"), w), folded.occurrences(F.col("f"), w)) for w in seen])
    assert all(a == b for row in facts.collect() for a, b in row)
    assert holds(df, folded.matches_any(F.col("f"), ["w1", "w2 & w3"])) == holds(df, text.matches_any(F.col("tok"), ["w1", "w2 & w3"]))
    assert holds(df, folded.tokens(F.col("f"))) == holds(df, F.col("tok"))


def test_phrase_parts_begin_together(spark):
    """Right operands of phrases are placed by their beginnings, alternatives too."""
    for t, q, want in (
        ("a b c", "a <-> (b <-> c)", True), ("a c b", "a <-> (b <-> c)", False), ("a b c d", "(a <-> b) <2> d", True), ("x q", "(x | y <-> !z) <-> q", True),
        ("x y q", "(x | y <-> !z) <-> q", True), ("x y q y", "!x <-> y", True), ("x y q y", "!x <-> !y", True), ("x y q y", "!x <-> !!y", True),
        ("x y q y", "!(x <-> y)", False), ("x y q y", "!(x <-> !y)", True),
    ):
        df = spark.createDataFrame([(0, t)], "id int, t string").select("id", text.vector(F.col("t")).alias("tok"), folded.fold(F.col("t")).alias("f"))
        assert holds(df, text.matches(F.col("tok"), q)) == holds(df, folded.matches(F.col("f"), q)) == [want], q


def test_text_functions(spark):
    df = spark.createDataFrame([(0, "The cat, the HAT"), (1, ""), (2, None)], "id int, t string")
    tok = text.vector(F.col("t"))
    assert holds(df, text.words(F.col("t"))) == [["the", "cat", "the", "hat"], [], None]
    assert [None if x is None else sorted(x) for x in holds(df, text.lexemes(tok))] == [["cat", "hat", "the"], [], None]
    both = text.joined(text.set_weight(tok, "A"), tok)
    assert holds(df, text.matches(both, "hat:A <-> the:D")) == [True, False, None]
    assert holds(df, text.matches(text.strip(tok), "the <-> cat")) == [False, False, None]
    assert holds(df, text.matches(tok, "")) == [False, False, None]
    assert holds(df, text.matches(tok, "!the <-> hat")) == [False, False, None]
    assert holds(df, text.matches(tok, "cat <-> !hat")) == [True, False, None]


@pytest.mark.parametrize("bad", ["a &", "(a", "a b", "& a", "a <- b", "''"])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        text.parse_query(bad)


def test_ranks_need_whole_words():
    assert text.scoring_terms("a & (b | !c) & 'd e'") == ["a", "b", "d", "e"]
    with pytest.raises(ValueError):
        text.scoring_terms("a:*")


def test_separators_match_duckdb_and_java():
    assert [w for w in re.split(r"[^\w]+", "a-b") if w] == ["a", "b"]
