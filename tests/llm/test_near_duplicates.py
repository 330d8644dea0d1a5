"""Near-duplicates against brute force: components, hot groups, edges; and the sketch's own promises."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from brambling.llm import hyperminhash as h
from brambling.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, set size, component, kept) of every row, from all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (a, x) in enumerate(sets):
        for b, y in sets[:p]:
            if a is None or b is None or not x or not y:
                continue
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def result(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(words: list[str], r: random.Random, n: int) -> str:
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.random()
        if kind < 0.4:
            words[at] = f"new{r.randrange(10**6)}"
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, f"add{r.randrange(10**6)}")
    return " ".join(words)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_edited_copies(spark, k, percent):
    """Groups of many near copies around the threshold, chains of edits, shared passages, tiny texts."""
    r = random.Random(k)
    rows: list[str] = []
    for size, copies in ((90, 120), (40, 60), (300, 30), (14, 40)):
        base = [f"b{size}x{i}" for i in range(size)]
        rows += [edited(base, r, r.choice([0, 1, 2, 3, size // 12, size // 6])) for _ in range(copies)]
    chain = [f"c{i}" for i in range(80)]
    for _ in range(30):
        chain = edited(chain, r, 1).split()
        rows.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [f"{passage} " + " ".join(f"q{r.randrange(10**6)}" for _ in range(n)) for n in (3, 10, 14, 20, 60) * 8]
    rows += [" ".join(r.choice("ab") for _ in range(n)) for n in range(1, 9) for _ in range(6)]
    r.shuffle(rows)
    data = list(enumerate(rows))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert result(h.near_duplicates(df, k, percent)) == brute(data, k, percent)


def test_query_tables(documents):
    data = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert result(h.near_duplicates(documents, 3, 85)) == brute(data, 3, 85)


def test_edges(edges, nothing):
    data = [(r["doc_id"], r["text"]) for r in edges.collect()]
    assert result(h.near_duplicates(edges, 3, 85)) == brute(data, 3, 85)
    assert h.near_duplicates(nothing).count() == 0
    kept = h.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, 6, 8, None], key=repr)
    assert h.keep_one(nothing).count() == 0


def test_hot_group_of_one_row(spark):
    """A third of all rows are one row, another third one text under different ids."""
    text = " ".join(f"w{i}" for i in range(40))
    data = [(7, text)] * 200 + [(1000 + i, text) for i in range(200)] + [(5000 + i, f"own{i} " * 3 + f"z{i}") for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert result(h.near_duplicates(df, 3, 85)) == sorted([(7, 38, 7, True)] * 200 + [(1000 + i, 38, 7, False) for i in range(200)] + [(5000 + i, 2, 5000 + i, True) for i in range(100)], key=repr)


def test_keep_one_keeps_one(documents):
    judged = {r["doc_id"]: r["kept"] for r in h.near_duplicates(documents).collect()}
    assert {r["doc_id"] for r in h.keep_one(documents).collect()} == {d for d, k in judged.items() if k}


def test_shingle_hashes_match_sets():
    texts = ["a b c d", "A B C D", "a  b\tc\nd", "a b", "a", "", " ", "\xa0a b c", "a b c a b c", "É É É"]
    for k in (1, 3, 5):
        sets = shingle_sets(texts, k)
        plain = [shingles(t, k) for t in texts]
        assert [len(s) for s in sets] == [len(p) for p in plain]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j])


def hashed(r, n: int) -> np.ndarray:
    return np.unique(r.randint(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))


@pytest.mark.parametrize("n", [40, 300, 3000, 100_000])
@pytest.mark.parametrize("similarity", [0.0, 0.5, 0.85])
def test_estimates(n, similarity):
    r = np.random.RandomState(n)
    errors = []
    for _ in range(12):
        shared = round(n * similarity)
        own = (n - shared) // 2
        common, a, b = hashed(r, shared), hashed(r, own), hashed(r, own)
        x, y = np.union1d(common, a), np.union1d(common, b)
        p, q = h.registers([x, y])
        estimate, used = h.estimate(p, q, len(x), len(y))
        errors.append(estimate - len(common) / len(np.union1d(x, y)))
        assert used <= h.BUCKETS
    assert abs(np.mean(errors)) < 0.03


def test_registers_keep_smallest_hashes():
    r = np.random.RandomState(0)
    x = hashed(r, 5000)
    row = h.registers([x])[0]
    for bucket in range(0, h.BUCKETS, 37):
        mine = [int(v) & ((1 << 55) - 1) for v in x if int(v) >> 55 == bucket]
        if not mine:
            assert row[bucket] == 0
            continue
        bits = f"{min(mine):055b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert row[bucket] == (zeros + 1) << 10 | int(bits[zeros + 1 : zeros + 11].ljust(10, "0"), 2)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_bands_meet_at_the_threshold(percent):
    r = np.random.RandomState(percent)
    missed = 0
    for n in (7, 12, 40, 400, 4000) * 20:
        union = n
        shared = -(-percent * union // 100)
        if shared == union:
            continue
        common, a, b = hashed(r, shared), hashed(r, (union - shared) // 2), hashed(r, union - shared - (union - shared) // 2)
        keys = h.band_keys(h.registers([np.union1d(common, a), np.union1d(common, b)]), h.bands_for(percent))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (600, 600)], "a long, b long")
    got = {r["id"]: r["component"] for r in h.components(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


@pytest.mark.parametrize("twice", [False, True])
def test_keys_cut_into_parts(spark, monkeypatch, twice):
    """Copies, near copies, blank texts and null ids beyond the rows that one task takes of a key."""
    monkeypatch.setattr(h, "KEY_ROWS", 3)
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base)] * 11 + [edited(base, r, 1 + i % 4) for i in range(40)] + [None, "", " "] * 4
    r.shuffle(texts)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts, 1)]
    if twice:
        rows.append((2, "a text of its own that the id has besides the other one"))
    found = result(h.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70))
    expected = brute(rows[:-1] if twice else rows, 3, 70)
    if twice:
        # Another text of an id is a node, and a component, of its own.
        expected = sorted([*expected, (2, len(shingles(rows[-1][1], 3)), 2, True)], key=repr)
    assert found == expected
