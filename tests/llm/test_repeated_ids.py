"""Near-duplicates where a doc_id repeats with different texts."""

from __future__ import annotations

import random

from .test_near_duplicates import edited, h, result, shingles


def by_text(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, set size, component, kept) of every row: texts are linked, a component is its smallest id."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    different = sorted({s for _, s in sets if s}, key=repr)
    parent = list(range(len(different)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, x in enumerate(different):
        for q, y in enumerate(different[:p]):
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                parent[find(p)] = find(q)
    root = {s: find(p) for p, s in enumerate(different)}
    name: dict = {}
    for i, s in sets:
        if i is not None and s:
            name[root[s]] = min(i, name.get(root[s], i))
    found = [(i, len(s), None if i is None else name[root[s]] if s else i) for i, s in sets]
    return sorted(((i, n, c, i is None or i == c) for i, n, c in found), key=repr)


def test_one_text_is_a_copy(spark):
    """Id 5 is the first with text A, and repeats text B of id 1; A has copies and a near copy."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = " ".join([*a[:-1], "other"])
    data = [(1, " ".join(b)), (5, " ".join(a)), (5, " ".join(b)), *[(i, " ".join(a)) for i in range(6, 20)], (30, near), (31, near + " more")]
    got = result(h.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85))
    assert got == by_text(data, 3, 85)
    assert [c for i, _, c, _ in got if i in (30, 31)] == [5, 5]


def test_many_repeated_ids(spark):
    """Ids drawn with repetition over near copies, exact copies, empty texts, null ids and repeated rows."""
    r = random.Random(8)
    texts: list = ["", None]
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(70)]
        texts += [edited(base, r, r.choice([0, 0, 1, 2, 4, 9])) for _ in range(12)]
    data = [(r.choice([None, *range(60)]), r.choice(texts)) for _ in range(260)]
    data += data[:20]
    assert result(h.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85)) == by_text(data, 3, 85)
