"""Packing: the placement rule by brute force, and whole sequences against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from brambling.llm import packing as p
from brambling.llm.tokens import vocabulary_path


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 100) for _ in range(r.choice([0, 1, 2, 17, 300]))]
    free: list[int] = []
    want = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = b, 100 - free[b]
        free[b] -= sizes[i]
    assert p.first_fit_decreasing(sizes, 100) == want


def check(docs, packed, capacity: int) -> None:
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    streams = [(r["doc_id"], np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")) for r in docs.select("doc_id", "text").collect()]
    rows = packed.collect()
    got = sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=repr)
    want = []
    for doc, ids in streams:
        starts = sorted({r["start"] for r in rows if r["doc_id"] == doc and r["doc_tokens"] == len(ids)})
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            want.append((doc, a, b - a, zlib.crc32(ids[a:b]), len(ids)))
    assert got == sorted(want, key=repr)
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in streams)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_documents(documents):
    packed = p.pack(documents).cache()
    check(documents, packed, 2048)
    facts = p.padding(packed).first()
    assert facts["n_padding"] <= 0.02 * facts["n_ids"] + 2048


def test_small_sequences_and_groups(documents):
    packed = p.pack(documents, capacity=64, group_pieces=50).cache()
    check(documents, packed, 64)
    assert packed.select("sequence_id").distinct().count() > 10


def test_edges(edges, nothing):
    check(edges, p.pack(edges), 2048)
    assert p.pack(nothing).count() == 0
    assert p.padding(p.pack(nothing)).first()["n_sequences"] == 0


def test_copies_spread_over_groups(spark):
    """Rows that are all alike still go to all groups."""
    df = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    groups = {r["sequence_id"] >> 32 for r in p.pack(df, group_pieces=50).collect()}
    assert len(groups) == 8


def test_repeatable(documents):
    assert sorted(map(tuple, p.pack(documents).collect())) == sorted(map(tuple, p.pack(documents).collect()))
