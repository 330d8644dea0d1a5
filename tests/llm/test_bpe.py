"""Chunk reuse: ids and decoded texts equal those of the library on any text."""

from __future__ import annotations

import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from brambling.llm import chunk_bpe as c
from brambling.llm.tokens import _UNKNOWN, LATIN, LIBRARY, WIDE, Encoder, vocabulary_path

from .conftest import LONG, odd_texts


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(vocabulary_path())
    made.no_truncation()
    made.no_padding()
    return made


def ids_of(library, texts):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_fuzz(library):
    texts = odd_texts(300, 11) + [LONG, "x" * 5000, "ab" * 3000 + " c", "é" * 2000, "1" * 900, "a\n" * 999]
    for encode in (Encoder(vocabulary_path()).encode, c.ChunkEncoder(vocabulary_path()).encode):
        ids, at = encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids_of(library, texts)


def test_every_known_character(library):
    """Classes, lower case and contractions of all characters that tables describe."""
    encoder = Encoder(vocabulary_path())
    points = np.flatnonzero(encoder.points[0] != _UNKNOWN).tolist()
    assert len(points) > 50_000
    texts = [f"a{chr(p)}b 1{chr(p)}2 '{chr(p)}s x's{chr(p)}" for p in points]
    ids, at = encoder.encode(texts)
    assert [p for p, a, b, want in zip(points, at[:-1], at[1:], library.encode_batch_fast(texts, add_special_tokens=False)) if ids[a:b].tolist() != want.ids] == []


def test_scripts_marks_and_contractions(library):
    r = random.Random(5)
    known = "abcdstvmrelABC 'éßÀαβΣςжЖ中文字한글אבمرحबाहिन्दी' \n\t0123٣४.,!?“”’—😀…\u00a0\u2003e\u0301\u200b𝒜İſ"
    texts = ["".join(r.choice(known) for _ in range(r.randrange(80))) for _ in range(4000)]
    texts += ["it's they'll WE'VE i'm he'd don't 'tis ''s \"'s 's' a'sb 'llama 're've 'l 'r '", "Ελλάδα Σίσυφος", "naïve café", "<|endoftext|> don’t", "\ud7a3\u1100\u1161"]
    for encode in (Encoder(vocabulary_path()).encode, c.ChunkEncoder(vocabulary_path()).encode):
        ids, at = encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids_of(library, texts)
    kinds = [Encoder.of(vocabulary_path()).kind(t) for t in ("don't", "Здравствуй 世界 “x” 😀", "e\u0301", "<|endoftext|>")]
    assert kinds == [LATIN, WIDE, LIBRARY, LIBRARY]


def test_merges_of_repeated_letters(library):
    words = ["a" * n for n in range(1, 60)] + ["abab" * n for n in range(1, 20)] + ["hahahahah", "lll", "x" * 47, "x" * 48, "x" * 49]
    ids, at = Encoder(vocabulary_path()).encode([" ".join(words)])
    assert ids.tolist() == ids_of(library, [" ".join(words)])[0]


def test_other_files_go_to_the_library(tmp_path, library):
    spec = json.loads(Path(vocabulary_path()).read_text())
    spec["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    encoder = Encoder(str(other))
    assert encoder.kind("plain") == LIBRARY
    assert encoder.encode(["a\u00a0B", ""])[0].tolist() == Tokenizer.from_file(str(other)).encode("a\u00a0B", add_special_tokens=False).ids


def test_chunks_are_reused(library):
    r = random.Random(1)
    passages = [" ".join(f"w{r.randrange(9999)}" for _ in range(1500)) for _ in range(4)]
    texts = [f"own{i} " + " ".join(r.sample(passages, 3)) for i in range(30)]
    encoder = c.ChunkEncoder(vocabulary_path())
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == ids_of(library, texts)
    assert encoder.reused > 8 * encoder.made


def test_chunks_depend_on_content():
    body = bytes(random.Random(2).choices(b"abcdefgh ", k=40_000))
    a, b = set(c.split_chunks(body)), set(c.split_chunks(b"inserted in front" + body))
    assert len(a & b) >= len(a) - 2 and b"".join(c.split_chunks(body)) == body
    assert c.split_chunks(b"") == []


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(c, "CACHE_IDS", 2000)
    encoder = c.ChunkEncoder(vocabulary_path())
    for i in range(20):
        encoder.encode([" ".join(f"w{i}x{k}" for k in range(400))])
    assert encoder.held < 20_000


def test_decoding(library):
    texts = odd_texts(60, 4)
    encoder = c.ChunkEncoder(vocabulary_path())
    ids, at = encoder.encode(texts)
    assert encoder.decode(ids, at).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in ids_of(library, texts)]


def test_query(library, spark, edges, nothing, documents):
    made = spark.createDataFrame(list(enumerate(odd_texts(80, 9))), "doc_id long, text string")
    for docs in (edges, documents, made):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted(map(tuple, c.encode_decode(docs).collect()), key=repr) == sorted(want, key=repr)
    assert c.encode_decode(nothing).count() == 0
    assert c.encode_ids(edges).filter("size(ids) = 0").count() == 3
