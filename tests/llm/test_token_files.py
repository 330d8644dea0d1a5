"""Token files: order, digests, encodings and selective reads."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from brambling.llm import token_files as t
from brambling.llm.tokens import vocabulary_path


def brute(docs) -> list[tuple]:
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    start, out = 0, []
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(documents, encoding):
    got = t.token_round_trip(documents, encoding=encoding, n_files=3)
    assert sorted(map(tuple, got.collect())) == brute(documents)


def test_edges(edges, nothing):
    got = sorted(map(tuple, t.token_round_trip(edges, n_files=4).collect()), key=lambda r: r[1])
    assert got == brute(edges)
    assert t.token_round_trip(nothing).count() == 0


def test_files(spark, documents, tmp_path):
    """Files are in ascending order, pages are indexed, encodings are those asked for."""
    for encoding, expected in (("dictionary", "DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = tmp_path / encoding
        t.write_token_files(documents, str(path), encoding=encoding, n_files=2)
        last = -1
        for file in sorted(Path(path).glob("part-*.parquet")):
            data = pq.ParquetFile(file)
            ids = data.read(["doc_id"]).column(0).to_pylist()
            assert ids == sorted(ids) and (not ids or ids[0] > last)
            last = ids[-1] if ids else last
            for g in range(data.metadata.num_row_groups):
                group = data.metadata.row_group(g)
                column = next(group.column(i) for i in range(group.num_columns) if "ids" in group.column(i).path_in_schema)
                assert any(expected in e for e in column.encodings)
                assert column.has_offset_index and group.column(0).has_column_index
    narrow = spark.read.parquet(str(tmp_path / "delta")).select("doc_id", "n_tokens").filter("doc_id = 5")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,5)" in plan


def test_unknown_encoding(documents):
    with pytest.raises(ValueError):
        t.write_token_files(documents, "unused", encoding="plain")


def test_hot_id(spark):
    """One doc_id with most rows is cut between files; order within it is kept stable."""
    df = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(20)], "doc_id long, text string")
    got = sorted(map(tuple, t.token_round_trip(df, n_files=4).collect()), key=lambda r: r[1])
    assert sum(r[2] for r in got) == got[-1][1] + got[-1][2]
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
