"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the last bytes puts chunk ends where the content says, so passages shared by
documents give the same chunks wherever they stand.  Each distinct chunk is encoded once while it
stays in a worker's bounded cache.  A join inside a word (neither side has white space there) is
repaired: the two part words are encoded again as one, and the word grows over further chunks until
its ends are white space, where the encodings of both sides agree with that of the whole text.

Defined results: null text is the empty text (no ids, empty decoded text); texts that only the
library splits (``tokens``: not in NFC, special tokens, characters newer than the tables) are encoded
whole by it; equal texts give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ENCODED_BYTES, map_texts, prepare, require
from .tokens import LIBRARY, Encoder, vocabulary_path

#: A chunk ends where this many low bits of the rolling hash are zero: 512 bytes on average.
MASK_BITS = 9
WINDOW = 16
#: Ids and bytes kept for chunks by a worker.
CACHE_IDS = 4_000_000
_SPACES = b" \t\n\x0b\x0c\r"
_GEAR = np.random.RandomState(7).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)

#: ids, ids before the first white space, ids behind the last, bytes before, bytes behind (None: no white space).
Chunk = tuple[np.ndarray, int, int, bytes, bytes]


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Places behind which a chunk ends; the same window of bytes always decides alike."""
    gear, rolled = _GEAR[data], np.zeros(len(data), np.uint32)
    for k in range(min(WINDOW, len(data))):
        rolled[k:] += gear[: len(data) - k] << np.uint32(k)
    # Continuation bytes of UTF-8 follow the end of no chunk.
    cut = (rolled >> np.uint32(32 - MASK_BITS)) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    return np.flatnonzero(cut) + 1


def split_chunks(text: bytes) -> list[bytes]:
    ends = chunk_ends(np.frombuffer(text, np.uint8)).tolist() if text else []
    bounds = [0, *ends]
    if bounds[-1] != len(text):
        bounds.append(len(text))
    return [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


class ChunkEncoder:
    """Encodes texts by their chunks; remembers chunks."""

    _loaded: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        self.words = Encoder.of(path)
        self.chunks: dict[bytes, Chunk] = {}
        self.held = 0
        self.reused = self.made = 0
        tokenizer = self.words.tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = pa.array([tokenizer.id_to_token(i) or "" for i in range(size)])

    def learn(self, fresh: list[bytes]) -> dict[bytes, Chunk]:
        """Encode chunks: each as its first part word, its middle and its last part word."""
        heads, bodies, tails = [], [], []
        for c in fresh:
            spaced = c.translate(bytes.maketrans(_SPACES, b" " * 6))
            first = spaced.find(b" ")
            if first < 0:
                heads.append(c.decode())
                bodies.append("")
                tails.append("")
                continue
            last = spaced.rfind(b" ")
            heads.append(c[:first].decode())
            bodies.append(c[first : last + 1].decode())
            tails.append(c[last + 1 :].decode())
        n = len(fresh)
        ids, at = self.words.encode([*heads, *bodies, *tails])
        out = {}
        for i, c in enumerate(fresh):
            h, b, t = (ids[at[j] : at[j + 1]] for j in (i, n + i, 2 * n + i))
            whole = np.concatenate([h, b, t])
            spaceless = len(heads[i].encode()) == len(c)
            out[c] = (whole, len(h), len(t), heads[i].encode(), None if spaceless else tails[i].encode())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        safe = [self.words.kind(t) != LIBRARY for t in texts]
        split = [split_chunks(t.encode()) if ok else [] for t, ok in zip(texts, safe)]
        wanted = {c for chunks in split for c in chunks}
        fresh = [c for c in wanted if c not in self.chunks]
        self.reused += sum(map(len, split)) - len(fresh)
        self.made += len(fresh)
        if self.held > CACHE_IDS:
            self.chunks = {c: v for c, v in self.chunks.items() if c in wanted}
            self.held = sum(len(v[0]) for v in self.chunks.values())
        learned = self.learn(fresh)
        self.held += sum(len(v[0]) for v in learned.values())
        self.chunks.update(learned)
        # Lay out every text: stretches of chunks' ids, and words to repair between them.
        layout: list[list[np.ndarray | int]] = []
        broken: list[str] = []
        for text, ok, chunks in zip(texts, safe, split):
            layout.append(self._lay(chunks, broken) if ok else [np.array(self.words.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)])
        ids, at = self.words.encode(broken)
        parts, sizes = [np.zeros(0, np.uint32)], []
        for pieces in layout:
            own = [ids[at[p] : at[p + 1]] if isinstance(p, int) else p for p in pieces]
            parts += own
            sizes.append(sum(map(len, own)))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)

    def _lay(self, chunks: list[bytes], broken: list[str]) -> list[np.ndarray | int]:
        out: list[np.ndarray | int] = []
        open_word: list[bytes] = []

        def close() -> None:
            if word := b"".join(open_word):
                out.append(len(broken))
                broken.append(word.decode())
            open_word.clear()

        last = len(chunks) - 1
        for i, c in enumerate(chunks):
            ids, n_head, n_tail, head, tail = self.chunks[c]
            if tail is None:  # no white space: the word goes on
                open_word.append(head)
                continue
            if open_word:
                open_word.append(head)
                close()
                ids = ids[n_head:]
            if tail and i < last and chunks[i + 1][:1] not in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
                ids = ids[: len(ids) - n_tail]
                open_word.append(tail)
            out.append(ids)
        close()
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """As the library decodes without a decoder: token strings joined by blanks."""
        strings = self.strings.take(pa.array(ids))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings)
        return pc.binary_join(lists, " ")


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _bytes_of(array: pa.Array) -> list[memoryview]:
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    data = memoryview(array.buffers()[2]) if array.buffers()[2] is not None else memoryview(b"")
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of every text's ids and of the text decoded from them."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = ChunkEncoder.of(vocabulary or vocabulary_path())
        ids, offsets = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
        little = memoryview(ids.astype("<u4")).cast("B")
        bounds = offsets.tolist()
        ids_sha = [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
        decoded = [hashlib.sha256(t).hexdigest() for t in _bytes_of(encoder.decode(ids, offsets))]
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(ids_sha), pa.array(decoded)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(require(docs, "doc_id", "text"), run, _SCHEMA, ENCODED_BYTES)


def encode_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and the list of ids of every text."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = ChunkEncoder.of(vocabulary or vocabulary_path()).encode([t or "" for t in batch.column("text").to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return map_texts(require(docs, "doc_id", "text"), run, "doc_id long, ids array<int>", ENCODED_BYTES)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return encode_decode(documents(spark, sf_dir))
