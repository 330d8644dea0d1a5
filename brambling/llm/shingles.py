"""Word shingles as 64-bit hashes, a slice of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, bounds): text i has hashes[bounds[i]:bounds[i + 1]].

    A-Z are lower-cased; words are runs of anything but blank, tab, line feed, vertical tab, form
    feed and carriage return.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    data = np.frombuffer(b" ".join([*encoded, b""]).translate(_LOWER), np.uint8)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    before = np.cumsum(first)
    ends = np.cumsum(sizes + 1)
    bounds = np.concatenate([[0], before[ends - 1]]).astype(np.int64) if len(ends) else np.zeros(1, np.int64)
    compact = data[inside]
    offsets = np.append(np.flatnonzero(first[inside]), len(compact)).astype(np.int32)
    if len(offsets) < 2:
        return np.zeros(0, np.uint64), bounds
    words = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(compact)]).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64)
    return known[words.indices.to_numpy(zero_copy_only=False)], bounds


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    A text with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    words, bounds = word_hashes(texts)
    rolled = words.copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            rolled = mixed(rolled[: len(words) - k] * _U64(3) + words[k:]) if len(words) > k else rolled[:0]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                whole = _U64(b - a)
                for w in words[a:b]:
                    whole = mixed(whole * _U64(3) + w)
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
