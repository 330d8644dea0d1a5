"""Byte-pair merges of many short words at once.

All words' symbols lie in one array.  In each turn every word merges all places of its lowest-ranked
pair (from the left where they overlap), which is the order in which one word alone is merged, so the
ids are those of merging word by word.  A word needs as many turns as it has different merges: long
words belong to a merge queue, as the ``tokenizers`` library has.
"""

from __future__ import annotations

import numpy as np

_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE gives to each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class Merges:
    """The merge table of a byte-level BPE vocabulary whose words end in ``suffix``."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        alphabet = byte_alphabet()
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order.astype(np.int32)
        everything = np.arange(256)
        self.first = [self._ranks(self.inner[everything[:, None]], table[everything[None, :]]) for table in (self.inner, self.final)]

    @classmethod
    def of(cls, spec: dict) -> Merges | None:
        """The table of a tokenizer file, or None if its model isn't of this kind."""
        model = spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        suffix = model.get("end_of_word_suffix") or ""
        whole = all(c + end in model["vocab"] for c in byte_alphabet() for end in ("", suffix))
        return cls(model["vocab"], model["merges"], suffix) if model.get("type") == "BPE" and plain and whole else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank among the merges, or ``_NONE``."""
        wanted = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.order[at], _NONE).astype(np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of the words ``data[offsets[i]:offsets[i + 1]]``, none empty."""
        sizes = np.diff(offsets)
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        symbol = self.inner[data]
        last = offsets[1:] - 1
        symbol[last] = self.final[data[last]]
        rank = np.full(len(data), _NONE, np.int32)
        rank[:-1] = self.first[0][data[:-1], data[1:]]
        ends = last[sizes > 1]
        rank[ends - 1] = self.first[1][data[ends - 1], data[ends]]
        rank[last] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            over = lowest == _NONE
            if over.any():
                out = np.repeat(over, sizes)
                done.append((word[out], symbol[out]))
                word, symbol, rank = word[~out], symbol[~out], rank[~out]
                lowest, sizes = lowest[~over], sizes[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            adjacent = np.append(False, hit[1:] == hit[:-1] + 1)
            if adjacent.any():  # runs such as aaa: every other place of a run
                begin = np.maximum.accumulate(np.where(adjacent, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            kept = np.ones(len(symbol), bool)
            kept[hit + 1] = False
            word, symbol, rank = word[kept], symbol[kept], rank[kept]
            at = hit - np.arange(len(hit))
            behind = at + 1 < len(symbol)
            rank[at] = _NONE
            right = at[behind]
            right = right[word[right] == word[right + 1]]
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            for places in (right, left):
                rank[places] = self._ranks(symbol[places], symbol[places + 1])
        words = np.concatenate([np.zeros(0, np.int32), *(w for w, _ in done)])
        symbols = np.concatenate([np.zeros(0, np.int32), *(s for _, s in done)])
        order = np.argsort(words, kind="stable")
        return symbols[order].astype(np.uint32), np.bincount(words, minlength=len(offsets) - 1).astype(np.int64)
