"""Exact, fast batch encoding with a public word-level BPE vocabulary.

The vocabulary's normaliser (NFC, white space, lower case) and splitter never let a token cross
white space or a change of character class, so the encoding of a text is the concatenation of the
encodings of its pieces.  Pieces are found with numpy, made distinct with Arrow, and merged together
(``merges``).  Three kinds of text, each with the ids of the ``tokenizers`` library:

* ASCII and precomposed Latin letters: pieces from classes of bytes;
* other text in NFC whose characters have kept their class since Unicode 3.2, or are neither letters,
  numbers nor marks: pieces from classes of code points;
* all else (text not in NFC, special tokens, newer scripts, vocabularies of another build): the
  library encodes the whole text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .merges import Merges, byte_alphabet

#: Pieces of more bytes go to the library's own merge queue, which long words need.
LONG_PIECE = 48
LATIN, WIDE, LIBRARY = range(3)
_NOT_LATIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įı-ſ]")
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
# The white space of Unicode, and the splitter's pattern.
_WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that tables describe: two planes, which have all letters since Unicode 3.2 and emoji.
_POINTS = 0x20000


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = _SPACE
    table[48:58] = _NUMBER
    table[65:91] = table[97:123] = _LETTER
    table[128:] = _LETTER  # bytes of the precomposed letters that the Latin alphabet allows
    return table


_CLASS = _byte_classes()


def _point_tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of every code point; ``_UNKNOWN`` where Unicode's versions may differ."""
    classes, lower = np.full(_POINTS, _UNKNOWN, np.uint8), np.arange(_POINTS, dtype=np.uint32)
    groups = {"L": _LETTER, "N": _NUMBER}
    for point in range(_POINTS):
        c = chr(point)
        now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        if now in ("Cn", "Cs", "Co") or len(small := c.lower()) != 1:
            continue
        group = groups.get(now[0], _OTHER)
        if then == "Cn":
            stable = group == _OTHER and now[0] not in "ZM" and not unicodedata.decomposition(c) and small == c
        else:
            stable = now[0] == then[0] or {now[0], then[0]} <= set("PSC")
        if stable:
            classes[point], lower[point] = group, ord(small)
    classes[_WHITE_SPACE] = _SPACE
    return classes, lower


class Encoder:
    """Token ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    _loaded: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each file and Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges.of(spec) if _splits_by_class(spec) else None
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet())}

    @cached_property
    def points(self) -> tuple[np.ndarray, np.ndarray]:
        return _point_tables()

    def kind(self, text: str) -> int:
        """How the text is encoded: ``LATIN``, ``WIDE`` or ``LIBRARY``."""
        if self.merges is None or ("<" in text and any(s in text for s in self.specials)):
            return LIBRARY
        if text.isascii() or not _NOT_LATIN.search(text):
            return LATIN
        try:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        except UnicodeEncodeError:
            return LIBRARY
        known = points.max() < _POINTS and not (self.points[0][points] == _UNKNOWN).any()
        return WIDE if known and unicodedata.is_normalized("NFC", text) else LIBRARY

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets): text i has ids[offsets[i]:offsets[i + 1]]."""
        kinds = [self.kind(t) for t in texts]
        if all(k == LATIN for k in kinds):
            return self._fast(texts, False)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for kind in (LATIN, WIDE):
            own = [i for i, k in enumerate(kinds) if k == kind]
            ids, offsets = self._fast([texts[i] for i in own], kind == WIDE)
            for i, a, b in zip(own, offsets[:-1].tolist(), offsets[1:].tolist()):
                parts[i] = ids[a:b]
        for i, k in enumerate(kinds):
            if k == LIBRARY:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def _classified(self, texts: list[str], wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the lower-cased texts, each with a line break behind; their classes; places of the breaks)."""
        if not wide:
            encoded = [t.lower().encode() for t in texts]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
            return data, _CLASS[data], np.cumsum(sizes + 1) - 1
        classes, lower = self.points
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        small = lower[points]
        width = 1 + (small >= 0x80).astype(np.int32) + (small >= 0x800) + (small >= 0x10000)
        data = np.frombuffer(small.tobytes().decode("utf-32-le").encode(), np.uint8)
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        return data, np.repeat(classes[points], width), np.cumsum(width)[breaks].astype(np.int64) - 1

    def _fast(self, texts: list[str], wide: bool) -> tuple[np.ndarray, np.ndarray]:
        data, kind, breaks = self._classified(texts, wide)
        inside = kind != _SPACE
        first = inside.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        if wide:
            first &= (data & 0xC0) != 0x80
        _contractions(data, kind, first)
        before = np.cumsum(first, dtype=np.int32)  # pieces up to and with this byte
        compact = data[inside]
        offsets = np.append(np.flatnonzero(first[inside]), len(compact)).astype(np.int32)
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        at = np.concatenate([[0], before[breaks]])
        del inside, first, before, kind
        pieces = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(compact)]).dictionary_encode()
        ids, lengths = self._merge(pieces.dictionary)
        index = pieces.indices.to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        each = lengths[index]
        ended = np.cumsum(each)
        take = np.repeat(starts[index] - ended + each, each)
        take += np.arange(len(take))
        return ids[take], np.concatenate([[0], ended])[at]

    def _merge(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of distinct pieces."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes > LONG_PIECE)
        if not len(long):
            return self.merges.encode(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        # A long piece leaves its first byte as a stand-in, whose id is replaced.
        kept = np.where(sizes > LONG_PIECE, 1, sizes)
        short = np.concatenate([[0], np.cumsum(kept)])
        ids, lengths = self.merges.encode(data[np.repeat(offsets[:-1] - short[:-1], kept) + np.arange(short[-1])], short)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        parts, done = [], 0
        for i in long.tolist():
            own = np.array([t.id for t in self.model.tokenize(data[offsets[i] : offsets[i + 1]].tobytes().decode("latin-1").translate(self.alphabet))], np.uint32)
            parts += [ids[done : bounds[i]], own]
            done, lengths[i] = bounds[i + 1], len(own)
        return np.concatenate([*parts, ids[done:]]), lengths


def _contractions(data: np.ndarray, kind: np.ndarray, first: np.ndarray) -> None:
    """An apostrophe that begins a piece takes s, t, m, d, re, ve or ll behind it; changes ``first``."""
    at = np.flatnonzero((data == 39) & first)
    at = at[at + 2 < len(data)]
    if not len(at):
        return
    one, two = data[at + 1], data[at + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((two == ord("e")) & np.isin(one, np.frombuffer(b"rv", np.uint8))) | ((one == ord("l")) & (two == ord("l")))
    for found, size in ((at[single], 1), (at[double], 2)):
        first[found + 1] = False
        rest = found + 1 + size
        rest = rest[rest < len(data)]
        first[rest[kind[rest] == _LETTER]] = True


def _splits_by_class(spec: dict) -> bool:
    """Whether the file normalises and splits as this module does."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [s["type"] for s in split] == ["Split", "ByteLevel"]
        and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": _SPLITTER}, "Removed", True)
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
        and spec.get("post_processor") is None
    )


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary; resolved where it is used, so each executor takes its own."""
    import public_tokenizers

    return public_tokenizers.path(name)
