"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

``scan`` reads any MPEG-1/2/2.5 stream (layers I to III): it parses an ID3v2 tag in front and an
ID3v1 tag behind, finds frame headers again after damage (a header counts when the next one follows
where its length says, or the stream ends there), verifies the CRC-16 of protected frames of all
layers and reads a Xing/Info or VBRI table.  A free-format stream's frame length is the distance of
its first two headers, once a third (or the end) follows at the same distance.  ``store_payload`` keeps bytes losslessly as the ancillary data of silent
layer III frames (one byte is the unit), with a tag that holds the length and a Xing table.

Defined results: null audio or text is the empty byte string; bytes without any frame give zero
frames, duration 0 and no offsets, as does a lone free-format frame; equal inputs give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, prepare, require

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_KBPS[2, 3] = _KBPS[2, 2]
#: Payload frames: MPEG-1 layer III, mono, 32 kHz, protected.
_SIDE, _HEAD = 17, 6


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int  # bytes of layer III side information
    bound: int = 32  # first subband whose bit allocation both channels share


@lru_cache(65536)
def parse_header(raw: bytes, free_bytes: int = 0) -> Header | None:
    """The header in four bytes, or None; a free-format one (bitrate 0) needs its unpadded size."""
    word = int.from_bytes(raw, "big")
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bitrate, rate_index = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate == 15 or rate_index == 3 or word & 3 == 2 or (not bitrate and not free_bytes):
        return None
    first = 1 if version == 3 else 2
    kbps, rate = _KBPS[first, layer][bitrate], _RATES[version][rate_index]
    mode, pad = word >> 6 & 3, word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and first == 2 else 1152
    if bitrate:
        size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    else:
        size = free_bytes + pad * _slot(layer)
        kbps = round(free_bytes * 8 * rate / samples / 1000)
    mono = mode == 3
    side = (17 if mono else 32) if first == 1 else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, kbps, rate, mono, size, samples, side, 4 * (word >> 4 & 3) + 4 if mode == 1 else 32)


def _slot(layer: int) -> int:
    return 4 if layer == 1 else 1


def _free_kind(raw: bytes) -> tuple[int, int, int] | None:
    """(version, layer, sampling rate) of a free-format header."""
    head = parse_header(raw, 1) if len(raw) == 4 and not raw[2] >> 4 else None
    return head and (head.version, head.layer, head.rate)


def free_size(data: bytes, at: int, end: int) -> int:
    """Unpadded frame size of the free-format stream that begins at ``at``, or 0.

    No frame is longer than at its layer's highest bitrate.
    """
    kind = _free_kind(data[at : at + 4])
    if not kind:
        return 0
    slot, first = _slot(kind[1]), 1 if kind[0] == 3 else 2
    longest = (48 if kind[1] == 1 else 144 if first == 1 or kind[1] == 2 else 72) * _KBPS[first, kind[1]][14] * 1000 // kind[2] + 2 * slot

    def padding(place: int) -> int:
        return slot * (data[place + 2] >> 1 & 1)

    second = at + 4
    while 0 <= (second := data.find(data[at : at + 1], second + 1, min(end, at + longest + 1))):
        if _free_kind(data[second : second + 4]) == kind:
            size = second - at - padding(at)
            third = second + size + padding(second)
            if third == end or (third + 4 <= end and _free_kind(data[third : third + 4]) == kind):
                return size
    return 0


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The checksum of protected frames: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The checksum of the first ``bits`` bits."""
    crc = crc16(data[: bits // 8])
    for i in range(bits - bits % 8, bits):
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15 ^ data[i // 8] >> (7 - i % 8)) & 1 else 0)
    return crc


# Fixed values of the layer II standard: bits of the allocation of each subband.
_ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low rates": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation(head: Header) -> tuple[int, ...]:
    if head.version != 3:
        return _ALLOCATION["low rates"]
    each = head.kbps / (1 if head.mono else 2)
    if each < 56:
        return _ALLOCATION["d" if head.rate == 32000 else "c"]
    return _ALLOCATION["b" if each >= 96 and head.rate != 48000 else "a"]


def protected_bits(body: bytes, head: Header) -> int:
    """Bits behind the checksum that it covers: side information, or allocation and scale factor selection."""
    if head.layer == 3:
        return 8 * head.side
    channels = 1 if head.mono else 2
    if head.layer == 1:
        bound = 32 if head.mono else head.bound
        return 4 * (channels * bound + 32 - bound)
    number, left = int.from_bytes(body[:64], "big"), 8 * len(body[:64])
    at = selected = 0
    for subband, bits in enumerate(_allocation(head)):
        own = 1 if subband >= head.bound else channels
        for _ in range(own):
            at += bits
            if number >> max(0, left - at) & ((1 << bits) - 1):
                selected += channels // own
    return at + 2 * selected


def intact(frame: bytes, head: Header) -> bool:
    """Whether a protected frame's checksum is right."""
    bits = protected_bits(frame[6:], head)
    return crc16_bits(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big") if 8 * (len(frame) - 6) >= bits else False


def frame_bytes(payload: bytes, kbps_index: int) -> bytes:
    """A silent protected frame whose ancillary data begin with ``payload``."""
    head = (0x7FF << 21 | 3 << 19 | 1 << 17 | kbps_index << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    size = parse_header(head).size
    side = bytes(_SIDE)
    return b"".join((head, crc16(head[2:] + side).to_bytes(2, "big"), side, payload)).ljust(size, b"\0")


def _room(kbps_index: int) -> int:
    return 144 * _KBPS[1, 3][kbps_index] * 1000 // 32000 - _HEAD - _SIDE


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def text_frame(name: str, value: str) -> bytes:
    body = b"\3" + f"{name}\0{value}".encode()
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


def store_payload(payload: bytes) -> bytes:
    """An ID3v2 tag, a Xing frame, payload frames and an ID3v1 tag; the last frame has the least fitting bitrate."""
    full = _room(14)
    frames = [frame_bytes(payload[i : i + full], 14) for i in range(0, len(payload) - len(payload) % full, full)]
    if rest := payload[len(frames) * full :]:
        frames.append(frame_bytes(rest, next(k for k in range(1, 15) if _room(k) >= len(rest))))
    xing_size = len(frame_bytes(b"", 14))
    total = xing_size + sum(map(len, frames))
    ends, seen = [xing_size], xing_size
    for f in frames:
        seen += len(f)
        ends.append(seen)
    toc = bytes(min(255, 256 * ends[len(frames) * i // 100] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag = text_frame("payload_bytes", str(len(payload)))
    # With a tag behind, payload bytes that spell TAG near the end can't be taken for one.
    behind = b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"
    return b"".join((b"ID3\4\0\0", _syncsafe(len(tag)), tag, frame_bytes(table, 14), *frames, behind))


@dataclass
class Scan:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int] = field(default_factory=dict)
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0

    def duration(self) -> tuple[int, int]:
        """Exact seconds as samples over samples a second."""
        return self.samples, self.rate or 1


def _id3v2(data: bytes, out: Scan) -> int:
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    at, wide = 10, data[3] >= 4
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name = data[at : at + 4].decode("latin-1")
        size = sum(b << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0))) if wide else int.from_bytes(data[at + 4 : at + 8], "big")
        body, at = data[at + 10 : at + 10 + size], at + 10 + size
        if name[0] == "T" and body:
            text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value
    return min(end + 10 * (data[5] >> 4 & 1), len(data))


def _id3v1(data: bytes, out: Scan) -> int:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
        if value := data[a - 128 : b - 128].rstrip(b"\0 ").decode("latin-1"):
            out.tags.setdefault(name, value)
    return len(data) - 128


def _vbr_table(frame: bytes, head: Header, out: Scan) -> bool:
    """Whether the frame is a table instead of sound."""
    for at in (_HEAD - 2 + head.side, _HEAD + head.side):
        if (name := frame[at : at + 4]) in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out.vbr[key], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                out.toc = frame[at : at + 100]
            out.vbr["constant"] = int(name == b"Info")
            return True
    if frame[36:40] == b"VBRI":
        out.vbr.update(bytes=int.from_bytes(frame[46:50], "big"), frames=int.from_bytes(frame[50:54], "big"), constant=0)
        return True
    return False


def scan(data: bytes) -> Scan:
    """Everything but sound: tags, table, frame offsets, samples, checksums, skipped bytes."""
    out = Scan()
    at, end = _id3v2(data, out), _id3v1(data, out)
    synced = first = None
    free = 0
    while at + 4 <= end:
        raw = data[at : at + 4]
        if raw[2] >> 4 == 0 and not (free and synced):
            free = free_size(data, at, end)
        head = parse_header(raw, free)
        follows = head and at + head.size
        if head and follows <= end and (synced or follows == end or parse_header(data[follows : follows + 4], free)):
            frame = data[at:follows]
            if head.protected:
                out.checked += 1
                out.failed += not intact(frame, head)
            if first is None and head.layer == 3 and _vbr_table(frame, head, out):
                first = at
            else:
                first = at if first is None else first
                out.offsets.append(at)
                out.headers.append(head)
                out.samples += head.samples
                out.rate = out.rate or head.rate
            synced, at = True, follows
        else:
            synced = None
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at = found
    out.skipped += max(0, end - at)
    return out


def payload_of(data: bytes, found: Scan) -> bytes:
    """The ancillary data of all frames, to the length that the tag states."""
    parts = [data[a + (_HEAD if h.protected else 4) + h.side : a + h.size] for a, h in zip(found.offsets, found.headers)]
    return b"".join(parts)[: int(found.tags.get("payload_bytes", "0"))]


_INFO = (
    "n_frames long, duration_samples long, sample_rate long, vbr_frames long, vbr_bytes long, crc_checked long, "
    "crc_failed long, skipped_bytes long, seek_offsets array<long>, tags map<string,string>"
)


def probe(df: DataFrame, key: str, audio: str) -> DataFrame:
    """Facts of a binary MPEG audio column: exact duration, checksums, and all frame offsets."""
    prepare(df.sparkSession)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [scan(x or b"") for x in batch.column("audio").to_pylist()]
            columns = [[len(f.offsets), f.samples, f.rate, f.vbr.get("frames"), f.vbr.get("bytes"), f.checked, f.failed, f.skipped, f.offsets, list(f.tags.items())] for f in found]
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
            arrays = [pa.array([c[i] for c in columns], k) for i, k in enumerate(kinds)]
            names = [x.split()[0] for x in _INFO.replace("map<string,string>", "map").split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=["key", *names])

    kind = df.schema[key].dataType.simpleString()
    narrow = require(df, key, audio).toDF("key", "audio")
    return narrow.mapInArrow(run, f"key {kind}, {_INFO}").withColumnRenamed("key", key)


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames long, duration_samples long, sample_rate long, crc_failed long"
)


def text_as_audio(docs: DataFrame) -> DataFrame:
    """Store every text as audio, read the stored bytes back and digest both."""
    prepare(docs.sparkSession)

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode()
            media = store_payload(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"))
            found = scan(media)
            back = payload_of(media, found)
            seek = hashlib.sha256(struct.pack(f"<{len(found.offsets)}Q", *found.offsets)).hexdigest()[:16]
            feature = (
                f"samples={found.samples};rate={found.rate};frames={len(found.offsets)};table={found.vbr.get('frames')}"
                f"/{found.vbr.get('bytes')};crc={found.checked - found.failed}/{found.checked};seek={seek}"
            )
            rows.append((
                doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                hashlib.sha256(media).hexdigest(), feature, len(found.offsets), found.samples, found.rate, found.failed,
            ))
        fields = [x.split() for x in _DIGEST.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return map_texts(require(docs, "doc_id", "text"), convert, _DIGEST)


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return text_as_audio(documents(spark, sf_dir))
