"""MPEG audio: lossless storage, and scanning of tagged, damaged and variable-rate streams."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from brambling.llm import mpeg_audio as m


@pytest.mark.parametrize("size", [64, 128, 1344, 1408, 4096, 100_032])
def test_payload_comes_back(size):
    payload = bytes((i * 7 + i // 251) % 256 for i in range(size))
    for data in (payload, b"\xff\xfb\x90\x00" * (size // 4), b"TAG" * (size // 3) + b"x" * (size % 3), b"ID3" + bytes(size - 3)):
        media = m.store_payload(data)
        found = m.scan(media)
        assert m.payload_of(media, found) == data
        assert found.failed == 0 and found.skipped == 0 and found.checked == len(found.offsets) + 1
        assert found.vbr["frames"] == len(found.offsets) and found.vbr["bytes"] == len(media) - found_tag(media) - 128


def found_tag(media: bytes) -> int:
    return 10 + sum(b << s for b, s in zip(media[6:10], (21, 14, 7, 0)))


def test_damage_is_skipped():
    frames = [m.frame_bytes(bytes([i]) * 20, 9) for i in range(6)]
    clean = m.scan(b"".join(frames))
    assert clean.offsets == [len(frames[0]) * i for i in range(6)] and clean.duration() == (6 * 1152, 32000)
    noise = b"\xff\xe0junk\xff\xff" * 9
    found = m.scan(noise + b"".join(frames[:3]) + noise + b"".join(frames[3:]))
    assert len(found.offsets) == 6 and found.skipped == 2 * len(noise)
    broken = bytearray(b"".join(frames))
    broken[len(frames[0]) + 8] ^= 1
    assert m.scan(bytes(broken)).failed == 1
    assert m.scan(b"").offsets == [] and m.scan(b"\xff").offsets == [] and m.scan(bytes(999)).skipped == 999


@pytest.mark.parametrize("word,layer,size,samples", [(0xFFFB9064, 3, 417, 1152), (0xFFF39064, 3, 261, 576), (0xFFFD9004, 2, 522, 1152), (0xFFFF9004, 1, 312, 384), (0xFFE39064, 3, 522, 576)])
def test_headers(word, layer, size, samples):
    head = m.parse_header(word.to_bytes(4, "big"))
    assert (head.layer, head.size, head.samples) == (layer, size, samples)


@pytest.mark.parametrize("word", [0xFFFB0064, 0xFFFBF064, 0xFFFB9C64, 0xFFEB9064, 0xFFF99064, 0x7FFB9064, 0xFFFB9066])
def test_bad_headers(word):
    assert m.parse_header(word.to_bytes(4, "big")) is None


def test_tags_and_tables():
    frame = m.frame_bytes(b"", 9)
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Me".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(31)
    title = b"TIT2" + struct.pack(">I", 5) + b"\0\0" + b"\x00Tune"
    tag = b"ID3\x03\0\0" + bytes((0, 0, 0, len(title))) + title
    vbri = bytearray(frame)
    vbri[36:40], vbri[46:54] = b"VBRI", struct.pack(">II", 4321, 2)
    found = m.scan(tag + bytes(vbri) + frame + frame + old)
    assert found.tags == {"TIT2": "Tune", "title": "Song", "artist": "Me", "year": "1999"}
    assert (found.vbr["bytes"], found.vbr["frames"], len(found.offsets)) == (4321, 2, 2)


def test_column(spark):
    stream = m.store_payload(bytes(640))
    df = spark.createDataFrame([(1, stream, "z"), (2, None, None), (3, b"junk", "z")], "id long, sound binary, key string")
    got = {r["id"]: r for r in m.probe(df, "id", "sound").collect()}
    assert got[1]["n_frames"] == len(got[1]["seek_offsets"]) == 1 and got[1]["crc_failed"] == 0 and got[1]["tags"]["payload_bytes"] == "640"
    assert got[2]["n_frames"] == 0 and got[3]["skipped_bytes"] == 4
    assert m.probe(df.limit(0), "id", "sound").count() == 0


def test_query_against_brute_force(edges, nothing, documents):
    for docs in (edges, documents):
        texts = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr)
        got = sorted(m.text_as_audio(docs).collect(), key=lambda r: (repr(r["doc_id"]), r["n_bytes"]))
        want = []
        for doc, text in texts:
            raw = (text or "").encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want.append((doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
        assert [tuple(r)[:5] for r in got] == sorted(want, key=lambda w: (repr(w[0]), w[1]))
        assert all(r["media_bytes"] > r["payload_bytes"] and r["crc_failed"] == 0 for r in got)
        assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert m.text_as_audio(nothing).count() == 0


def _bits(text: str) -> bytes:
    text = text.ljust(-(-len(text) // 8) * 8, "0")
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def _crc_by_bits(bits: str) -> int:
    """The checksum by its definition: a shift register of 16 bits."""
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ int(b)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _protected(head: int, covered: str, rest: int, size: int) -> bytes:
    """A frame with a checksum over bits 16 to 31 of its header and ``covered``."""
    crc = _crc_by_bits(f"{head & 0xFFFF:016b}" + covered)
    return (head.to_bytes(4, "big") + crc.to_bytes(2, "big") + _bits(covered + "01" * rest)).ljust(size, b"\x55")[:size]


def test_checksums_of_layers_one_and_two():
    # Layer I, 32 kHz, 64 kbps, joint stereo from subband 8: 4 bits for 2 x 8 + 24 allocations.
    one = 0x7FF << 21 | 3 << 19 | 3 << 17 | 2 << 12 | 2 << 10 | 1 << 6 | 1 << 4
    size = m.parse_header(one.to_bytes(4, "big")).size
    frame = _protected(one, "1010" * 40, 40, size)
    found = m.scan(frame * 3)
    assert (len(found.offsets), found.checked, found.failed) == (3, 3, 0)
    # Layer II, 44.1 kHz, 192 kbps, stereo: 30 subbands, selection for those with bits.
    two = 0x7FF << 21 | 3 << 19 | 2 << 17 | 10 << 12 | 0 << 10
    widths = [4] * 11 + [3] * 12 + [2] * 7
    values = [(k * 7 + c) % 3 for k in range(30) for c in range(2)]
    covered = "".join(f"{v:0{w}b}" for v, w in zip(values, [w for w in widths for _ in range(2)])) + "10" * sum(v > 0 for v in values)
    size = m.parse_header(two.to_bytes(4, "big")).size
    frame = _protected(two, covered, 60, size)
    damaged = bytearray(frame)
    damaged[9] ^= 4
    found = m.scan(frame + bytes(damaged) + frame)
    assert (len(found.offsets), found.checked, found.failed) == (3, 3, 1)
    # Bits behind what the checksum covers may change.
    behind = bytearray(frame)
    behind[-1] ^= 1
    assert m.scan(frame + bytes(behind)).failed == 0


def test_free_format():
    def frame(pad: int, fill: int) -> bytes:
        head = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 0 << 12 | 0 << 10 | pad << 9 | 3 << 6
        return head.to_bytes(4, "big") + bytes([fill]) * (500 - 4 + pad)

    stream = frame(0, 1) + frame(1, 2) + frame(0, 3) + frame(1, 4)
    for junk in (b"", b"\xff\xfb\x00junk\xff\xff"):
        found = m.scan(junk + stream)
        assert [o - len(junk) for o in found.offsets] == [0, 500, 1001, 1501]
        assert found.samples == 4 * 1152 and found.rate == 44100 and found.skipped == len(junk)
    assert found.headers[0].kbps == round(500 * 8 * 44100 / 1152 / 1000)
    assert not m.scan(frame(0, 1)).offsets and m.scan(frame(0, 1)).skipped == 500
