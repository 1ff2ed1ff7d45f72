import random

import pytest

from brinewave.llm import mpeg_audio as A


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 1153, 5000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    payload = A.padded(raw)
    data = A.pack(payload)
    s = A.parse(data)
    units = len(payload) // 576
    assert A.unpack(data) == payload and s.wrong == s.skipped == 0 and s.tags == 1
    assert len(s.offsets) == s.table_frames == -(-units // 2) and s.checked == len(s.offsets) + 1
    assert s.seconds == len(s.offsets) * 1152 / 32000 and len(data) - s.table_bytes == len(A.id3("payload"))


def test_payload_that_looks_like_headers():
    payload = A.padded(A.HEADS[A.ONE] * 40 + b"\xff\xfa" * 500 + b"ID3\x04\0\0\0\0\0\x10TAG")
    data = A.pack(payload)
    assert A.unpack(data) == payload and A.parse(data).skipped == 0


def test_resynchronises_after_foreign_bytes():
    payload = A.padded(bytes(range(256)) * 20)
    data = A.pack(payload)
    junk = b"\xff\xfb\x90\x00 junk \xff\xfa\x98\xc0" * 9
    first = A.parse(data).offsets[1]
    s = A.parse(junk + data[:first] + junk + data[first:] + junk)
    assert len(s.offsets) == len(A.parse(data).offsets) and s.skipped == 3 * len(junk)
    assert A.unpack(junk + data[:first] + junk + data[first:] + junk) == payload


def test_wrong_checksums_are_counted():
    data = bytearray(A.pack(A.padded(b"x" * 4000)))
    at = A.parse(bytes(data)).offsets[1]
    data[at + 8] ^= 1  # in the side information
    s = A.parse(bytes(data))
    assert s.wrong == 1 and len(s.bodies) == len(s.offsets) - 1


def test_tags_at_the_end():
    data = A.pack(A.padded(b"abc")) + b"TAG" + b"\0" * 125
    assert A.parse(data).tags == 2 and A.parse(None).seconds == 0 and A.parse(b"ID3").skipped == 3


def test_checksum():
    assert A.crc16(b"123456789") == 0xAEE7  # polynomial 0x8005, start 0xFFFF, not reflected


def test_operator(docs, texts, empty):
    got = docs.withColumn("media", A.media(docs.text))
    got = got.withColumn("read", A.read_back(got.media)).withColumn("found", A.features(got.media)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (r.text or "").encode()
        assert A.unpack(bytes(r.media))[: len(raw)] == raw and r["read"].payload_bytes % 576 == 0 and r.found.n_frames == len(r.found.offsets)
    assert empty.withColumn("m", A.media(empty.text)).count() == 0
