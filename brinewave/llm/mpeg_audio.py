"""Media columns: MPEG audio.

`pack` stores bytes without loss in the ancillary data of MPEG-1 Layer III frames (mono, 32 kHz, with checksums, no
main audio data), behind an ID3v2 tag and a frame with a table of seek points for variable bitrate. `parse` reads such
a stream, or any stream of MPEG-1 Layer III frames: it skips tags, resynchronises after foreign bytes, verifies the
frames' checksums and returns the exact duration and the offset of every frame.

A header alone is no proof, since payload bytes may look like one: a frame counts only if another frame, a tag or the
end of the stream follows where its length says so.

Defined cases. A null or empty text is the empty payload, stored as one unit of padding. A null stream has no frames and
duration 0. Bytes that belong to no frame and no tag are counted as skipped; frames with a wrong checksum are counted
and their payload is left out. Very long texts are stored whole, in as many frames as they need. Nothing is
compared, so there are no ties. An empty table gives no rows. Repeated rows get equal streams. Extra columns are kept; outputs replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from brinewave.llm.common import materialize, table

UNIT = 576  # samples of a granule, and bytes of a unit of payload
SAMPLES = 1152  # of an MPEG-1 Layer III frame
# Fixed values of the format: kbit/s and Hz by their codes in a frame header of MPEG-1 Layer III.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
HERTZ = (44100, 48000, 32000, 0)
SIDE = {True: 17, False: 32}  # bytes of side information: mono or not
RATE = 32000
ONE, TWO = 160, 320  # kbit/s of the frames that hold one and two units
INFO_KBITS = 64


@dataclass(frozen=True)
class Header:
    """A frame header of MPEG-1 Layer III."""

    kbits: int
    hertz: int
    padding: int
    protected: bool
    mono: bool

    @property
    def length(self) -> int:
        return 144_000 * self.kbits // self.hertz + self.padding

    @property
    def side(self) -> int:
        return SIDE[self.mono]

    @property
    def body(self) -> int:
        """Where main data starts."""
        return 4 + 2 * self.protected + self.side

    def bytes(self) -> bytes:
        return bytes((0xFF, 0xFA | (not self.protected), KBITS.index(self.kbits) << 4 | HERTZ.index(self.hertz) << 2 | self.padding << 1, 0xC0 if self.mono else 0))


def header_at(data: bytes, at: int) -> Header | None:
    """The frame header at an offset, or nothing if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return None
    kbits, hertz = KBITS[data[at + 2] >> 4], HERTZ[data[at + 2] >> 2 & 3]
    if not kbits or not hertz or data[at + 3] & 3 == 2:  # free or bad bitrate, reserved rate, reserved emphasis
        return None
    h = Header(kbits, hertz, data[at + 2] >> 1 & 1, not data[at + 1] & 1, data[at + 3] >> 6 == 3)
    return h if h.length > h.body else None


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The frames' checksum: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def head_of(kbits: int) -> bytes:
    """Header, checksum and silent side information of a frame."""
    h = Header(kbits, RATE, 0, True, True)
    side = bytes(h.side)
    return h.bytes() + crc16(h.bytes()[2:] + side).to_bytes(2, "big") + side


HEADS = {k: head_of(k) for k in (ONE, TWO, INFO_KBITS)}
LENGTH = {k: 144_000 * k // RATE for k in HEADS}


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def id3(title: str) -> bytes:
    text = b"\x03" + title.encode()
    body = b"TIT2" + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + synchsafe(len(body)) + body


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def pack(payload: bytes) -> bytes:
    """A stream that holds a payload, a positive multiple of UNIT bytes: two units to a frame, an odd last one alone."""
    units = len(payload) // UNIT
    if not units or units * UNIT != len(payload):
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    pairs, odd = divmod(units, 2)
    frames = bytearray()
    if pairs:
        grid = np.zeros((pairs, LENGTH[TWO]), np.uint8)
        head = np.frombuffer(HEADS[TWO], np.uint8)
        grid[:, : len(head)] = head
        grid[:, len(head) : len(head) + 2 * UNIT] = np.frombuffer(payload, np.uint8, 2 * UNIT * pairs).reshape(pairs, 2 * UNIT)
        frames += grid.tobytes()
    if odd:
        frames += (HEADS[ONE] + payload[-UNIT:]).ljust(LENGTH[ONE], b"\0")
    n, size = pairs + odd, LENGTH[INFO_KBITS] + len(frames)
    starts = LENGTH[INFO_KBITS] + np.minimum(np.arange(100) * n // 100, n - 1) * LENGTH[TWO]
    toc = bytes(np.minimum(255, starts * 256 // size).astype(np.uint8))
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    return id3("payload") + (HEADS[INFO_KBITS] + table).ljust(LENGTH[INFO_KBITS], b"\0") + bytes(frames)


@dataclass
class Stream:
    """What `parse` found. Offsets are those of the audio frames, the frame with the seek table left out."""

    offsets: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int, int]] = field(default_factory=list)  # start and end of main data, kbit/s
    samples: dict[int, int] = field(default_factory=dict)  # by rate
    tags: int = 0
    skipped: int = 0
    checked: int = 0
    wrong: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""

    @property
    def seconds(self) -> float:
        return sum(n / hz for hz, n in self.samples.items())

    @property
    def bitrates(self) -> set[int]:
        return {k for _, _, k in self.bodies}


def tag_at(data: bytes, at: int) -> int:
    """Length of an ID3v2, ID3v1 or APEv2 tag at an offset, 0 if there is none."""
    if data[at : at + 3] == b"ID3" and at + 10 <= len(data) and not any(b & 0x80 for b in data[at + 6 : at + 10]):
        a, b, c, d = data[at + 6 : at + 10]
        return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 0x10 else 0)
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        return 128
    if data[at : at + 8] == b"APETAGEX" and at + 32 <= len(data):
        return int.from_bytes(data[at + 12 : at + 16], "little") + (32 if data[at + 23] & 0x80 else 0)
    return 0


def parse(data: bytes | None) -> Stream:
    """Tags, seek table and frames of a stream."""
    out = Stream()
    data = data or b""
    at, first, size = 0, True, len(data)
    follows = lambda k: k == size or header_at(data, k) is not None or tag_at(data, k) > 0
    right: dict[bytes, bool] = {}  # checksums of a stream repeat: heads that were verified
    while at < size:
        if n := tag_at(data, at):
            out.tags += 1
            at += n
            continue
        h = header_at(data, at)
        if h is None or at + h.length > size or not follows(at + h.length):
            nxt = data.find(b"\xff", at + 1)
            nxt = size if nxt < 0 else nxt
            for mark in (b"ID3", b"TAG", b"APETAGEX"):
                k = data.find(mark, at + 1, nxt)
                nxt = k if k >= 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        good = True
        if h.protected:
            head = data[at : at + h.body]
            good = right.get(head)
            if good is None:
                good = right[head] = crc16(head[2:4] + head[6:]) == int.from_bytes(head[4:6], "big")
            out.checked += 1
        body = at + h.body
        if first and data[body : body + 4] in (b"Xing", b"Info"):
            flags, k = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            if flags & 1:
                out.table_frames, k = int.from_bytes(data[k : k + 4], "big"), k + 4
            if flags & 2:
                out.table_bytes, k = int.from_bytes(data[k : k + 4], "big"), k + 4
            if flags & 4:
                out.toc = data[k : k + 100]
        else:
            out.offsets.append(at)
            out.samples[h.hertz] = out.samples.get(h.hertz, 0) + SAMPLES
            if good:
                out.bodies.append((body, at + h.length, h.kbits))
        out.wrong += not good
        first = False
        at += h.length
    return out


def unpack(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stream made by `pack`."""
    s = stream or parse(data)
    return b"".join(data[a : a + (2 * UNIT if kbits == TWO else UNIT)] for a, _, kbits in s.bodies)


FEATURES = "n_frames int, seconds double, n_tags int, skipped long, n_checked int, n_wrong int, table_frames int, offsets array<long>"


def media(text: Column) -> Column:
    """Streams that hold a column's texts as UTF-8."""

    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([pack(padded((x or "").encode("utf-8", "surrogatepass"))) for x in texts.to_pylist()], pa.binary())

    return of(text)


def features(stream: Column) -> Column:
    """Struct of what `parse` finds in a column of streams, with the seek offset of every frame."""

    @arrow_udf(FEATURES)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for streams in batches:
            found = [parse(x) for x in streams.to_pylist()]
            ints = lambda of, kind=pa.int32(): pa.array([of(s) for s in found], kind)
            yield pa.StructArray.from_arrays(
                [ints(lambda s: len(s.offsets)), ints(lambda s: s.seconds, pa.float64()), ints(lambda s: s.tags), ints(lambda s: s.skipped, pa.int64()),
                 ints(lambda s: s.checked), ints(lambda s: s.wrong), ints(lambda s: s.table_frames), ints(lambda s: s.offsets, pa.list_(pa.int64()))],
                ["n_frames", "seconds", "n_tags", "skipped", "n_checked", "n_wrong", "table_frames", "offsets"],
            )

    return of(stream)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stream: Column) -> Column:
    """Struct of digests of the payload and of the stream, and the features as one string."""

    @arrow_udf(READ)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for streams in batches:
            rows = []
            for value in streams:
                data = value.as_py()
                s = parse(data)
                payload = unpack(data, s)
                seek = hashlib.sha256(np.array(s.offsets, "<i8").tobytes()).hexdigest()[:16]
                feature = f"frames={len(s.offsets)};seconds={s.seconds:.6f};kbits={'/'.join(map(str, sorted(s.bitrates)))};tags={s.tags};table={s.table_frames};checked={s.checked};wrong={s.wrong};skipped={s.skipped};seek={seek}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return of(stream)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    stored = materialize(documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media(F.col("text")).alias("media")), "media")
    return stored.select("doc_id", "n_bytes", read_back(F.col("media")).alias("r")).select("doc_id", "n_bytes", "r.*")
