"""A Spark data source for EDF recordings.

    spark.dataSource.register(EdfSource)
    spark.read.format("edf").option("channels", "FP1-F7,F7-T7").load(folder)

One row for each channel and stretch of data records: (path, record_id, channel, chunk_no, start_sample, sfreq, samples,
status, reason). Files are cut into partitions by their sizes, so one long recording is read by many tasks and no file is
opened to plan them. A list of channels prunes what is decoded. Files are reached through Arrow's file systems, so
shared stores work as well as disks.

A file that can't be read (no header, fields that aren't numbers, fewer bytes than the header promises) gives one row
with the status failed and the reason, without a channel and samples, and stops no other file; with the option mode set
to failfast it raises instead. A header that doesn't know the number of its records (-1) gets it from the file's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, record_id string, channel string, chunk_no int, start_sample long, sfreq double, samples array<double>, status string, reason string"
RECORDS = 60  # data records of a chunk
PARTITION_BYTES = 16 << 20  # of a file, for a partition


class BrokenFile(ValueError):
    """What a file lacks to be a recording."""


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    """An EDF header: 256 bytes, then 256 for each signal, field by field."""

    names: list[str]
    low: np.ndarray
    high: np.ndarray
    digital_low: np.ndarray
    digital_high: np.ndarray
    per_record: np.ndarray
    records: int
    seconds: float
    size: int

    @classmethod
    def read(cls, raw: bytes) -> Header:
        text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
        n = int(text(252, 4))
        at = 256
        fields = {}
        # Fixed values of the format: the signal fields and their widths, in order.
        for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("dlow", 8), ("dhigh", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
            fields[name] = [text(at + k * width, width) for k in range(n)]
            at += n * width
        num = lambda name: np.array([float(v) for v in fields[name]])
        return cls(unique(fields["label"]), num("low"), num("high"), num("dlow"), num("dhigh"), num("samples").astype(int), int(text(236, 8)), float(text(244, 8)), int(text(184, 8)))


def unique(names: list[str]) -> list[str]:
    """Names that occur more than once get -0, -1 and so on."""
    seen: dict[str, int] = {}
    out = []
    for x in names:
        if names.count(x) > 1:
            out.append(f"{x}-{seen.get(x, 0)}")
            seen[x] = seen.get(x, 0) + 1
        else:
            out.append(x)
    return out


@dataclass
class Share(InputPartition):
    """The chunks of a file whose number lies between two fractions of them all."""

    path: str
    size: int
    part: int
    parts: int


def opened(data, size: int) -> Header:
    """The header of an open file, with the number of records that the file has."""
    top = data.read(256)
    try:
        h = Header.read(top + data.read(max(0, int(top[184:192]) - 256)))
    except (ValueError, IndexError) as e:
        raise BrokenFile(f"no EDF header: {e}") from e
    width = 2 * int(h.per_record.sum())
    if not h.names or (h.per_record <= 0).any() or h.seconds <= 0 or h.size != 256 * (len(h.names) + 1):
        raise BrokenFile("no EDF header: its sizes contradict each other")
    if (h.digital_high == h.digital_low).any():
        raise BrokenFile("no EDF header: a channel without digital range")
    there = (size - h.size) // width
    if h.records < 0:
        h.records = there
    elif there < h.records:
        raise BrokenFile(f"truncated: {there} of {h.records} records")
    if not h.records:
        raise BrokenFile("no records")
    return h


class EdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.records = int(options.get("recordsperchunk", RECORDS))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.failfast = options.get("mode", "permissive").lower() == "failfast"
        self.channels = [c.strip() for c in options.get("channels", "").split(",") if c.strip()]

    def files(self) -> list[pafs.FileInfo]:
        """Files whose names end in .edf, in order."""
        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [info]
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        return sorted((f for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".edf")), key=lambda f: f.path)

    def partitions(self) -> list[Share]:
        cut = [(f.path, f.size, max(1, -(-f.size // self.bytes))) for f in self.files()]
        return [Share(path, size, k, n) for path, size, n in cut for k in range(n)]

    def read(self, part: Share) -> Iterator[tuple]:
        store, _ = filesystem(self.path)
        stem = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            with store.open_input_file(part.path) as data:
                h = opened(data, part.size)
                for row in self.stretches(data, h, part):
                    yield part.path, stem, *row, "ok", ""
        except (BrokenFile, OSError) as e:
            if self.failfast:
                raise
            if part.part == 0:  # one row, however many tasks read the file
                yield part.path, stem, None, None, None, None, None, "failed", str(e)

    def stretches(self, data, h: Header, part: Share) -> Iterator[tuple]:
        """(channel, chunk_no, start_sample, sfreq, samples) of a share of the chunks."""
        width = int(h.per_record.sum())
        gain = (h.high - h.low) / (h.digital_high - h.digital_low)
        starts = np.concatenate([[0], np.cumsum(h.per_record)])
        chunks = -(-h.records // self.records)
        for k in range(chunks * part.part // part.parts, chunks * (part.part + 1) // part.parts):
            first = k * self.records
            n = min(self.records, h.records - first)
            grid = np.frombuffer(data.read_at(2 * width * n, h.size + 2 * width * first), "<i2").reshape(n, width)
            for c, name in enumerate(h.names):
                if name == "EDF Annotations" or self.channels and name not in self.channels:
                    continue
                x = (grid[:, starts[c] : starts[c + 1]].ravel() - h.digital_low[c]) * gain[c] + h.low[c]
                yield name, k, first * int(h.per_record[c]), float(h.per_record[c] / h.seconds), x.tolist()


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)


def write_edf(path: str, names: list[str], signals: np.ndarray, rate: int, seconds: float = 1.0) -> None:
    """Write signals (channels x samples) as EDF; for tests and exports of single recordings."""
    n, per = len(names), int(rate * seconds)
    records = signals.shape[1] // per
    low, high = signals.min(axis=1) - 1, signals.max(axis=1) + 1
    pad = lambda v, w: str(v)[:w].ljust(w).encode("latin-1")
    low, high = (np.array([float(str(v)[:8]) for v in x]) for x in (low, high))
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(f"{seconds:g}", 8) + pad(n, 4)
    cols = [[pad(x, 16) for x in names], [pad("", 80)] * n, [pad("uV", 8)] * n, [pad(v, 8) for v in low], [pad(v, 8) for v in high], [pad(-32768, 8)] * n, [pad(32767, 8)] * n, [pad("", 80)] * n, [pad(per, 8)] * n, [pad("", 32)] * n]
    digital = np.round((signals[:, : records * per] - low[:, None]) / (high - low)[:, None] * 65535 - 32768).clip(-32768, 32767).astype("<i2")
    body = digital.reshape(n, records, per).transpose(1, 0, 2).tobytes()
    with open(path, "wb") as f:
        f.write(head + b"".join(b"".join(c) for c in cols) + body)
