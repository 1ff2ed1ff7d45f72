"""Spark data source and sink of .npy array files.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load(folder)                        # (path, name, row, shape, dtype, values)
    df.write.format("npy").option("dtype", "float32").mode("append").save(folder)

Reading: one row for each row of an array (its first axis), the other axes flat in values, in C order. A file's rows are
cut into partitions by bytes, and the header is read by the tasks. Files in Fortran order and of zero dimensions are
read too. A file that isn't an array, is truncated, or has a dtype other than numbers and booleans gives one row with
a reason and no values; with mode failfast it raises. Numbers become doubles: whole numbers beyond 2 ** 53 fail.

Writing: df has name, row and values (an array of numbers, of equal length within a name); all rows of a name must be in
one partition, in order of row (`write_arrays` sees to it). Each name is a file name.npy with as many rows as it has,
written under another name first; the commit on the driver moves the files of successful tasks to their places, and an
abort removes what was written, so a lost task leaves no half file.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from brinewave.sources.edf import filesystem

SCHEMA = "path string, name string, row long, shape array<long>, dtype string, values array<double>, reason string"
PARTITION_BYTES = 16 << 20
MAGIC = b"\x93NUMPY"


class NotAnArray(ValueError):
    """Why a file can't be read."""


@dataclass
class Layout:
    dtype: np.dtype
    fortran: bool
    shape: tuple[int, ...]
    start: int

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def layout(data, size: int) -> Layout:
    """What the header of an open file of that size says: versions 1 to 3 of the format."""
    top = data.read(12)
    if len(top) < 10 or top[:6] != MAGIC:
        raise NotAnArray("no .npy header")
    wide = top[6] >= 2
    n, at = struct.unpack("<I", top[8:12])[0] if wide else struct.unpack("<H", top[8:10])[0], 12 if wide else 10
    try:
        said = ast.literal_eval((top[at:] + data.read(n - len(top) + at)).decode("utf-8" if top[6] >= 3 else "latin-1"))
        out = Layout(np.dtype(said["descr"]), bool(said["fortran_order"]), tuple(map(int, said["shape"])), at + n)
    except (ValueError, SyntaxError, KeyError, TypeError) as e:
        raise NotAnArray(f"no .npy header: {e}") from e
    if out.dtype.kind not in "biuf":
        raise NotAnArray(f"dtype {out.dtype} isn't a number")
    need = out.start + out.dtype.itemsize * out.rows * out.width
    if size < need:
        raise NotAnArray(f"truncated: {size} of {need} bytes")
    return out


def doubles(x: np.ndarray) -> np.ndarray:
    if x.dtype.kind in "iu" and x.dtype.itemsize == 8 and len(x) and (int(x.max()) > 1 << 53 or int(x.min()) < -(1 << 53)):
        raise NotAnArray("whole numbers beyond 2 ** 53")
    return x.astype(np.float64)


@dataclass
class Share(InputPartition):
    path: str
    size: int
    part: int
    parts: int


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.failfast = options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[Share]:
        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root, recursive=True))
        own = sorted((f for f in found if f.type == pafs.FileType.File and f.path.endswith(".npy") and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        return [Share(f.path, f.size, k, n) for f in own for n in [max(1, -(-f.size // self.bytes))] for k in range(n)]

    def read(self, part: Share) -> Iterator[tuple]:
        store, _ = filesystem(self.path)
        name = part.path.rsplit("/", 1)[-1].removesuffix(".npy")
        try:
            with store.open_input_file(part.path) as data:
                a = layout(data, part.size)
                for row, values in self.rows(data, a, part):
                    yield part.path, name, row, list(a.shape), a.dtype.str, values.tolist(), ""
        except (NotAnArray, OSError) as e:
            if self.failfast:
                raise
            if part.part == 0:
                yield part.path, name, None, None, None, None, str(e)

    def rows(self, data, a: Layout, part: Share) -> Iterator[tuple[int, np.ndarray]]:
        """(row, values) of a share of the rows; of Fortran order, a column after the other."""
        first, last = a.rows * part.part // part.parts, a.rows * (part.part + 1) // part.parts
        each = a.dtype.itemsize
        step = max(1, (1 << 20) // max(1, a.width * each))
        for k in range(first, last, step):
            n = min(step, last - k)
            if a.fortran and len(a.shape) > 1:
                columns = [np.frombuffer(data.read_at(n * each, a.start + each * (c * a.rows + k)), a.dtype) for c in range(a.width)]
                flat = np.stack(columns, axis=1).reshape(n, *a.shape[:0:-1]).transpose(0, *range(len(a.shape) - 1, 0, -1)).reshape(n, a.width) if a.width else np.empty((n, 0), a.dtype)
            else:
                flat = np.frombuffer(data.read_at(n * a.width * each, a.start + each * k * a.width), a.dtype).reshape(n, a.width)
            x = doubles(flat.ravel()).reshape(n, a.width)
            for j in range(n):
                yield k + j, x[j]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NpyWriter(DataSourceWriter):
    """Files of one job lie under a name of their own until the job commits."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.dtype = np.dtype(options.get("dtype", "float64")).str
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = filesystem(self.path)
        folder = f"{root.rstrip('/')}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        done, seen, open_ = [], set(), None
        try:
            for r in rows:
                if open_ is None or open_.name != r["name"]:
                    if open_ is not None:
                        done.append(open_.close())
                    if r["name"] in seen:
                        raise ValueError(f"rows of {r['name']} aren't together")
                    seen.add(r["name"])
                    open_ = OpenArray(store, folder, r["name"], np.dtype(self.dtype))
                open_.add(r["row"], r["values"])
            if open_ is not None:
                done.append(open_.close())
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [n for n, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a name was written by several tasks")
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(root)):
                if f.base_name.endswith(".npy") and f.type == pafs.FileType.File:
                    store.delete_file(f.path)
        for name, at in files:
            store.move(at, f"{root.rstrip('/')}/{name}.npy")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        job = f"{root.rstrip('/')}/{self.job}"
        if store.get_file_info(job).type == pafs.FileType.Directory:
            store.delete_dir(job)


class OpenArray:
    """An array file whose number of rows is known when it is closed: rows first, then the header before them."""

    def __init__(self, store: pafs.FileSystem, folder: str, name: str, dtype: np.dtype) -> None:
        self.store, self.name, self.dtype, self.rows, self.width = store, name, dtype, 0, None
        if not name or "/" in name:
            raise ValueError(f"no name of a file: {name!r}")
        self.at = f"{folder}/{name}.npy"
        self.body = store.open_output_stream(f"{self.at}.rows")

    def add(self, row: int, values: list[float]) -> None:
        if row != self.rows or self.width not in (None, len(values)):
            raise ValueError(f"{self.name}: row {row} of {len(values)} values follows {self.rows} rows of {self.width}")
        self.width = len(values)
        self.rows += 1
        self.body.write(np.asarray(values, self.dtype).tobytes())

    def close(self) -> tuple[str, str]:
        self.body.close()
        said = f"{{'descr': '{self.dtype.str}', 'fortran_order': False, 'shape': ({self.rows}, {self.width}), }}"
        said = said.ljust(-(len(said) + 11) % 64 + len(said)) + "\n"
        with self.store.open_output_stream(self.at) as out, self.store.open_input_stream(f"{self.at}.rows") as rows:
            out.write(MAGIC + b"\x01\x00" + struct.pack("<H", len(said)) + said.encode("latin-1"))
            while block := rows.read(1 << 20):
                out.write(block)
        self.store.delete_file(f"{self.at}.rows")
        return self.name, self.at


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


def read_arrays(spark, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").options(**options).load(path)


def write_arrays(df: DataFrame, path: str, *, name: str = "name", row: str = "row", values: str = "values", dtype: str = "float64", mode: str = "append") -> None:
    """Write an array file for each name: rows in order of row, which numbers them from 0. An array is written by one task as its rows come by; none is held."""
    df.sparkSession.dataSource.register(NpySource)
    x = df.select(F.col(name).cast("string").alias("name"), F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("values"))
    x.repartition("name").sortWithinPartitions("name", "row").write.format("npy").option("dtype", dtype).mode(mode).save(path)
