"""WARC archives with a two-level capture index.

`write_archives` writes one gzip member for each page into archives in the shared folder; pages whose payload another
page already has become revisit records. `build_index` sorts the captures by reversed-host URL key, writes them as
compressed blocks of lines, and beside each index part a sparse directory with the first key of every block. `lookup`
finds keys: a binary search over the parts' bounds, then over a part's directory, then within a block, and only then
range reads of the archives.

Files are named anew by each attempt of a task, and only names that a finished task has returned are ever read.

Defined cases. A null html is an empty payload; a null url has the key ")". Of rows that repeat a page_id within a group
of equal payloads all those with the smallest page_id are responses. A group without any page_id holds responses only; a row without page_id
in another group is a revisit. Very long pages are one record each, compressed in one piece. An empty table gives no archives. Only the named columns are archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from brinewave.llm.common import fresh_path, materialize, table

LEAST_SHARED = 100  # bytes of a payload from which a copy is a revisit
BLOCK_LINES = 512
READ_BYTES = 32 << 20  # of the archives that one task of a lookup reads, about
OPEN_FILES = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, archive string, offset long, length long"
DIRECTORY = "part string, first_key string, last_key string, n_blocks long, n_lines long"
RECORD = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def key_of(url: Column) -> Column:
    """Reversed host, closing bracket, path and query: com,example,www)/path?query; white space and controls become %20."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), path)
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def decided(pages: DataFrame) -> DataFrame:
    """The pages with payload_digest, record_type and refers_to.

    Only digests that occur more than once are joined back; what is joined is one row per digest, and adaptive
    execution splits the pages of a digest that many have.
    """
    p = pages.withColumn("payload_digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    long_ = F.octet_length("html") >= LEAST_SHARED
    first = p.where(long_).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    out = p.join(first.drop("n"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Record-ID: <urn:page:{page_id}>"] if page_id is not None else [f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of an uncompressed record; raises where lengths don't agree."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archive decided pages; returns the captures, materialized: (key, page_id, archive, offset, length)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"archive-{uuid.uuid4().hex}.warc.gz", None, 0
        for pdf in batches:
            rows = []
            for key, pid, url, html, digest, kind, ref in pdf[["key", "page_id", "url", "html", "payload_digest", "record_type", "refers_to"]].itertuples(index=False, name=None):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                whole = lambda v: None if v is None or pd.isna(v) else int(v)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = gzip.compress(record(whole(pid), url, payload, digest, kind, whole(ref)), 6, mtime=0)
                out.write(member)
                rows.append((key, whole(pid), name, at, len(member)))
                at += len(member)
            df = pd.DataFrame(rows, columns=["key", "page_id", "archive", "offset", "length"])
            yield df.astype({"page_id": "Int64", "offset": "int64", "length": "int64"})
        if out:
            out.close()

    return materialize(pages.withColumn("key", key_of(F.col("url"))).mapInPandas(write, CAPTURE), "captures")


@dataclass(frozen=True)
class Index:
    """folder: where archives and index parts lie; parts: (part, first key, last key) in order; size: bytes of the archives."""

    folder: str
    parts: tuple[tuple[str, bytes, bytes], ...]
    size: int = 0


def build_index(captures: DataFrame, folder: str, *, block_lines: int = BLOCK_LINES) -> Index:
    """Sort the captures into index parts of compressed blocks, each part with its sparse directory.

    The range partitioning sorts by key and page, so that a URL with very many captures is dealt to several parts.
    The driver gets one row for each part.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        name, out, at, n = f"index-{uuid.uuid4().hex}", None, 0, 0
        entries: list[tuple[str, int, int]] = []
        lines: list[tuple[str, str]] = []
        last = ""

        def flush() -> None:
            nonlocal at, n, lines, last
            block = zlib.compress("\n".join(f"{k} {v}" for k, v in lines).encode(), 6)
            out.write(block)
            entries.append((lines[0][0], at, len(block)))
            at, n, last, lines = at + len(block), n + len(lines), lines[-1][0], []

        for pdf in batches:
            for key, archive, offset, length in pdf[["key", "archive", "offset", "length"]].itertuples(index=False, name=None):
                out = out or store.open_output_stream(f"{root}/{name}.blocks", compression=None)
                lines.append((key, json.dumps([archive, int(offset), int(length)])))
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with store.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(entries).encode()))
            yield pd.DataFrame([(name, entries[0][0], last, len(entries), n)], columns=["part", "first_key", "last_key", "n_blocks", "n_lines"])

    ordered = captures.repartitionByRange("key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    parts = materialize(ordered.mapInPandas(write, DIRECTORY), "index").collect()
    utf8 = lambda s: s.encode()  # noqa: E731  UTF-8 bytes sort as Spark sorts strings
    return Index(folder, tuple(sorted(((p.part, utf8(p.first_key), utf8(p.last_key)) for p in parts), key=lambda p: (p[1], p[2]))), captures.agg(F.sum("length")).first()[0] or 0)


class Reader:
    """Reads directories, blocks and archive ranges; keeps a few files open."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = filesystem(folder)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.part, self.entries, self.firsts = None, [], []
        self.block, self.keys, self.values = None, [], []

    def range(self, name: str, offset: int, length: int) -> bytes:
        f = self.files.pop(name, None) or self.store.open_input_file(f"{self.root}/{name}")
        self.files[name] = f
        if len(self.files) > OPEN_FILES:
            self.files.popitem(last=False)[1].close()
        return f.read_at(length, offset)

    def turn_to(self, part: str) -> None:
        if part != self.part:
            with self.store.open_input_file(f"{self.root}/{part}.dir") as f:
                self.entries = json.loads(zlib.decompress(f.read()))
            self.part, self.firsts, self.block = part, [e[0].encode() for e in self.entries], None

    def find(self, part: str, key: bytes) -> Iterator[tuple[str, int, int]]:
        """Captures of a key in a part."""
        self.turn_to(part)
        low = max(0, bisect_left(self.firsts, key) - 1)  # the block before may end with the key
        for b in range(low, bisect_right(self.firsts, key)):
            if self.block != b:
                _, at, size = self.entries[b]
                lines = zlib.decompress(self.range(f"{part}.blocks", at, size)).split(b"\n")
                split = [x.partition(b" ") for x in lines]
                self.block, self.keys, self.values = b, [s[0] for s in split], [s[2] for s in split]
            for k in range(bisect_left(self.keys, key), bisect_right(self.keys, key)):
                yield tuple(json.loads(self.values[k]))


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """The records of every capture of the distinct keys in column key, read from the archives."""
    spark = keys.sparkSession
    if not index.parts:
        return spark.createDataFrame([], RECORD)
    names, firsts, lasts = ([p[k] for p in index.parts] for k in range(3))

    @pandas_udf("array<int>")
    def parts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            found = []
            for key in some:
                k = key.encode()
                found.append(list(range(bisect_left(lasts, k), bisect_right(firsts, k))))
            yield pd.Series(found)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(index.folder)
        for pdf in batches:
            rows = []
            for part, key in pdf[["part", "key"]].itertuples(index=False, name=None):
                for archive, offset, length in reader.find(names[part], key.encode()):
                    raw = zlib.decompress(reader.range(archive, offset, length), 31)
                    rows.append((key, *read_record(raw)))
                    if len(rows) >= 2000:
                        yield frame(rows)
                        rows = []
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["key", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return df.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    placed = keys.select("key").distinct().withColumn("part", F.explode(parts_of(F.col("key"))))
    # As many ranges of parts and keys as the archives' bytes ask for: the rows here are small, what they read isn't.
    tasks = max(1, -(-index.size // READ_BYTES))
    return placed.repartitionByRange(tasks, "part", "key").sortWithinPartitions("part", "key").mapInPandas(read, RECORD)


def read_record(raw: bytes) -> tuple[int | None, str, int, str, str, int | None]:
    """(page_id, url, payload bytes, payload digest, type, refers_to) of a record; a response's digest is computed from its payload."""
    fields, http, payload = parse_record(raw)
    page = lambda name: int(fields[name][10:-1]) if fields.get(name, "").startswith("<urn:page:") else None
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != said:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    else:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = said
    return page("WARC-Record-ID"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], page("WARC-Refers-To")


def open_archive(data: bytes) -> Iterator[bytes]:
    """The records of a whole archive, one after the other."""
    at = io.BytesIO(data)
    while at.tell() < len(data):
        d = zlib.decompressobj(31)
        rest = data[at.tell() :]
        yield d.decompress(rest)
        at.seek(len(data) - len(d.unused_data))


def archive(pages: DataFrame, folder: str | None = None) -> Index:
    """Archive pages and index the archives."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    captures = write_archives(decided(pages), folder)
    return build_index(captures, folder)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = archive(pages)
    found = lookup(pages.select(key_of(F.col("url")).alias("key")), index)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"))


OP3_SQL = r"""
with p as (
  select page_id, url, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, '')) as payload_bytes from pages
), f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1
), r as (
  select page_id, payload_bytes, p.payload_digest, case when first is not null and page_id is distinct from first then first end as refers_to,
         regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') as rest
  from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 100
)
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to,
       array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as url_key
from r
"""
