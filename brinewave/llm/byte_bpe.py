"""Byte-level BPE encoding and decoding with a segment tree.

Each piece of text is a sequence of bytes. A segment tree over its byte positions keeps the leftmost of the lowest
ranks of neighbouring pairs; its root is the next merge. A merge changes three leaves (the merged pair, the pair before
it, the position that dies), so it costs three logarithmic updates. Pieces of similar length are merged side by side as
rows of one array; long pieces take the same tree by themselves.

Defined cases. Null and empty texts have no tokens and decode to no bytes. Texts and pieces of any length are encoded
whole. Of pairs of equal rank the leftmost merges first. An empty table gives no rows. Repeated texts get equal ids. Other columns are kept; the outputs replace columns of the same names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from brinewave.llm.common import give_back, portions, short_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_BYTES = 24 << 20  # of each of a worker's two generations of remembered stretches, with what Python adds to each
PLAIN = ".,;:!?%&*$#|()-\""  # punctuation that ends a stretch as one piece
SIDE_BY_SIDE = 64  # bytes of the longest piece that is merged among others
NONE = np.int64(1) << 60

#: Unicode's white space, as the pattern's \s means it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the pattern crosses the borders of these stretches, so each can be encoded, and remembered, by itself.
STRETCH = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Bpe:
    """Encodes and decodes by a table of byte strings and ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.base = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pairs = pairs
        self.hash_pairs()
        self.bytes_of = [b""] * self.base
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ids = list(range(self.base))  # one object for each id, which all remembered stretches share
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        lines = Path(path).read_bytes().split(b"\n")
        return cls({base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}, pattern)

    def forget(self) -> None:
        """Drop all remembered stretches."""
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0  # bytes that cache takes, about

    def hash_pairs(self) -> None:
        """Lay the pairs out for vectorised look-up: open addressing, at most half full."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        slot = self.slot_of(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            win = np.zeros(len(keys), bool)
            win[first] = True
            win &= free
            self.keys[slot[win]], self.values[slot[win]] = keys[win], values[win]
            keys, values, slot = keys[~win], values[~win], (slot[~win] + 1) & self.mask

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, NONE where there is no such token."""
        key = left * self.base + right
        slot = self.slot_of(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == key[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def merge_many(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Merge pieces of 2 to width bytes side by side; width is a power of two."""
        flat, size = self.merge_flat(pieces, width)
        ends, flat = np.cumsum(size).tolist(), list(map(self.ids.__getitem__, flat.tolist()))
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]  # noqa: B905

    def merge_flat(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The same as (ids of all pieces one after the other, how many each has)."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        token = self.single[data]
        token[place >= size[:, None]] = -1
        after = np.where(place + 1 < size[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        row, col = np.nonzero(place + 1 < size[:, None])
        rank = self.rank_of(token[row, col], token[row, col + 1])
        tree[row, width + col] = np.where(rank < NONE, rank * width + col, NONE)  # the position breaks ties: leftmost first
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, new = root % width, root // width
            gone = after[live, at]
            then = after[live, gone]
            token[live, at], token[live, gone] = new, -1
            after[live, at] = then
            more = then < width
            before[live[more], then[more]] = at[more]
            tree[live, width + gone] = NONE
            value = np.full(len(live), NONE)
            rank = self.rank_of(new[more], token[live[more], then[more]])
            value[more] = np.where(rank < NONE, rank * width + at[more], NONE)
            tree[live, width + at] = value
            first = before[live, at]
            has = first >= 0
            r, p = live[has], first[has]
            rank = self.rank_of(token[r, p], new[has])
            tree[r, width + p] = np.where(rank < NONE, rank * width + p, NONE)
            rows, nodes = np.concatenate([live, live, r]), (width + np.concatenate([gone, at, p])) >> 1
            while nodes[0] >= 1:
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
                nodes >>= 1
            live = live[tree[live, 1] < NONE]
        kept = token >= 0
        return token[kept], kept.sum(axis=1)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one piece of any length."""
        n, width, none = len(piece), 1 << max(1, (len(piece) - 1).bit_length()), int(NONE)
        token = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, base = self.pairs, self.base
        tree = [none] * (2 * width)

        def value(i: int) -> int:
            j = after[i]
            rank = pairs.get(token[i] * base + token[j], none) if j < n else none
            return rank * width + i if rank < none else none

        for i in range(n):
            tree[width + i] = value(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, v: int) -> None:
            k = width + i
            tree[k] = v
            k >>= 1
            while k:
                m = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == m:
                    break
                tree[k] = m
                k >>= 1

        while tree[1] < none:
            new, at = divmod(tree[1], width)
            gone = after[at]
            token[at], token[gone] = new, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, value(at))
            if before[at] >= 0:
                put(before[at], value(before[at]))
        return tuple(t for t in token if t >= 0)

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct pieces, each by itself."""
        out: dict[bytes, tuple[int, ...]] = {}
        by: dict[int, list[bytes]] = {}
        for x in pieces:
            if (whole := self.ranks.get(x)) is not None:
                out[x] = (whole,)
            elif len(x) > SIDE_BY_SIDE:
                out[x] = self.merge_long(x)
            else:
                by.setdefault(max(4, 1 << (len(x) - 1).bit_length()), []).append(x)
        for width, same in by.items():
            for k in range(0, len(same), 8192):
                out.update(zip(same[k : k + 8192], self.merge_many(same[k : k + 8192], width), strict=True))
        return out

    def encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has), without a Python object for each piece."""
        whole = np.array([-1 if r is None else r for r in map(self.ranks.get, pieces)], np.int64)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = np.ones(len(pieces), np.int64)
        width = np.where(whole >= 0, 0, np.where(length > SIDE_BY_SIDE, -1, np.maximum(4, 2 ** np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))))
        done = [(np.flatnonzero(width == 0), whole[width == 0])]
        for k in np.unique(width[width != 0]).tolist():
            at = np.flatnonzero(width == k)
            for some in np.array_split(at, -(-len(at) // 8192)):
                mine = [pieces[i] for i in some.tolist()]
                if k < 0:
                    rows = list(map(self.merge_long, mine))
                    flat, size[some] = np.fromiter(chain.from_iterable(rows), np.int64), list(map(len, rows))
                else:
                    flat, size[some] = self.merge_flat(mine, k)
                done.append((some, flat))
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for some, flat in done:
            n = size[some]
            out[np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return out, size

    def split(self, stretch: str) -> list[str]:
        """The pattern's matches. A run of letters, with a space before and plain punctuation after it, needs no regular expression."""
        word = stretch[1:] if stretch[0] == " " else stretch
        if word.isalpha():
            return [stretch]
        bare = word.rstrip(PLAIN)
        if bare.isalpha():
            k = len(stretch) - len(word) + len(bare)
            return [stretch[:k], stretch[k:]]
        return self.pattern.findall(stretch)

    def learn_stretches(self, new: Iterable[str]) -> None:
        """Put stretches of text into the memory."""
        split = {s: [m.encode("utf-8", "surrogatepass") for m in self.split(s)] for s in new}
        ids = self.encode_pieces(set(chain.from_iterable(split.values())))
        for s, pieces in split.items():
            self.cache[s] = own = ids[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(ids[p] for p in pieces))
            self.held += 200 + len(s) + 8 * len(own)

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts."""
        if self.held > CACHE_BYTES:  # what isn't used again in a generation is forgotten
            self.cache, self.older, self.held = {}, self.cache, 0
        cut = [STRETCH.findall(x) if x else [] for x in texts]
        new = set(chain.from_iterable(cut)).difference(self.cache)
        known = new.intersection(self.older)
        self.cache.update(zip(known, map(self.older.__getitem__, known), strict=True))
        self.held += 200 * len(known)
        self.learn_stretches(new - known)
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Bpe:
    """One coder for each worker process, kept between tasks; what it remembers of texts goes with the task."""
    return Bpe.load(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def id_lists(rows: list[list[int]]) -> pa.Array:
    flat = np.fromiter(chain.from_iterable(rows), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32)), pa.array(flat))


def encode(text: Column, path: str, pattern: str) -> Column:
    """ids array<int> of a text column."""

    @arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        try:
            for some in chain.from_iterable(map(portions, batches)):
                yield id_lists(bpe.encode_texts(some))
        finally:
            bpe.forget()
            give_back()

    return ids_of(text)


def decoded_rows(bpe: Bpe, ids: pa.Array) -> pa.Array:
    flat, ends = ids.flatten().to_numpy().tolist(), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()]).tolist()
    return pa.array([bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for, as binary; null ids decode to no bytes."""

    @arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        for rows in batches:
            yield decoded_rows(bpe, rows)

    return bytes_of(ids)


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents with ids and the bytes decoded from these ids; both in one pass through one worker."""

    @arrow_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = coder(path, pattern)
        try:
            for some in chain.from_iterable(map(portions, batches)):
                ids = id_lists(bpe.encode_texts(some))
                yield pa.StructArray.from_arrays([ids, decoded_rows(bpe, ids)], ["ids", "decoded"])
        finally:
            bpe.forget()
            give_back()

    coded = documents.withColumn("__coded", both(F.col("text")))
    return coded.withColumns({"ids": F.col("__coded.ids"), "decoded": F.col("__coded.decoded")}).drop("__coded")


def digests(coded: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_vocabulary()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's digests of ids and of the decoded bytes. Nulls, blanks, long texts, repeated rows and empty tables as in the module."""
    short_batches(spark)
    return digests(round_trip(docs.select("doc_id", "text"), *default_vocabulary()))
