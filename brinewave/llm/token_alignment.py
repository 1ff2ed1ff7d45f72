"""Alignment of two tokenizers' tokens, in Arrow: which ids stand for the same bytes, and how often over a corpus.

A is a byte-level BPE over a space and the text, B a piece model that adds the space itself. Both cut the same bytes; the
offsets where tokens of both end cut them into groups, and an A token is linked with every B token of its group.

In a task, the ids of some documents are one flat array with parent indices (list_flatten, list_parent_indices); ends of
tokens are cumulative sums of byte lengths less their document's start; an Acero hash join on (document, end) finds the
common ends, whose cumulative sums number the groups; groups of one token each are linked as they stand, others by a hash
join on the group of ids with their counts; `Table.group_by` sums a document's links of an id pair. Documents go on in
blocks of about BLOCK_BYTES of text. A block has a dictionary of its id pairs with the number of its documents that hold
each: these partial counts are all that is merged by Spark, and the merged ones come back to the block by its dictionary,
so no document's pairs are shuffled one by one.

Memory. A task holds PORTION bytes of text with tokens and links, or one longer text, and a block's documents as pairs
of numbers; links of groups of several tokens are made LINKS at a time. Each A id's highest count is broadcast: as many
rows as A has ids.

Defined cases. A null or empty text, and one whose joined tokens of A or B aren't the bytes of a space and the text (a
normaliser or an unknown character changed them), has no tokens: numbers are 0 and the digest is ''. A blank text is a
text as any other. Very long texts are taken whole. Each row is a document, also if doc_id repeats or is null. Ties: of
pairs with an A id's highest count all are best. An empty table gives no rows. doc_id and text are read and no other
column, so extra columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm.common import give_back, materialize, portions, short_batches, table

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
PORTION = 500_000  # bytes of text that are tokenized and aligned at once
BLOCK_BYTES = 8_000_000  # bytes of text of a block
LINKS = 2_000_000  # links of groups of several tokens that are made at once
SPACE = "▁"  # how B writes a space


# --- tokenizers


@lru_cache(maxsize=1)
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 for itself, the others in order from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer_a(path: str):
    """(function that encodes texts, the bytes of each id as an Arrow array) of a byte-level BPE file.

    Where the file's merges come in the order of their ids, they are ranks, and the faster library encodes by them; the
    pieces of a text are those of the byte-level pattern in either.
    """
    import json

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    entries, merges = said["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
    known = {i: s for s, i in entries.items()} | {t["id"]: t["content"] for t in said.get("added_tokens", [])}
    raw = [bytes(byte_of().get(c, 0x3F) for c in known.get(i, "")) for i in range(max(known) + 1)]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    ranked = plain.items() <= (said.get("pre_tokenizer") or {}).items() and not said.get("normalizer") and all(entries.get("".join(m)) == 256 + k for k, m in enumerate(merges))
    if ranked and len(entries) >= 256 + len(merges):
        import public_tokenizers
        import tiktoken

        encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={raw[i]: i for i in range(256 + len(merges))}, special_tokens={})
        return (lambda texts: [encoding.encode_ordinary(x) for x in texts]), pa.array(raw, pa.binary())
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return (lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]), pa.array(raw, pa.binary())


@lru_cache(maxsize=2)
def tokenizer_b(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        as_byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        raw.append(bytes([int(as_byte[1], 16)]) if as_byte else piece.replace(SPACE, " ").encode())
    return sp, pa.array(raw, pa.binary())


def encode_a(encode, texts: list[str]) -> pa.ListArray:
    return pa.array(encode([f" {x}" for x in texts]), pa.list_(pa.int32()))


def encode_b(sp, texts: list[str]) -> pa.ListArray:
    return pa.array(sp.encode(texts, num_threads=1), pa.list_(pa.int32()))


@lru_cache(maxsize=2)
def decimals(n: int) -> pa.Array:
    return pa.array([str(i) for i in range(n)])


# --- alignment of some documents


def sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def joined(lists: pa.ListArray, raw: pa.Array) -> pa.Array:
    """The bytes of each document's tokens, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets(sizes(lists)), raw.take(pc.list_flatten(lists))), b"")


def ends(lists: pa.ListArray, raw: pa.Array, name: str) -> pa.Table:
    """(doc, end, index) of every token: where it ends in its document."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int32())
    run = pc.cumulative_sum(pc.binary_length(raw.take(ids)).cast(pa.int64()))
    last = np.cumsum(sizes(lists))
    whole = np.concatenate([[0], run.to_numpy()[last[:-1] - 1]]) if len(last) else np.empty(0, np.int64)
    return pa.table({"doc": doc, "end": pc.subtract(run, pa.array(whole).take(doc)), name: pa.array(np.arange(len(ids), dtype=np.int32))})


def numbered(common: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n tokens, from the indices of those that end one."""
    last = np.zeros(n, np.int64)
    last[common] = 1
    return pc.cumulative_sum(pa.array(last)).to_numpy() - last


def counted(group: np.ndarray, ids: np.ndarray, name: str) -> pa.Table:
    t = pa.table({"group": group, name: ids, "one": np.ones(len(ids), np.int64)})
    return t.group_by(["group", name], use_threads=False).aggregate([("one", "sum")]).rename_columns(["group", name, f"{name}_n"])


def several(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray) -> Iterator[pa.Table]:
    """(group, a, a_n, b, b_n): ids that share a group of several tokens, with their numbers there."""
    left, right = counted(group_a, a, "a"), counted(group_b, b, "b")
    if not len(left):
        return
    widths = np.bincount(right.column("group").to_numpy(), minlength=int(group_a.max()) + 1)
    made = np.cumsum(widths[left.column("group").to_numpy()])
    at = 0
    while at < len(left):
        done = int(made[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(made, done + LINKS, side="right")))
        yield left.slice(at, end - at).join(right, keys="group", join_type="inner", use_threads=False)
        at = end


class Aligned:
    """What some valid documents have: numbers of each, digests, and (doc, pair, n) of their links; pair is A id * 2 ** 32 + B id."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, raw_a: pa.Array, raw_b: pa.Array) -> None:
        docs = len(a)
        self.n_a, self.n_b = sizes(a), sizes(b)
        common = ends(a, raw_a, "ia").join(ends(b, raw_b, "ib"), keys=["doc", "end"], join_type="inner", use_threads=False)
        ids_a, ids_b = pc.list_flatten(a), pc.list_flatten(b)
        group_a, group_b = numbered(common.column("ia").to_numpy(), len(ids_a)), numbered(common.column("ib").to_numpy(), len(ids_b))
        self.n_groups = np.bincount(common.column("doc").to_numpy(), minlength=docs)
        doc_of = np.repeat(np.arange(docs), self.n_groups)
        size_a, size_b = np.bincount(group_a, minlength=len(doc_of)), np.bincount(group_b, minlength=len(doc_of))
        self.n_links = np.bincount(doc_of, weights=size_a * size_b, minlength=docs).astype(np.int64)
        spelled = lambda ids, n, raw: pc.binary_join(pa.ListArray.from_arrays(offsets(n), decimals(len(raw)).take(ids)), ",")
        both = pc.binary_join_element_wise(spelled(ids_a, size_a, raw_a), spelled(ids_b, size_b, raw_b), "|")
        whole = pc.binary_join(pa.ListArray.from_arrays(offsets(self.n_groups), both), ";")
        self.digests = [hashlib.sha256(x.encode()).hexdigest() for x in whole.to_pylist()]
        x, y = ids_a.to_numpy().astype(np.int64), ids_b.to_numpy().astype(np.int64)
        one = (size_a == 1) & (size_b == 1)
        at = np.flatnonzero(one)
        one_a, one_b = one[group_a], one[group_b]
        parts = [pa.table({"doc": doc_of[at], "pair": x[one_a] << 32 | y[one_b], "n": np.ones(len(at), np.int64)})]
        for t in several(group_a[~one_a], x[~one_a], group_b[~one_b], y[~one_b]):
            pair = t.column("a").to_numpy() << 32 | t.column("b").to_numpy()
            part = pa.table({"doc": doc_of[t.column("group").to_numpy()], "pair": pair, "n": pc.multiply(t.column("a_n"), t.column("b_n"))})
            parts.append(self.summed(part))
        self.links = self.summed(pa.concat_tables(parts)).sort_by([("doc", "ascending"), ("pair", "ascending")])

    @staticmethod
    def summed(links: pa.Table) -> pa.Table:
        return links.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["doc", "pair", "n"])


# --- blocks

BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, pairs array<long>, holders array<int>"
SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())),
])


class Block:
    """Documents that share a dictionary of id pairs; a document's pairs are steps from one place in it to the next."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.numbers, self.digests = 0, [], [], []
        self.pairs, self.times, self.lengths = [], [], []

    def add(self, ids: list[int | None], texts: list[str | None], a, b) -> None:
        """Documents with their texts; a and b are (tokenizer, bytes of ids)."""
        some = [k for k, x in enumerate(texts) if x]
        said = [texts[k] for k in some]
        numbers, digests, lengths = np.zeros((len(texts), 4), np.int64), [""] * len(texts), np.zeros(len(texts), np.int64)
        if said:
            la, lb = encode_a(a[0], said), encode_b(b[0], said)
            expected = pa.array([f" {x}".encode() for x in said], pa.binary())
            valid = pc.and_(pc.equal(joined(la, a[1]), expected), pc.equal(joined(lb, b[1]), expected))
            at = np.array(some)[valid.to_numpy(zero_copy_only=False)]
            if len(at):
                found = Aligned(la.filter(valid), lb.filter(valid), a[1], b[1])
                numbers[at] = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links], axis=1)
                for k, x in zip(at.tolist(), found.digests, strict=True):
                    digests[k] = x
                lengths[at] = np.bincount(found.links.column("doc").to_numpy(), minlength=len(at))
                self.pairs.append(found.links.column("pair").to_numpy())
                self.times.append(found.links.column("n").to_numpy().astype(np.int32))
        self.bytes += sum(len(x) for x in said)
        self.ids += ids
        self.numbers.append(numbers)
        self.digests += digests
        self.lengths.append(lengths)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one with the dictionary: pairs, and how many documents hold each."""
        pairs = np.concatenate([np.empty(0, np.int64), *self.pairs])
        times = np.concatenate([np.empty(0, np.int32), *self.times])
        names, at, holders = np.unique(pairs, return_inverse=True, return_counts=True)
        lengths, numbers = np.concatenate(self.lengths), np.concatenate(self.numbers)
        starts = np.cumsum(lengths) - lengths
        steps = np.diff(at, prepend=0)
        first = starts[lengths > 0]
        steps[first] = at[first]
        n = len(self.ids)
        columns = [pa.array(np.full(n, number)), pa.array(self.ids, pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(self.digests, pa.string())]
        columns += [pa.ListArray.from_arrays(offsets(lengths), pa.array(x.astype(np.int32))) for x in (steps, times)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], schema=SCHEMA)
        last = {"block": [number], "pairs": [names], "holders": [holders.astype(np.int32)]}
        yield pa.RecordBatch.from_arrays([pa.array(last.get(f.name, [None]), f.type) for f in SCHEMA], schema=SCHEMA)


def blocks(path_a: str, path_b: str):
    """mapInArrow function of (doc_id, text): rows of blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer_a(path_a), tokenizer_b(path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block()
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in portions(batch.column("text"), PORTION):
                block.add(ids[at : at + len(texts)], texts, a, b)
                at += len(texts)
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows(number)
                    number, block = number + 1, Block()
        if block.ids:
            yield from block.rows(number)
        give_back()

    return of


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def weighed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a block with the sums of their links' counts; counts: (at, count, best) of the block's dictionary."""
    count, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    at = counts.column("at").to_numpy()
    count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
    lists = docs.column("steps").combine_chunks()
    n, steps = sizes(lists), pc.list_flatten(lists).to_numpy().astype(np.int64)
    times = pc.list_flatten(docs.column("times").combine_chunks()).to_numpy().astype(np.int64)
    run = np.cumsum(steps)
    starts = np.cumsum(n) - n
    base = np.concatenate([[0], run])[starts]  # what earlier documents have stepped
    place = run - np.repeat(base, n)
    total = lambda w: np.concatenate([[0], np.cumsum(w * times)])
    best_sum, count_sum = ((t := total(w[place]))[starts + n] - t[starts] for w in (best, count))
    named = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(named | {"n_best": best_sum, "count_sum": count_sum, "groups_sha256": docs.column("groups_sha256")})


def align(documents: DataFrame, *, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): numbers of tokens, groups and links of every row of documents, and (a, b, count, best) of every id pair that is linked."""
    import public_tokenizers

    short_batches(documents.sparkSession)
    path_a, path_b = path_a or public_tokenizers.path(A_NAME), path_b or public_tokenizers.path(B_NAME)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks(str(path_a), str(path_b)), BLOCKS)
    rows = materialize(rows, "aligned")
    named = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    counts = materialize(named.groupBy("pair").agg(F.sum("holders").alias("count")), "pair-counts")
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("count").alias("highest"))  # a row for each id of A
    counts = counts.withColumn("a", first).join(F.broadcast(highest), "a").select("a", "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = named.select(F.col("block").alias("of"), "at", "pair").join(counts.drop("a"), "pair").select("of", "at", "count", "best")
    docs = rows.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times")
    out = docs.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(weighed, RESULT)
    return out, counts.select("a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count", "best")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
