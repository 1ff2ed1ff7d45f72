"""Language-model scoring: causal self-attention over subword ids, in numpy.

Words are encoded to subword ids of a public vocabulary. A small causal self-attention model predicts the class of the
next id; counts give the id within its class, inside a word given the id before it. Long texts are scored in
overlapping windows, in batches of masked attention: each id is scored once, with at least OVERLAP ids before it in its
window unless the text begins there. The ids' probabilities multiply to those of words, given that a word begins and
ends there, and each word's is mixed with its share of the training tokens:

    P(word) = MIX * count / tokens + (1 - MIX) * P(ids of the word | context)

What comes from the corpus: word counts of all training texts, by Spark; counts of all subword ids, from each distinct
word once; attention weights by rounds of local steps on all training texts, each shard by itself, averaged after each
round. Each row trains in one of the rounds. The classes come from the counts of all ids and of
their neighbours and borders within words. The network's input are the ids themselves, in INPUTS rows by their remainder.

An id either begins a word (or ends the text) or stands within one. The share of its side in its class, the share of the
id on that side and, within words, the counts of pairs make a distribution: in any context the probabilities of all ids
sum to one, and those of all words and the end to no more than one. The base isn't such a distribution, as it gives each
of any number of unseen words the same share.

The base score is an add-one unigram over words. The TOP_WORDS most frequent words' counts travel to the tasks; the
occurrences of all others are joined to the counts by word, and none of those words can be more than one in TOP_WORDS
of the tokens, so that join has no hot key.

Training is by shards of about SHARD_IDS ids. The hash of a row's text and doc_id gives its round, its shard and its place
there; the number of shards and of passes over the texts (1 to PASSES) comes from the count of all ids. So scores don't
depend on how the table is cut, up to the last digits of sums. Copies with doc_ids of their own spread over the shards;
rows equal in both share one, which costs a task time but no memory.

Defined cases. A null or empty text is the end token alone. Without training texts, as with an empty table of documents,
all counts are 0 and the model is uniform; an empty table gives no rows. A null doc_id is not held out. Repeated rows get
equal scores. Very long texts are scored whole, in windows. Of words and ids with equal counts at a cut-off all are taken
or none. Only doc_id and text are read, so extra columns and their names don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm.byte_bpe import SPACE, coder, default_vocabulary
from brinewave.llm.common import fold, give_back, materialize, most_frequent, table

TOP_WORDS = 50_000
ROUNDS = 2
SHARD_IDS = 16_000_000  # ids of a shard's texts in a round, about; the shards' weights are averaged
STEP_WINDOWS = 96
LEAST_STEPS = 400  # local steps of a shard and round to aim at: where all training texts are few, they are passed over more than once
PASSES = 8  # and so often at most
PAIRS = 400_000  # pairs of neighbouring ids within words whose counts travel to the tasks; those of all others are joined by word
CLASSES, SINGLE = 64, 40  # classes; those of one id each
WIDTH, HIDDEN = 16, 16
INPUTS = 2_048  # rows of the table of embeddings
WINDOW, OVERLAP = 32, 8
MIX = 0.3
CACHE = 250_000
GROUP_CHARS = 200_000
FRACTION = 0.5  # added to each id's count within its class
ODD = re.compile(f"[{SPACE.replace(' ', '')}\ud800-\udfff]")  # what keeps a word from being encoded beside others
BACKOFF = 5.0  # weight of the class's own distribution against a pair's counts


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts one after the other, as bytes; how many each text has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    some = pc.binary_length(words).to_numpy() > 0
    return words.filter(pa.array(some)).cast(pa.binary()), np.bincount(text[some], minlength=len(texts))


def text_groups(batches: Iterator[pa.Array], chars: int = GROUP_CHARS) -> Iterator[pa.Array]:
    """Consecutive texts of about so many characters together; null is the empty text."""
    held, size = [], 0
    for texts in batches:
        texts = pc.fill_null(texts, "")
        ends, at = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64)), 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + chars - size)) + 1
            held.append(texts.slice(at, min(end, len(texts)) - at))
            size += int(ends[min(end, len(texts)) - 1]) - before
            if end <= len(texts):
                yield pa.concat_arrays(held)
                held, size = [], 0
            at = end
    if held:
        yield pa.concat_arrays(held)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts a task sees, summed before the shuffle."""
    held, rows = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).select(["word", "n"])

    for texts in text_groups((batch.column("text") for batch in batches), 10 * GROUP_CHARS):
        counts = split(texts)[0].value_counts()
        held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
        rows += len(counts)
        if rows > 800_000:
            held = [summed()]
            rows = len(held[0])
            if rows > 400_000:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from summed().to_batches()
    held.clear()
    give_back()


def larger(batches: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about so many."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class Slots(dict[bytes, int]):
    """Slot of each word, from 1. A word that isn't there gets the next slot when it is looked up, and is put into new."""

    def __init__(self, known: dict[bytes, int]) -> None:
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self) + 1
        self.new.append(word)
        return slot


def put(column: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The column with values from place at on. It doubles when it is full, so adding words doesn't copy all that are there."""
    if at + len(values) > len(column):
        column = np.concatenate([column[:at], np.zeros(at + 2 * len(values), column.dtype)])
    column[at : at + len(values)] = values
    return column


@lru_cache(maxsize=2)
def library_coder(path: str, pattern: str):
    """The library's encoder by the same ranks, one for each worker process."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=coder(path, pattern).ranks, special_tokens={})


class Encoder:
    """Subword ids of words, each word by itself with a space before it. Slot 0 is the end of a text, as a word of one id.

    fixed: what the count model gives a word, from its ids; counts: frequent words, which are never forgotten; extra: what
    pairs of ids that aren't in fixed add to these. A word gets its slot when it is first met; the words that are new in
    some texts are encoded together.
    """

    def __init__(self, path: str, pattern: str, fixed: Fixed | None = None, counts: dict[bytes, int] | None = None, extra: dict[bytes, float] | None = None) -> None:
        self.bpe, self.library, self.of = coder(path, pattern), library_coder(path, pattern), fixed
        self.end = self.bpe.base  # an id of its own for the end of a text
        self.begins = np.array([t[:1] == b" " for t in self.bpe.bytes_of])
        self.slot, self.n_ids = Slots({}), 1
        self.ids, self.size, self.start = np.array([self.end], np.int32), np.array([1]), np.array([0])
        self.fixed, self.count = np.zeros(1), np.array([np.nan])
        frequent = list(counts or {})
        for k in range(0, len(frequent), 20_000):
            self.learn(frequent[k : k + 20_000])
        if counts:
            self.count[1 : len(frequent) + 1] = list(counts.values())
        if extra:
            self.fixed[1 : len(frequent) + 1] += [extra.get(w, 0.0) for w in frequent]
        self.frequent, self.frequent_ids = dict(self.slot), self.n_ids

    def reset(self) -> None:
        """Forget all words but the frequent ones."""
        self.slot, self.n_ids = Slots(self.frequent), self.frequent_ids

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words one after the other, how many each has). They are encoded as one text: where no word has white
        space, no piece crosses a word's border, and an id begins a word just where its bytes begin with a space."""
        flat = self.library.encode_to_numpy((b" " + b" ".join(words)).decode()).astype(np.int32)
        return flat, np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))

    def apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words with Unicode's other white space or surrogates, each by itself."""
        pieces = [[p.encode("utf-8", "surrogatepass") for p in self.bpe.split(f" {w.decode('utf-8', 'surrogatepass')}")] for w in words]
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat, each = self.bpe.encode_flat(list(chain.from_iterable(pieces)))
        return flat, np.add.reduceat(each, np.cumsum(count) - count)

    def add(self, words: list[bytes], at: int) -> None:
        """Fill the slots of words, from at on."""
        odd = np.zeros(len(words), bool)
        if ODD.search(b" ".join(words).decode("utf-8", "surrogatepass")):
            odd[:] = [ODD.search(w.decode("utf-8", "surrogatepass")) is not None for w in words]
        size, start, fixed = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words))
        for some, encode in ((np.flatnonzero(~odd), self.together), (np.flatnonzero(odd), self.apart)):
            if len(some):
                flat, own = encode([words[i] for i in some.tolist()])
                first = np.cumsum(own) - own
                size[some], start[some] = own, first + self.n_ids
                if self.of:
                    fixed[some] = self.of.words(flat, first, own)
                self.ids, self.n_ids = put(self.ids, self.n_ids, flat), self.n_ids + len(flat)
        self.size, self.start, self.fixed = put(self.size, at, size), put(self.start, at, start), put(self.fixed, at, fixed)
        self.count = put(self.count, at, np.full(len(words), np.nan))

    def learn(self, words: list[bytes]) -> None:
        """Give words slots, in their order."""
        at = len(self.slot) + 1
        self.slot.update(zip(words, range(at, at + len(words)), strict=True))
        self.add(words, at)

    def slots(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """Slots of the words of some texts one after the other, each text preceded by the end; counts: words of each text."""
        if len(self.slot) > CACHE + len(self.frequent):
            self.reset()
        coded, at = words.dictionary_encode(), len(self.slot) + 1
        own = np.fromiter(map(self.slot.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        if self.slot.new:
            self.add(self.slot.new, at)
            self.slot.new = []
        out = np.zeros(len(words) + len(counts), np.int64)
        place = np.ones(len(out), bool)
        place[np.cumsum(counts) - counts + np.arange(len(counts))] = False
        out[place] = own[coded.indices.to_numpy()]
        return out

    def expand(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first place of each slot)."""
        size = self.size[slots]
        first = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[slots] - first, size) + np.arange(int(size.sum()))], first

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, lengths)."""
        slots = self.slots(*split(texts))
        ids, first = self.expand(slots)
        return ids, np.diff(np.append(first[slots == 0], len(ids)))


@dataclass
class Network:
    """One block of causal self-attention over embeddings of ids; flat keeps all weights in one vector."""

    flat: np.ndarray

    SHAPES = (("e", (INPUTS, WIDTH)), ("p", (WINDOW, WIDTH)), ("qkv", (WIDTH, 3 * WIDTH)), ("o", (WIDTH, WIDTH)), ("u", (WIDTH, HIDDEN)), ("v", (HIDDEN, WIDTH)), ("w", (WIDTH, CLASSES)), ("b", (1, CLASSES)))
    SIZE = sum(a * b for _, (a, b) in SHAPES)
    MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    @classmethod
    def fresh(cls, log_share: np.ndarray, seed: int = 11) -> Network:
        """Small random weights; the output's bias starts at the classes' log shares."""
        net = cls(np.random.default_rng(seed).normal(0, 0.15, cls.SIZE).astype(np.float32))
        net.part("w")[:] *= 0.3
        net.part("b")[0] = log_share
        return net

    def part(self, name: str) -> np.ndarray:
        at = 0
        for n, shape in self.SHAPES:
            size = shape[0] * shape[1]
            if n == name:
                return self.flat[at : at + size].reshape(shape)
            at += size
        raise KeyError(name)

    def attend(self, inputs: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
        """Hidden states (windows, WINDOW - skip, WIDTH) of rows of embeddings (windows, WINDOW) from place skip on, and what the gradient needs."""
        x = self.part("e").take(inputs, axis=0)
        x += self.part("p")
        qkv = (x.reshape(-1, WIDTH) @ self.part("qkv")).reshape(*inputs.shape, 3 * WIDTH)
        q, k, v = (qkv[..., i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        if skip:
            x, q = np.ascontiguousarray(x[:, skip:]), q[:, skip:]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a *= np.float32(1 / math.sqrt(WIDTH))
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= self.MASK[skip:]
        a *= 1 / np.matmul(a, np.ones((WINDOW, 1), np.float32))
        c = np.matmul(a, v)
        h = (c.reshape(-1, WIDTH) @ self.part("o")).reshape(x.shape)
        h += x
        r = h.reshape(-1, WIDTH) @ self.part("u")
        np.maximum(r, 0, out=r)
        out = (r @ self.part("v")).reshape(x.shape)
        out += h
        return out, x, q, k, v, a, c, h, r

    def log_probs(self, hidden: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log p(class) of one target for each hidden state, log probability that a word begins or the text ends there)."""
        logits = hidden @ self.part("w")
        logits += self.part("b")
        np.clip(logits, -60, 60, out=logits)
        picked = logits[np.arange(len(targets)), targets]
        np.exp(logits, out=logits)
        both = logits @ np.stack([np.ones(CLASSES, np.float32), begins], axis=1)
        return picked - np.log(both[:, 0]), np.log(np.maximum(both[:, 1], 1e-30) / both[:, 0])

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss over the live places of some windows."""
        out, x, q, k, v, a, c, h, r = self.attend(inputs)
        g = Network(np.zeros_like(self.flat))
        flat = lambda y: y.reshape(-1, WIDTH)
        p = flat(out) @ self.part("w")
        p += self.part("b")
        np.clip(p, -60, 60, out=p)
        np.exp(p, out=p)
        p *= live.reshape(-1, 1) / (max(1, int(live.sum())) * p.sum(axis=1, keepdims=True))
        at = np.flatnonzero(live)
        p[at, targets.ravel()[at]] -= np.float32(1 / max(1, len(at)))
        g.part("w")[:] = flat(out).T @ p
        g.part("b")[0] = p.sum(axis=0)
        d = p @ self.part("w").T
        g.part("v")[:] = r.T @ d
        dr = d @ self.part("v").T
        dr *= r > 0
        g.part("u")[:] = flat(h).T @ dr
        d += dr @ self.part("u").T
        g.part("o")[:] = flat(c).T @ d
        dc = (d @ self.part("o").T).reshape(x.shape)
        ds = np.matmul(dc, v.transpose(0, 2, 1))
        ds -= np.einsum("bij,bij->bi", dc, c)[..., None]  # the rows of a sum to one
        ds *= a
        ds *= np.float32(1 / math.sqrt(WIDTH))
        dqkv = np.concatenate([np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dc)], axis=2)
        g.part("qkv")[:] = flat(x).T @ dqkv.reshape(-1, 3 * WIDTH)
        d += dqkv.reshape(-1, 3 * WIDTH) @ self.part("qkv").T
        g.part("p")[:] = d.reshape(x.shape).sum(axis=0)
        place, rows = inputs.ravel(), np.ascontiguousarray(d.T, float)
        g.part("e")[:] = np.stack([np.bincount(place, weights=row, minlength=INPUTS) for row in rows], axis=1)
        return g.flat


def windows(lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, places, first scored place) of the windows over texts that lie one after the other.

    Every place is scored in one window: in the text's first window, or else in that which has it past the overlap.
    """
    stride = WINDOW - overlap
    count = np.maximum(1, -(-(lengths - overlap) // stride))
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * stride
    size = np.minimum(WINDOW, lengths[text] - start)
    return (np.cumsum(lengths) - lengths)[text] + start, size, np.where(nth == 0, 0, overlap)


@dataclass
class Fixed:
    """Count model of ids within their classes. A class has two sides: ids that begin a word or end a text, and inner
    ids. log_side: by id, the share of its side in its class; log_within: by id, its share of that side; keys,
    pair_counts: pairs of neighbours within words, as id << 20 | next id in order; class_keys, class_counts: the same
    summed as id << 20 | class of the next, which is always an inner id."""

    class_of: np.ndarray
    log_side: np.ndarray
    log_within: np.ndarray
    keys: np.ndarray
    pair_counts: np.ndarray
    class_keys: np.ndarray
    class_counts: np.ndarray

    @classmethod
    def of(cls, class_of: np.ndarray, log_side: np.ndarray, log_within: np.ndarray, keys: np.ndarray, counts: np.ndarray, totals: tuple[np.ndarray, np.ndarray] | None = None) -> Fixed:
        """totals: class_keys and class_counts of all pairs, where keys are only some."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        if totals is not None:
            order = np.argsort(totals[0])
            return cls(class_of, log_side, log_within, keys, counts, totals[0][order], totals[1][order])
        by_class, at = np.unique((keys >> 20) << 20 | class_of[keys & (1 << 20) - 1].astype(np.int64), return_inverse=True)
        return cls(class_of, log_side, log_within, keys, counts, by_class, np.bincount(at, weights=counts, minlength=len(by_class)) if len(keys) else np.zeros(0))

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], 0.0)

    def words(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log p(ids | their classes, and for inner ids the ids before them) of words that lie one after the other."""
        out = self.log_within[ids].astype(float)
        inner = np.ones(len(ids), bool)
        inner[start] = False
        here = np.flatnonzero(inner)
        before, now = ids[here - 1].astype(np.int64) << 20, ids[here].astype(np.int64)
        pair = self.look(self.keys, self.pair_counts, before | now)
        both = self.look(self.class_keys, self.class_counts, before | self.class_of[now])
        out[here] = np.log((pair + BACKOFF * np.exp(out[here])) / (both + BACKOFF))
        out += self.log_side[ids]
        return np.add.reduceat(out, start) if len(start) else np.zeros(0)


@dataclass
class Model:
    """counts: the count model; network: of the classes; begins: share of each class whose ids begin a word or end a text."""

    counts: Fixed
    network: Network
    begins: np.ndarray

    def classes(self, ids: np.ndarray, lengths: np.ndarray, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """For each place: log p(class of the id after it), and log probability that a word begins or the text ends after it."""
        class_of = self.counts.class_of
        target = np.roll(ids, -1)
        target[np.cumsum(lengths) - 1] = len(class_of) - 1
        inputs, goal = ids % INPUTS, class_of[target]
        found, border = np.zeros(len(ids)), np.zeros(len(ids))
        first, size, skip = windows(lengths)
        place = np.arange(WINDOW)
        for past in (0, OVERLAP):  # a text's first windows, then the others, whose overlap isn't asked for
            mine = np.flatnonzero(skip == past)
            for w in np.array_split(mine, -(-len(mine) // batch)) if len(mine) else []:
                at = np.minimum(first[w, None] + place, len(ids) - 1)
                hidden = self.network.attend(inputs[at], past)[0]
                scored, at = place[past:] < size[w, None], at[:, past:]
                each = self.network.log_probs(hidden.reshape(-1, WIDTH), goal[at.ravel()], self.begins)
                where = at[scored]
                found[where], border[where] = (y[scored.ravel()] for y in each)
        return found, border

    def words(self, encoder: Encoder, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each slot's word in its context, of the end of each text); slot 0 gets 0."""
        ids, first = encoder.expand(slots)
        begin = first[slots == 0]
        lengths = np.diff(np.append(begin, len(ids)))
        found, border = self.classes(ids, lengths)
        last = begin + lengths - 1
        ends = found[last] + self.counts.log_within[-1] + self.counts.log_side[-1] - border[last]
        shifted = np.concatenate([[0.0], found[:-1]])  # of the id itself
        edge = np.append(first[1:], len(ids)) - 1
        word = np.add.reduceat(shifted, first) + encoder.fixed[slots] - border[np.maximum(first - 1, 0)] + border[edge]
        word[slots == 0] = 0.0
        return word, np.minimum(ends, 0.0)


def singles(counts: np.ndarray) -> np.ndarray:
    """Class of the ids that have one each, the most frequent; SINGLE for the others."""
    own = np.full(len(counts), SINGLE)
    order = np.lexsort((np.arange(len(counts)), -counts))[:SINGLE]
    own[order] = np.arange(len(order))
    return own


def cells(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For neighbours a, b: the places in the table of neighbours, which has 2 * (SINGLE + 1) columns, of b after a and then of a before b."""
    width = 2 * (SINGLE + 1)
    return np.concatenate([b.astype(np.int64) * width + own[a], a.astype(np.int64) * width + SINGLE + 1 + own[b]])


def learn_classes(counts: np.ndarray, pairs: dict[tuple[int, int], int], profile: np.ndarray | None = None) -> np.ndarray:
    """Class of each id: the most frequent have one each, the others share by their neighbours, by a few k-means steps.

    The neighbours are counted in pairs, or in profile, the table of neighbours."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.empty(len(counts), np.int16)
    single = order[:SINGLE]
    out[single] = np.arange(SINGLE)
    rest = order[SINGLE:]
    if profile is None:
        profile = np.zeros((len(counts), 2 * (SINGLE + 1)), np.float32)
        if pairs:
            a, b, n = (np.array(v) for v in zip(*((i, j, m) for (i, j), m in pairs.items()), strict=True))
            np.add.at(profile.ravel(), cells(a, b, singles(counts)), np.concatenate([n, n]))
    x = np.sqrt(profile[rest])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    groups = CLASSES - SINGLE
    seen = x.any(axis=1)
    centre = x[np.flatnonzero(seen)[:: max(1, int(seen.sum()) // groups)][:groups]] if seen.sum() >= groups else np.eye(groups, x.shape[1], dtype=np.float32)
    for _ in range(8):
        near = (x @ centre.T).argmax(axis=1)
        for g in range(groups):
            if (near == g).any():
                m = x[near == g].sum(axis=0)
                centre[g] = m / max(float(np.linalg.norm(m)), 1e-9)
    near = (x @ centre.T).argmax(axis=1)
    near[~seen] = rest[~seen] % groups
    out[rest] = SINGLE + near
    return out


def within(counts: np.ndarray, class_of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log share of each id's side in its class, log share of the id on its side, log share of each class, share of each class that starts), with FRACTION added to each count."""
    n = counts + FRACTION
    total = np.bincount(class_of, weights=n, minlength=CLASSES)
    begun = np.bincount(class_of, weights=n * starts, minlength=CLASSES)
    side = np.where(starts, begun[class_of], (total - begun)[class_of])
    log_share = np.log(np.maximum(total, 1e-9) / max(total.sum(), 1e-9)).astype(np.float32)
    return np.log(np.maximum(side, 1e-9) / total[class_of]), np.log(n / np.maximum(side, n)), log_share, (begun / np.maximum(total, 1e-9)).astype(np.float32)


def adam_steps(net: Network, ids: np.ndarray, lengths: np.ndarray, class_of: np.ndarray, state: dict, batch: int = STEP_WINDOWS, rate: float = 8e-3) -> None:
    """One pass over the windows of some texts, which don't overlap here, in a shuffled order; the rate falls to a tenth over LEAST_STEPS."""
    target = np.roll(ids, -1)
    target[np.cumsum(lengths) - 1] = len(class_of) - 1
    inputs, goal = ids % INPUTS, class_of[target]
    first, size, _ = windows(lengths, 0)
    place = np.arange(WINDOW)
    order = state["rng"].permutation(len(first))
    for k in range(0, len(order), batch):
        w = order[k : k + batch]
        at = np.minimum(first[w, None] + place, len(ids) - 1)
        g = net.gradient(inputs[at], goal[at], place < size[w, None])
        state["t"] += 1
        state["m"] += 0.1 * (g - state["m"])
        state["s"] += 0.01 * (g * g - state["s"])
        t = state["t"]
        now = rate * max(0.1, 1 - t / LEAST_STEPS)
        net.flat -= now * (state["m"] / (1 - 0.9**t)) / (np.sqrt(state["s"] / (1 - 0.99**t)) + 1e-8)


def plan_of(n_ids: float, rounds: int = ROUNDS) -> tuple[int, int]:
    """(shards of a round, passes over each text) for so many ids of training texts."""
    each = n_ids / rounds
    shards = max(1, math.ceil(each / SHARD_IDS))
    return shards, min(PASSES, max(1, math.ceil(LEAST_STEPS * STEP_WINDOWS * WINDOW * shards / max(each, 1.0))))


def mean_weights(weights: DataFrame, shards: int) -> np.ndarray | None:
    """The mean of the shards' weights, by their steps, in two levels: sums of some hundred shards each, then the sum of these by place."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, steps = 0.0, 0.0
        for pdf in batches:
            for flat, n in zip(pdf["flat"], pdf["steps"], strict=True):
                total, steps = total + np.frombuffer(flat, np.float32).astype(float) * n, steps + n
        if steps:
            yield pd.DataFrame({"place": np.arange(len(total)), "total": total, "steps": steps})

    groups = math.ceil(math.sqrt(shards))
    parts = weights.repartition(groups, "shard").mapInPandas(partial, "place int, total double, steps double")
    rows = parts.groupBy("place").agg((F.sum("total") / F.sum("steps")).alias("mean")).toPandas()
    return rows.sort_values("place")["mean"].to_numpy(np.float32) if len(rows) else None


def train(documents: DataFrame, class_of: np.ndarray, log_share: np.ndarray, vocabulary: tuple[str, str], n_ids: float, rounds: int = ROUNDS) -> Network:
    """Rounds of local steps on each shard, then the mean of the shards' weights, by their steps.

    A row's round, shard and place in the shard come from the hash of its text and doc_id, and the number of shards and
    passes from n_ids, so how the table is cut changes nothing. Together the rounds pass over all texts.
    """
    net = Network.fresh(log_share)
    sc = documents.sparkSession.sparkContext
    shards, passes = plan_of(n_ids, rounds)
    keyed = documents.select("text", F.xxhash64("text", F.col("doc_id").cast("long")).alias("h"))
    for r in range(rounds):
        shared = sc.broadcast((net.flat, class_of))

        def local(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            start, classes = shared.value
            own, encoder, shard = Network(start.copy()), Encoder(*vocabulary), TaskContext.get().partitionId()
            state = {"t": 0, "m": np.zeros_like(start), "s": np.zeros_like(start), "rng": np.random.default_rng((r, shard))}
            for texts in text_groups(batch.column("text") for batch in batches):
                ids, lengths = encoder.texts(texts)
                for _ in range(passes):
                    adam_steps(own, ids, lengths, classes, state)
            if state["t"]:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([own.flat.astype(np.float32).tobytes()]), pa.array([float(state["t"])])], ["shard", "flat", "steps"])
            give_back()

        part = keyed.where(F.pmod("h", F.lit(rounds)) == r).repartition(shards, "h").sortWithinPartitions("h").select("text")
        flat = mean_weights(materialize(part.mapInArrow(local, "shard int, flat binary, steps double"), "weights"), shards)
        if flat is not None:
            net = Network(flat)
    return net


def held_out() -> Column:
    return F.coalesce(fold("doc_id", 7) == 2, F.lit(False))


def score(documents: DataFrame, *, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    docs = documents.select("doc_id", "text").withColumn("held_out", held_out())
    training = docs.where("not held_out")
    counts = materialize(training.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_train = training.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, denominator = n_words + n_train, float(n_words + n_train + n_distinct + (n_train > 0) + 1)
    often = most_frequent(counts, "c", TOP_WORDS)
    top = {bytes(r.word): r.c for r in often.collect()}

    def count_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(key, n): ids, and as id + 1 << 20 | next id the pairs within words; each distinct word is encoded once."""
        encoder = Encoder(*vocabulary)
        single, pairs = np.zeros(encoder.end + 1, np.int64), Counter()
        for pdf in larger(batches):
            words, n = pdf["word"].tolist(), pdf["c"].to_numpy()
            encoder.reset()
            encoder.learn(words)
            slots = np.arange(1, len(words) + 1)
            ids, first = encoder.expand(slots)
            weight = np.repeat(n, encoder.size[slots])
            np.add.at(single, ids, weight)
            inner = np.ones(len(ids), bool)
            inner[first] = False
            here = np.flatnonzero(inner)
            key, at = np.unique((ids[here - 1].astype(np.int64) + 1) << 20 | ids[here], return_inverse=True)
            pairs.update(dict(zip(key.tolist(), np.bincount(at, weights=weight[here]).astype(np.int64).tolist(), strict=True)) if len(key) else {})
            if len(pairs) > 500_000:
                yield pd.DataFrame({"key": list(pairs.keys()), "n": list(pairs.values())}, dtype="int64")
                pairs.clear()
        at = np.flatnonzero(single)
        yield pd.DataFrame({"key": [*at.tolist(), *pairs.keys()], "n": [*single[at].tolist(), *pairs.values()]}, dtype="int64")

    def neighbour_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = own_class.value
        for pdf in batches:
            key = pdf["key"].to_numpy(np.int64)
            yield pd.DataFrame({"cell": cells((key >> 20) - 1, key & (1 << 20) - 1, own), "n": np.tile(pdf["n"].to_numpy(np.int64), 2)})

    bpe = coder(*vocabulary)
    size = bpe.base + 1
    gathered = materialize(counts.mapInPandas(count_ids, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "ids")
    ids = gathered.where(F.col("key") < 1 << 20).toPandas()
    id_counts = np.zeros(size, np.float64)
    id_counts[ids["key"].to_numpy(np.int64)] = ids["n"].to_numpy(float)
    id_counts[size - 1] = n_train
    all_pairs = gathered.where(F.col("key") >= 1 << 20)
    inner = most_frequent(all_pairs, "n", PAIRS).toPandas()
    own_class = spark.sparkContext.broadcast(singles(id_counts))
    near = all_pairs.mapInPandas(neighbour_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    starts = np.array([t[:1] == b" " for t in bpe.bytes_of] + [True])
    profile = np.zeros((size, 2 * (SINGLE + 1)), np.float32)
    profile.ravel()[near["cell"].to_numpy(np.int64)] = near["n"].to_numpy(np.float32)
    # What begins a word has its border before it, what ends one after it.
    profile = np.column_stack([profile, id_counts * starts, np.maximum(id_counts - profile[:, SINGLE + 1 :].sum(axis=1), 0)]).astype(np.float32)
    class_of = learn_classes(id_counts, {}, profile)
    log_side, log_within, log_share, begins = within(id_counts, class_of, starts)
    network = train(training.select("doc_id", "text"), class_of, log_share, vocabulary, float(id_counts.sum())) if n_train else Network(np.zeros(Network.SIZE, np.float32))
    kept = np.sort(inner["key"].to_numpy(np.int64))
    counted = spark.sparkContext.broadcast((class_of, log_within, kept))

    def class_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = counted.value[0]
        for pdf in batches:
            key = pdf["key"].to_numpy(np.int64) - (1 << 20)
            yield pd.DataFrame({"key": key >> 20 << 20 | classes[key & (1 << 20) - 1].astype(np.int64), "n": pdf["n"]})

    def other_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(word, key, prior) for each pair within a word that isn't kept; prior is what its count is added to."""
        _, log_share_of, keys = counted.value
        encoder = Encoder(*vocabulary)
        for pdf in larger(batches):
            words = pdf["word"].tolist()
            encoder.reset()
            encoder.learn(words)
            slots = np.arange(1, len(words) + 1)
            ids, first = encoder.expand(slots)
            inner = np.ones(len(ids), bool)
            inner[first] = False
            here = np.flatnonzero(inner)
            key = (ids[here - 1].astype(np.int64) + 1) << 20 | ids[here]
            new = ~np.isin(key, keys)
            word = np.repeat(np.arange(len(words)), encoder.size[slots])[here][new]
            yield pd.DataFrame({"word": [words[i] for i in word.tolist()], "key": key[new], "prior": BACKOFF * np.exp(log_share_of[ids[here][new]])})

    totals = all_pairs.mapInPandas(class_totals, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    fixed = Fixed.of(class_of, log_side, log_within, kept - (1 << 20), inner.sort_values("key")["n"].to_numpy(float), (totals["key"].to_numpy(np.int64), totals["n"].to_numpy(float)))
    known, extra = counts.withColumn("extra", F.lit(0.0)), {}
    if all_pairs.count() > len(kept):
        unseen = docs.where("held_out").select("text").mapInArrow(count_words, "word binary, n long").select("word")
        each = counts.select("word").union(unseen).distinct()
        more = each.mapInPandas(other_pairs, "word binary, key long, prior double").join(all_pairs, "key")
        more = materialize(more.groupBy("word").agg(F.sum(F.log1p(F.col("n") / F.col("prior"))).alias("extra")), "pairs")
        extra = {bytes(r.word): r.extra for r in more.join(often.select("word"), "word").collect()}
        known = counts.join(more, "word", "full").select("word", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("extra", F.lit(0.0)).alias("extra"))
    shared = spark.sparkContext.broadcast((Model(fixed, network, begins), top, extra))
    end_known, end_base = int(n_train > 0), math.log10((n_train + 1) / denominator)
    total = float(max(tokens, 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, extra = shared.value
        encoder = Encoder(*vocabulary, model.counts, top, extra)
        row, ln10 = TaskContext.get().partitionId() << 40, math.log(10)
        for batch in batches:
            done = 0
            for texts in text_groups(iter([batch.column("text")]), 5 * GROUP_CHARS):
                words, n = split(texts)
                slots = encoder.slots(words, n)
                raw, end = model.words(encoder, slots)
                word = np.minimum(raw, 0.0)
                at = np.flatnonzero(slots == 0)
                count = encoder.count[slots]
                few = np.isnan(count) & (slots > 0)
                often = ~np.isnan(count)
                mixed = np.zeros(len(slots))
                mixed[often] = np.log10(MIX * count[often] / total + (1 - MIX) * np.exp(word[often]))
                mixed[few] = math.log10(1 - MIX) + word[few] / ln10  # as if never seen; the join adds what was
                base = np.where(few, -math.log10(denominator), 0.0)
                base[often] = np.log10((count[often] + 1) / denominator)
                sums = lambda x, at=at: np.add.reduceat(x, at)
                score = sums(mixed) + np.log10(MIX * n_train / total + (1 - MIX) * np.exp(end))
                places = np.flatnonzero(few)
                rare = words.take(pa.array(places - np.searchsorted(at, places)))
                ends = np.append(np.searchsorted(places, at), len(places)).astype(np.int32)
                lists = lambda x, ends=ends: pa.ListArray.from_arrays(pa.array(ends), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(texts))), batch.column("doc_id").slice(done, len(texts)), batch.column("held_out").slice(done, len(texts)), pa.array(n + 1),
                     pa.array(end_known + n - sums(few.astype(np.int64))), pa.array(end_base + sums(base)), pa.array(score),
                     lists(rare), lists(pa.array(raw[places]))],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "context"],
                )
                done += len(texts)
                row += len(texts)
        give_back()

    kind = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, context array<double>"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    scored = materialize(plain.mapInArrow(scan, kind), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "context")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.context").alias("context"))
    rare = rare.join(known, "word")
    before, after = F.least("context", F.lit(0.0)), F.least(F.col("context") + F.col("extra"), F.lit(0.0))
    gain = F.log10(F.lit(MIX) * F.col("c") / total + F.lit(1 - MIX) * F.exp(after)) - math.log10(1 - MIX) - before / math.log(10)
    gain = F.when(F.col("c") == 0, (after - before) / math.log(10)).otherwise(gain)
    rare = rare.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("plus"), F.sum(gain).alias("gain"))
    out = scored.drop("rare", "context").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("plus", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
