"""Collocations by Toivonen's mining: a sample proposes phrases, a full pass counts them and their negative border.

Texts are cut into pieces at punctuation and line ends, pieces into words; a phrase is a run of words of one piece. A
phrase can only be frequent if it is without its last and without its first word. So:

1. A sample of one in SAMPLE_SHARE pieces of all documents is mined level by level, with a support so low that a phrase
   at the threshold is missed with a probability of MISS at most. Its phrases are the proposal.
2. One pass over all documents counts every word and every phrase whose two shorter ones are proposed. That is the
   proposal and its whole negative border, as far as the border occurs at all, without listing it.
3. A frequent phrase that wasn't proposed is a border failure: its extensions were not counted. A further pass over all
   documents counts these, and the extensions of what it counts for the first time itself, of whatever size, as far as
   no shorter phrase of theirs is known to be rare. So what it finds frequent needs no pass after it: the set is closed.
4. A last pass counts by their texts, per language, the phrases that have turned out frequent. Each task hands on each
   of them once, so its tasks are a few for each core and not as many as the input has parts.

The passes before the last count by 61-bit hashes of language and phrase, so no texts are shuffled for the many rare
ones; phrases that share a hash can only make a count too high, and the last pass sets that right. So the result is
complete and its counts are exact, whatever the sample and the hashes were.

Tasks know proposed phrases by a filter of hashes, whose size is bounded; a filter that takes in too much costs
time, since what it takes in is counted and dropped, and never a phrase. Within a task a phrase is a pair of integers
(shorter phrase, last word). Scores, cuts and the test for longer phrases are joins.

Memory. A task holds CHUNK_WORDS words and their distinct phrases, HELD_ROWS spelled phrases and a filter of at most 2 ** MOST_BITS bits, which is also what the driver gathers of the phrases.

Defined cases. A null text is empty; empty and blank texts have no words. A null language is `und`, and is one with a
language of that name. Very long texts are taken whole. Repeated rows count as often as they occur; doc_id may be null or
repeat, it only helps to draw the sample. Ties: a phrase at exactly the support is frequent; of cuts with equal scores
that with the fewest words before it counts; phrases of equal score are ordered by count, then by text. An empty table
gives no rows. doc_id, text and lang are read and no other column, so extra columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brinewave.llm.common import give_back, materialize, portions, short_batches, table

SUPPORT = 100
LONGEST = 5  # words of a phrase
TOP = 2_000  # phrases of a language in the result
SAMPLE_SHARE = 8  # one piece in so many is in the sample
MISS = 0.01
CHUNK_WORDS = 500_000
CHUNK_BYTES = 1_000_000  # of texts that are split into words at once
HELD_ROWS = 1_000_000  # of spelled phrases in a task
SPELLERS = 2  # tasks for each core in the last pass, at most
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28  # bits of a filter for a phrase; its size as powers of two
SALT = 64  # parts in which the phrases of a language are ranked first
PIECE_END = r"[.,;:!?\x0A-\x0D]"
END = "."  # stands between pieces; a word never has it
CUT = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- words and phrases of a chunk


class Words:
    """The distinct words of a chunk by language, numbered from 1, with their texts, languages and hashes; END is 0 in every language."""

    def __init__(self, said: dict[str, list[pa.Array]]) -> None:
        self.langs = list(said)
        texts, ids, hashes, lang_of = [pa.array([END], pa.large_binary())], [], [0], [0]
        for k, (lang, parts) in enumerate(said.items()):
            coded = pa.concat_arrays(parts).dictionary_encode()
            seed, own = xxhash.xxh3_64_intdigest(lang.encode()), coded.dictionary
            at = coded.indices.to_numpy().astype(np.int64)
            ids.append(np.where(at == own.index(pa.scalar(END.encode(), pa.large_binary())).as_py(), 0, at + len(hashes)))
            texts.append(own)
            hashes += [xxhash.xxh3_64_intdigest(w, seed) for w in own.to_pylist()]
            lang_of += [k] * len(own)
        self.texts, self.ids, self.hashes, self.lang_of = pa.concat_arrays(texts), np.concatenate(ids), np.array(hashes, np.uint64), np.array(lang_of)

    def __len__(self) -> int:
        return len(self.texts)


def split(texts: list[str]) -> pa.Array:
    """The words of texts, with END after each piece; A-Z are lower-cased."""
    raw = f" {END} ".join(texts).encode("utf-8", "surrogatepass").lower().translate(CUT).replace(b".", b" . ") + b" . "
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int64).tobytes()), pa.py_buffer(raw)])
    said = pc.list_flatten(pc.ascii_split_whitespace(whole)).cast(pa.large_binary())
    return said.filter(pc.greater(pc.binary_length(said), 0))


def mixed(h: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Hashes of phrases of so many words, which the last three bits tell, from those of one word less and the last words'."""
    h = (h ^ other) * P1
    h ^= h >> np.uint64(29)
    h *= P2
    return (h ^ h >> np.uint64(32)) & ~np.uint64(7) | np.uint64(size)


class Filter:
    """Which hashes may be in a set: four bits of one word of 64 for each; never false for a member."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), bool)
        at = (h >> np.uint64(32)) & np.uint64(len(self.words) - 1)
        bits = np.zeros(len(h), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << (h >> np.uint64(3 + 6 * k) & np.uint64(63))
        return self.words[at] & bits == bits


class Level:
    """The distinct phrases of so many words in a chunk: codes of its positions, and of each phrase the shorter phrase, last word, number and hash."""

    def __init__(self, words: Words) -> None:
        self.size, self.below, self.codes = 1, None, words.ids
        self.first = self.last = np.arange(len(words))
        self.hash = mixed(np.zeros(len(words), np.uint64), words.hashes, 1)
        self.n = np.bincount(words.ids, minlength=len(words))
        self.n[0] = 0

    def longer(self, at: np.ndarray, place: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> Level:
        """The phrases that begin at positions at and are a word longer; place: where in codes a position is."""
        out = object.__new__(Level)
        coded = pa.array(self.codes[place[at]].astype(np.int64) << 32 | ids[at + self.size]).dictionary_encode()
        unique = coded.dictionary.to_numpy()
        out.size, out.below, out.codes = self.size + 1, self, coded.indices.to_numpy()
        out.first, out.last = unique >> 32, unique & 0xFFFFFFFF
        out.hash = mixed(self.hash[out.first], hashes[out.last], out.size)
        out.n = np.bincount(out.codes, minlength=len(unique))
        return out

    def spell(self, at: np.ndarray, texts: pa.Array) -> pa.Array:
        last = texts.take(pa.array(self.last[at]))
        return last if self.below is None else pc.binary_join_element_wise(self.below.spell(self.first[at], texts), last, pa.scalar(" ", pa.large_string()))

    def first_words(self, at: np.ndarray) -> np.ndarray:
        return at if self.below is None else self.below.first_words(self.first[at])


HASHED, SPELLED = "hash long, n long", "lang string, phrase string, size int, n long"


def count_chunk(words: Words, wanted: set[int], known: Filter, new: Filter | None = None, spelled: bool = False) -> Iterator[pa.RecordBatch]:
    """Numbers of a chunk's phrases of the wanted sizes whose two shorter ones are known; words count all.

    (hash, n); with a filter of new phrases only those of which a shorter one is new or is itself counted for that, and
    these count as known for longer ones. Or spelled, (lang, phrase, size, n)
    of those that are known themselves, and size 0 with a language's number of words.
    """
    ids, langs, lang_of = words.ids, pa.array(words.langs, pa.string()), words.lang_of
    texts = words.texts.cast(pa.large_string()) if spelled else None

    def rows(level: Level, some: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            n = pa.array(level.n[part].astype(np.int64))
            if spelled:
                own = langs.take(pa.array(lang_of[level.first_words(part)]))
                yield pa.RecordBatch.from_arrays([own, level.spell(part, texts).cast(pa.string()), pa.array(np.full(len(part), level.size, np.int32)), n], ["lang", "phrase", "size", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(level.hash[part].view(np.int64)), n], ["hash", "n"])

    level, at, needed = Level(words), np.flatnonzero(ids), None
    place = np.arange(len(ids) + 1)  # where in level.codes a position's phrase is
    if spelled:
        n = np.bincount(lang_of, weights=level.n, minlength=len(langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([langs, pa.array([""] * len(langs)), pa.array(np.zeros(len(langs), np.int32)), pa.array(n)], ["lang", "phrase", "size", "n"])
    for size in range(1, max(wanted) + 1):
        if size > 1:
            may = np.zeros(len(ids) + 1, bool)
            codes = level.codes[place[at]]
            may[at] = known.has(level.hash)[codes]
            if new is not None:
                fresh = np.zeros(len(ids) + 1, bool)
                fresh[at] = new.has(level.hash)[codes]
                if needed is not None:
                    may[at] |= needed
                    fresh[at] |= needed
            at = np.flatnonzero(may[:-1] & may[1:])
            if not len(at):
                return
            needed = None if new is None else fresh[at] | fresh[at + 1]
            level = level.longer(at, place, ids, words.hashes)
            place = np.zeros(len(ids) + 1, np.int64)
            place[at] = np.arange(len(at))
        if size not in wanted:
            continue
        if spelled:
            yield from rows(level, np.flatnonzero((level.n > 0) & known.has(level.hash)))
        elif needed is None:
            yield from rows(level, np.flatnonzero(level.n))
        else:  # whether a phrase is needed is the same wherever it occurs
            every = np.zeros(len(level.n), bool)
            every[level.codes] = needed
            yield from rows(level, np.flatnonzero(every))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spelled numbers, added up over a task's chunks while they are no more than HELD_ROWS."""
    held, n = [], 0

    def summed() -> pa.Table:
        t = pa.Table.from_batches(held).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("n", "sum")])
        return t.rename_columns(["lang", "phrase", "size", "n"])

    for b in batches:
        held.append(b)
        n += len(b)
        if n > HELD_ROWS:
            t = summed()
            held, n = (t.to_batches(100_000), len(t)) if len(t) <= HELD_ROWS // 2 else ([], 0)
            if not held:
                yield from t.to_batches(100_000)
    if held:
        yield from summed().to_batches(100_000)


def counter(wanted: set[int], known, new=None, *, spelled: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function of (lang, text); known and new are broadcast filters."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, fresh = Filter(np.frombuffer(known.value, np.uint64)), None if new is None else Filter(np.frombuffer(new.value, np.uint64))
        said, held = {}, 0
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = b.column("text").filter(pc.equal(langs.indices, k))
                for texts in portions(own.drop_null(), CHUNK_BYTES):
                    said.setdefault(lang, []).append(split(texts))
                    held += len(said[lang][-1])
                    if held >= CHUNK_WORDS:
                        yield from count_chunk(Words(said), wanted, have, fresh, spelled)
                        said, held = {}, 0
                        pa.default_memory_pool().release_unused()
        if held:
            yield from count_chunk(Words(said), wanted, have, fresh, spelled)
        said = {}
        give_back()

    return (lambda batches: gathered(chunks(batches))) if spelled else chunks


# --- filters


def least_in_sample(support: int = SUPPORT, share: int = SAMPLE_SHARE, miss: float = MISS) -> int:
    """The highest count that a phrase at the support falls short of in the sample with a probability of miss at most."""
    mass, k, p = 0.0, 0, 1 / share
    while k <= support:
        mass += comb(support, k) * p**k * (1 - p) ** (support - k)
        if mass > miss:
            break
        k += 1
    return max(1, k)


def filter_words(phrases: DataFrame) -> np.ndarray:
    """The filter of the hashes of phrases: words of 64 bits, 2 ** (MOST_BITS - 6) at most."""
    n = phrases.count()
    if not n:
        return np.empty(0, np.uint64)
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n - 1).bit_length())) - 6
    bits = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(hash, {3 + 6 * k}) & 63 as int))" for k in range(4)))
    rows = phrases.select(F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1)).cast("int").alias("at"), bits.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


# --- mining


def sampled(documents: DataFrame, share: int) -> DataFrame:
    """(lang, text): of every text one in share of its pieces, by doc_id and place."""
    own = F.filter(F.split("text", PIECE_END), lambda _, i: F.pmod(F.xxhash64("doc_id", i, F.lit("sample")), F.lit(share)) == 0)
    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.array_join(own, END).alias("text"))


def propose(sample: DataFrame, *, least: int, longest: int) -> DataFrame:
    """(hash) of the phrases with at least so many occurrences in a sample (lang, text), level by level."""
    sc = sample.sparkSession.sparkContext
    found = None
    for size in range(1, longest + 1):
        words = filter_words(found) if found is not None else np.empty(0, np.uint64)
        counted = sample.mapInArrow(counter({size}, sc.broadcast(words.tobytes())), HASHED)
        now = materialize(counted.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash"), f"proposed-{size}")
        found = now if found is None else found.unionAll(now)
        if now.isEmpty():
            break
    return found


def spelled(texts: DataFrame, longest: int, known) -> DataFrame:
    """(lang, phrase, size, n): numbers of the known phrases (a broadcast filter) in texts (lang, text), from each task once.

    Nearly every task sees nearly all frequent phrases, and the more texts, the more of both: by the parts of the input
    the rows would grow with its square until each is one occurrence. Parts are taken together without a shuffle.
    """
    few = texts.coalesce(SPELLERS * texts.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(counter(set(range(1, longest + 1)), known, spelled=True), SPELLED)


def frequent_phrases(documents: DataFrame, *, support: int = SUPPORT, longest: int = LONGEST, share: int = SAMPLE_SHARE, least: int | None = None) -> DataFrame:
    """(lang, phrase, size, f) of every phrase of 1 to longest words with f >= support occurrences; size 0 has a language's number of words."""
    spark = documents.sparkSession
    short_batches(spark)
    sent = lambda phrases: spark.sparkContext.broadcast(filter_words(phrases).tobytes())
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    least = least_in_sample(support, share) if least is None else least
    known = propose(materialize(sampled(documents, share), "sample"), least=least, longest=longest)

    def counted(wanted: set[int], known, new=None) -> DataFrame:
        n = texts.mapInArrow(counter(wanted, known, new), HASHED).groupBy("hash").agg(F.sum("n").alias("n"))
        return materialize(n.where(F.col("n") >= support).select("hash"), "frequent")

    found = counted(set(range(1, longest + 1)), sent(known))
    failures = materialize(found.where(F.col("hash").bitwiseAND(F.lit(7)) < longest).join(known, "hash", "left_anti"), "failures")
    if not failures.isEmpty():
        found = found.unionAll(counted(set(range(2, longest + 1)), sent(known.unionAll(failures)), sent(failures)))
    exact = spelled(texts, longest, sent(found.distinct()))
    f = exact.groupBy("lang", "phrase").agg(F.min("size").alias("size"), F.sum("n").alias("f"))
    return materialize(f.where((F.col("f") >= support) | (F.col("size") == 0)), "phrases")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of two words and more, each by its lowest-scoring cut."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    total = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    part = lambda name, f: frequent.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    cut = cut.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n"))).withColumn("bottom", exact("l") * exact("r"))
    cut = cut.withColumn("score", F.expr("top div bottom"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "size", "a", "l", "r", "n")).alias("c"))
    return best.select("lang", "phrase", "c.size", "c.a", "c.l", "c.r", "c.n", "c.score")


def not_inside(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) without those that a longer frequent phrase has inside with the same count.

    If any longer one has, one that is a word longer has: counts only fall from part to whole.
    """
    longer = frequent.where("size > 2")
    ends = F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")))
    most = longer.select("lang", ends.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")


def best_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """phrases with rank, the first top of each language; ranked in SALT parts first, so that no language is one task."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = phrases.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    parts = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__rank") <= top).drop("__part", "__rank")
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(documents: DataFrame, *, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, share: int = SAMPLE_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations; documents has doc_id, text and lang."""
    frequent = frequent_phrases(documents, support=support, longest=longest, share=share)
    kept = not_inside(scored(frequent), frequent)
    return best_of_each(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


OP11_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), grams as (
  select lang, size, array_to_string(ws[i : i + size - 1], ' ') as phrase
  from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from words, range(1, {LONGEST + 1}) t(size) where len(ws) >= size)
), f as (
  select lang, size, phrase, count(*) as f from grams group by all having count(*) >= {SUPPORT}
), total as (
  select lang, count(*) as n from grams where size = 1 group by 1
), cuts as (
  select c.lang, c.phrase, c.size, c.f as a, k, x.f as l, y.f as r, n, ((1000::hugeint * c.f * n) // (x.f::hugeint * y.f))::bigint as score
  from (select *, unnest(range(1, size)) as k, string_split(phrase, ' ') as ws from f where size > 1) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1 : k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1 : c.size], ' ')
  join total t on t.lang = c.lang
), best as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, k) as c from cuts) where c = 1
), inside as (
  select lang, phrase, max(f) as most from (
    select lang, f, array_to_string(string_split(phrase, ' ')[1 : size - 1], ' ') as phrase from f where size > 2
    union all select lang, f, array_to_string(string_split(phrase, ' ')[2 : size], ' ') from f where size > 2) group by 1, 2
), kept as (
  select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where most is null or most < a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {TOP}
"""
