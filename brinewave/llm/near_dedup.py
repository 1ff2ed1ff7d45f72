"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets are one node from the start, so groups of exact copies cost a thin
aggregation. Bands are fixed subsets of a MinHash signature's values; nodes whose values of a band agree are candidates. Subsets
may overlap, so a signature gives many bands of many values: pairs at the threshold are hardly ever missed, and
unrelated texts that share common phrases hardly ever meet. A candidate pair's
signatures are compared batch by batch, and the pair is dropped as soon as the posterior probability that its
similarity reaches the threshold is under the chosen miss probability. What survives is verified on the full sets, and
connected components follow from alternating star contraction.

Candidates of a band bucket are not all its pairs. In each of PIVOTS rounds every bucket has one pivot, and only pairs
of the pivot with members that are not yet in its component are tested; the components found make the next round
smaller. What is left across components then meets within small buckets; members of large ones meet only where exact
bounds on their full sets allow a link (`prefix_pairs`), so no link between components is skipped.

Defined cases. A null, empty or blank text has no shingles: it is linked with nothing and is its own component. With
fewer words than a shingle has, the whole sequence is the one shingle. Very long texts are taken whole. Rows with equal
doc_id count as one document for the links. A row without doc_id takes part in no link; its component_id is that of the
documents with the same set, else null, and kept is false. Ties of similarity can't occur: a pair at exactly the
threshold is linked. An empty table gives no rows. `mark` reads doc_id and text and returns its own columns only, so
extra columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from brinewave.llm.common import WORD, give_back, materialize, portions, short_batches, table

HASHES = 192  # values of a signature
BANDS = 96
BAND_MISS = 1e-4  # probability that a pair at the threshold shares no band, at most
PRUNE_MISS = 1e-6  # posterior probability under which a candidate pair is dropped
BATCH = 32  # signature values compared at once
PIVOTS = 2  # rounds in which each bucket's members meet one of them, that with the most neighbours in all buckets first
SMALL_BUCKET = 16  # members of a bucket whose pairs are tested as they are, after these rounds
PRUNINGS = 2  # times that texts which can't be linked any more are dropped, before the rest meets
SIZE_STEP = 1.03  # from one class of set sizes to the next
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def band_miss(similarity: float, rows: int, bands: int = BANDS, hashes: int = HASHES) -> float:
    """Probability that a pair shares no band: over the number of equal values, each band is a subset of them by chance."""
    out = 0.0
    for m in range(hashes + 1):
        share = comb(m, rows) / comb(hashes, rows)
        out += comb(hashes, m) * similarity**m * (1 - similarity) ** (hashes - m) * (1 - share) ** bands
    return out


@lru_cache(maxsize=8)
def rows_for(similarity: float, bands: int = BANDS, hashes: int = HASHES, miss: float = BAND_MISS) -> int:
    """The most values of a band for which pairs at that similarity are missed with at most that probability."""
    return max((r for r in range(1, 33) if band_miss(similarity, r, bands, hashes) <= miss), default=1)


def band_keys(sig: Column, rows: int, bands: int = BANDS, hashes: int = HASHES) -> Column:
    """array<long> of a signature: one hash for each band, of its subset of values."""

    @pandas_udf("array<long>")
    def of(sigs: pd.Series) -> pd.Series:
        rng = np.random.default_rng(rows)
        subset = np.stack([rng.choice(hashes, rows, replace=False) for _ in range(bands)])
        factor = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(0, 2**63, bands, dtype=np.uint64)
        out = []
        for raw in sigs:
            h = ((np.frombuffer(raw, np.uint32).astype(np.uint64)[subset] ^ (factor >> np.uint64(17))) * factor).sum(axis=1) ^ salt
            out.append(((h ^ (h >> np.uint64(32))) * P1).view(np.int64))
        return pd.Series(out)

    return of(sig)


@lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    draw = lambda: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def shingles(text: str | None, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is lower-cased
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > 200_000:
        cache.clear()
    n = len(words)
    h = np.empty(n, np.uint64)
    for i, w in enumerate(words):
        v = cache.get(w)
        if v is None:
            v = cache[w] = xxhash.xxh3_64_intdigest(w)
        h[i] = v
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = (out ^ h[j : n - k + 1 + j]) * P1
        out ^= out >> np.uint64(29)
        out *= P2
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(h: np.ndarray, n: int) -> np.ndarray:
    """Minima of n permutations, as 32-bit numbers."""
    a, b = permutations(n)
    low = np.full(n, np.uint64(2**64 - 1))
    for k in range(0, len(h), 256):
        low = np.minimum(low, (h[k : k + 256, None] * a + b).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def digest(text: Column, size: int, hashes: int) -> Column:
    """Struct of a text: number of shingles, 128-bit key of the set, signature; the last two null for an empty set."""

    @arrow_udf("n long, set_key string, sig binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[bytes, int] = {}
        for texts in chain.from_iterable(map(portions, batches)):
            rows = []
            for x in texts:
                h = shingles(x, size, cache)
                rows.append((len(h), xxhash.xxh3_128_hexdigest(h.tobytes()), signature(h, hashes).tobytes()) if len(h) else (0, None, None))
            yield pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["n", "set_key", "sig"])
        cache.clear()
        give_back()

    return of(text)


def set_of(text: Column, size: int) -> Column:
    """The set of a text, as the bytes of its sorted hashes."""

    @arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[bytes, int] = {}
        for texts in chain.from_iterable(map(portions, batches)):
            yield pa.array([shingles(x, size, cache).tobytes() for x in texts], pa.binary())
        cache.clear()
        give_back()

    return of(text)


def elements_of(elements: Column) -> Column:
    """The hashes of a set as array<long>."""

    @pandas_udf("array<long>")
    def of(sets: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in sets])

    return of(elements)


@lru_cache(maxsize=8)
def least_matches(hashes: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(n, m) for each batch: after n values, a pair needs m equal ones to go on.

    With a uniform prior, m equal of n leave the similarity a Beta(m + 1, n - m + 1); its mass at t or above is the
    probability of at most m successes in n + 1 draws at t.
    """
    out = []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def may_be_similar(hashes: int, similarity: float, miss: float = PRUNE_MISS):
    """A UDF of two signatures: false once the posterior rules the pair out."""
    limits = least_matches(hashes, similarity, miss)

    @pandas_udf("boolean")
    def survives(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        if not len(a):
            return pd.Series(out)
        x = np.frombuffer(b"".join(a), np.uint32).reshape(len(a), hashes)
        y = np.frombuffer(b"".join(b), np.uint32).reshape(len(b), hashes)
        live, equal, start = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        for n, m in limits:
            equal[live] += (x[live, start:n] == y[live, start:n]).sum(axis=1)
            live, start = live[equal[live] >= m], n
        out[live] = True
        return pd.Series(out)

    return survives


def common(a: Column, b: Column) -> Column:
    """Elements that two sets share."""

    @pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        take = lambda v: np.frombuffer(v, np.uint64)
        return pd.Series([len(np.intersect1d(take(x), take(y), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    return of(a, b)


def small(df: DataFrame, name: str) -> DataFrame:
    """Materialize what is much smaller than the documents, by no more tasks than a few for each core."""
    return materialize(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), name)


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes with an edge (a, b): the smallest node that can be reached.

    Alternating large-star and small-star contraction; each is a minimum per node, joined back, never a group in memory.
    """
    e = small(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        few = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = small(few.where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select("v", "v").distinct())


def prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from different components that share a bucket and can reach percent by exact bounds; rest has node, component and buckets.

    All elements have one common order: those that only one component holds, then the rare before the frequent. Sets of
    na and nb elements need w = percent * (na + nb) / (100 + percent) in common, so they share one of the first
    na - w + 1 of a and the first nb - w + 1 of b, and at least w of each are held by another component. Partners come
    in classes of sizes, so w is known before the partner is. Most members of a family whose texts drifted apart have
    nothing in common within those bounds and drop out before any pair is made.
    """
    # An item is a node's set; a doc_id that is repeated with several texts has several.
    e = rest.join(sets, "node").withColumn("item", F.xxhash64("node", "elements")).dropDuplicates(["item"])
    e = e.select("item", "node", "component", "buckets", elements_of(F.col("elements")).alias("elements")).withColumn("n", F.size("elements"))
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    e = small(e.withColumn("class", size_class(F.col("n"))), "rest")
    for k in range(PRUNINGS):
        held = e.select("item", "component", F.explode("elements").alias("element"))
        order = held.groupBy("element").agg(F.count("*").alias("times"), (F.min("component") < F.max("component")).alias("several"))
        ranked = held.select("item", "element").join(order, "element").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("several", "times", "element"))).alias("ranked"))
        x = e.join(ranked, "item").withColumn("own", F.size(F.filter("ranked", lambda r: ~r["several"])))
        # A partner's class, from the smallest to the largest that the sizes allow; one more each way for rounding.
        near = F.sequence(size_class(F.ceil(F.col("n") * percent / 100)) - 1, size_class(F.floor(F.col("n") * 100 / percent)) + 1)
        x = x.select("item", "node", "component", "n", "own", "class", "buckets", "ranked", F.explode(near).alias("other"))
        least = F.greatest(F.floor(F.pow(F.lit(SIZE_STEP), F.col("other"))), F.ceil(F.col("n") * percent / 100), F.lit(1))
        common_at_least = F.ceil(percent * (F.col("n") + least) / (100 + percent) - 1e-9)
        first = F.slice("ranked", 1, F.greatest(F.col("n") - common_at_least + 1, F.lit(0)).cast("int"))
        first = F.transform(F.filter(first, lambda r: r["several"]), lambda r: r["element"])
        x = x.withColumn("first", first).where(F.size("first") > 0)
        x = x.select("item", "node", "component", "n", "own", "class", "buckets", "first", F.least("class", "other").alias("c0"), F.greatest("class", "other").alias("c1"), F.explode("first").alias("element"))
        x = x.withColumn("first", F.slice(F.array_sort("first"), 1, 64))
        # Within a key, pairs of its largest component with itself are never formed: what isn't of that component meets all.
        key = ["element", "c0", "c1"]
        parts = x.groupBy(*key, "component").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max_by("component", F.struct("m", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        x = small(x.join(parts.drop("parts"), key), "prefixes")
        if k < PRUNINGS - 1:
            e = small(e.join(x.select("item").distinct(), "item", "left_semi"), "rest")
    side = lambda a: x.select(*key, "most", *[F.col(c).alias(f"{c}_{a}") for c in ("node", "component", "n", "own", "class", "buckets", "first")])
    a, b = side("a").where("component_a <> most"), side("b").drop("most")
    enough = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    # A pair that meets by several elements is made by the least of them, as far as the lists go; the caller drops the others.
    once = F.coalesce(F.array_min(F.array_intersect("first_a", "first_b")) == F.col("element"), F.lit(True))
    several = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("most")) | (F.col("node_a") < F.col("node_b")))
    classes = (F.col("c0") == F.col("c1")) | (F.col("class_a") != F.col("class_b"))  # each pair has one key's classes
    met = a.join(b, key).where(classes & several & enough & F.arrays_overlap("buckets_a", "buckets_b") & once)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def links(documents: DataFrame, *, size: int, percent: int, miss: float = PRUNE_MISS) -> tuple[DataFrame, DataFrame]:
    """(base, nodes): base has doc_id, n_shingles and set_key of every row; nodes has set_key and component of every set."""
    similarity = percent / 100
    rows, hashes = rows_for(similarity), HASHES
    base = documents.select("doc_id", digest(F.col("text"), size, hashes).alias("d")).select("doc_id", F.col("d.n").alias("n_shingles"), "d.set_key", "d.sig")
    base = materialize(base, "signatures")
    nodes = base.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", F.explode(band_keys(F.col("sig"), rows)).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    members = materialize(banded.join(shared, "bucket"), "members")
    near = materialize(members.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    members = members.join(near, "node")
    sigs = materialize(nodes.join(near, "node", "left_semi").select("node", "n", "sig"), "near")
    texts = documents.where("text is not null").join(near.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = materialize(texts.select("node", set_of(F.col("text"), size).alias("elements")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar; materialized."""
        s = lambda k: sigs.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
        bound = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        rest = pairs.join(s("a"), "a").join(s("b"), "b").where(bound).where(may_be_similar(hashes, similarity, miss)("sa", "sb")).select("a", "b").distinct()
        rest = small(rest, "survivors")
        e = lambda k: sets.select(F.col("node").alias(k), F.col("elements").alias(f"e{k}"))
        exact = rest.join(e("a"), "a").join(e("b"), "b").withColumn("i", common(F.col("ea"), F.col("eb")))
        union = (F.length("ea") + F.length("eb")) / 8 - F.col("i")
        return small(exact.where(100 * F.col("i") >= percent * union).select("a", "b").distinct(), "links")

    found, part, tested = None, None, None
    for k in range(PIVOTS + 1):
        if part is None:
            placed = members.withColumn("component", F.col("node"))
        else:
            placed = members.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        order = F.struct(-F.col("degree"), F.xxhash64("node", F.lit(k)))
        pivot = placed.groupBy("bucket").agg(
            F.min_by(F.struct("node", "component"), order).alias("p"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("size")
        ).where("c0 < c1")
        left = placed.join(pivot.select("bucket", "size", F.col("p.node").alias("pivot"), F.col("p.component").alias("pc")), "bucket")
        if k < PIVOTS:
            pairs = left.where("component <> pc").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        else:  # what no pivot has joined
            left = small(left.select("bucket", "size", "node", "component"), "left")
            x, y = (left.where(F.col("size") <= SMALL_BUCKET).select("bucket", F.col("node").alias(a), F.col("component").alias(f"c{a}")) for a in "ab")
            pairs = x.join(y, "bucket").where("a < b and ca <> cb").select("a", "b")
            rest = left.where(F.col("size") > SMALL_BUCKET).groupBy("node").agg(F.first("component").alias("component"), F.collect_set("bucket").alias("buckets"))
            pairs = pairs.unionAll(prefix_pairs(rest, sets, percent))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = small(pairs, "pairs")
        if k and pairs.isEmpty():
            continue
        new = verified(pairs)
        found = new if found is None else found.unionAll(new)
        tested = pairs if tested is None else tested.unionAll(pairs)
        part = components(found)
    label = nodes.select("set_key", "node").join(part, "node", "left") if part is not None else nodes.select("set_key", "node", F.lit(None).cast("long").alias("component"))
    return base.select("doc_id", "n_shingles", "set_key"), label.select("set_key", F.coalesce("component", "node").alias("component"))


def mark(documents: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id and kept of every row, for links of at least percent of the union."""
    base, label = links(documents, size=size, percent=percent)
    out = base.join(label, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", "set_key", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def own_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with __id and __own, whether any row has __own): __id is the doc_id, but of rows that share one, or have none, a number from id and text."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__repeated"))
    if repeated.isEmpty() and docs.where("doc_id is null").isEmpty():
        return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__own": F.lit(False)}), False
    joined = docs.join(repeated, F.col("doc_id") == F.col("__repeated"), "left")
    number = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    own = F.col("doc_id").isNull() | F.col("__repeated").isNotNull()
    return joined.withColumns({"__id": F.when(own, number).otherwise(F.col("doc_id")).cast("long"), "__own": own}).drop("__repeated"), True


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, or else one whose doc_id isn't its own.

    Rows that share a doc_id, or have none, are judged by their own texts; of those equal in id and text one stays, and
    these differ in other columns at most. Rows without words are in no group and stay. Very long texts are compared
    whole; an empty table stays empty; the columns are those of docs.
    """
    short_batches(spark)
    named, any_own = own_ids(docs)
    marked = mark(named.select(F.col("__id").alias("doc_id"), "text"), size=5, percent=80)
    gone = marked.where("set_key is not null and not kept").select(F.col("doc_id").alias("__id")).distinct()
    kept = named.join(gone, "__id", "left_anti")
    if any_own:
        once = F.col("__own") & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        kept = kept.where(~once).unionByName(kept.where(once).dropDuplicates(["__id", "text"]))
    return kept.select(*docs.columns)
