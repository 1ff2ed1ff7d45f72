import random
import re

import numpy as np
import pytest
import xxhash

from brinewave.llm import simhash_dedup as S

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, limit=4):
    """doc_id -> smallest doc_id within reach, by comparing every two fingerprints; rows: (doc_id, fingerprint)."""
    rows = [r for r in rows if r[0] is not None]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, p) in enumerate(rows):
        for j, q in rows[:k]:
            if (p ^ q).bit_count() <= limit:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in up}


def test_fingerprints(texts):
    for _, t in texts[:60] + texts[-14:-5]:
        assert S.simhash(S.shingle_hashes(t, 4)) == plain_fingerprint(t)


def test_rows_and_odd_rows(spark, docs, texts):
    got = S.mark(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    component = plain_components(prints)
    by_print = {}
    for i, p in prints:
        if i is not None:
            by_print.setdefault(p, component[i])
    expected = sorted(((i, f"{p:016x}", component[i] if i is not None else by_print.get(p)) for i, p in prints), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected
    assert next(r for r in got if r.doc_id == 300).component_id == 300 == next(r for r in got if r.doc_id == 302).component_id


def test_empty(spark, empty):
    out = S.mark(empty)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def near(rng, p, k):
    for b in rng.sample(range(64), k):
        p ^= 1 << b
    return p


def planted(seed, n):
    """Fingerprints at all distances: single ones, families around a centre, chains, and many that share two parts of the bits."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    out += [near(rng, out[k % 9], rng.randrange(1, 9)) for k in range(n)]
    p = rng.getrandbits(64)
    for _ in range(40):
        p = near(rng, p, 4)
        out.append(p)
    base = rng.getrandbits(64)
    out += [base ^ near(rng, 0, rng.randrange(5)) & ((1 << 21) - 1) for _ in range(n)]
    return sorted(set(out))


@pytest.mark.parametrize(("shard_rows", "sample_rows"), [(50, 10_000), (50, 60), (10_000, 10_000)])
def test_links_equal_all_pairs(spark, monkeypatch, shard_rows, sample_rows):
    """Components of trees with many and few shards, with cuts from a small sample, equal those of all pairs."""
    prints = planted(3, 250)
    rows = [(k, p if p < 1 << 63 else p - (1 << 64)) for k, p in enumerate(prints)]
    points = spark.createDataFrame(rows, "node long, point long")
    edges = {(r.a, r.b) for r in S.links(points, shard_rows=shard_rows, sample_rows=sample_rows).collect()}
    up = {k: k for k, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    assert {k: top(k) for k in up} == plain_components(list(enumerate(prints)))


@pytest.mark.parametrize("leaf", [8, 40])
def test_one_shard(monkeypatch, leaf):
    """Cuts in memory, by the part and by all bits, lose no link of an owned point."""
    monkeypatch.setattr(S, "LEAF", leaf)
    prints = planted(5, 120)
    to = S.forest(np.array(prints, np.uint64), np.ones(len(prints), bool), (1 << 64) - 1, 4)
    expected = plain_components(list(enumerate(prints)))
    assert {k: int(x) for k, x in enumerate(to)} == expected or all((to[a] == to[b]) == (expected[a] == expected[b]) for a in range(len(to)) for b in range(a))


def test_a_link_is_at_most_four_bits_and_no_shard_emits_pairs(spark):
    p = (1 << 40) - 1
    rows = [(1, p), (2, p ^ 0b1111), (3, p ^ 0b11111 << 50)]
    edges = S.links(spark.createDataFrame(rows, "node long, point long")).collect()
    assert {tuple(sorted(e)) for e in edges} == {(1, 2)}
    family = spark.createDataFrame([(k, k) for k in range(16)], "node long, point long")
    assert S.links(family).count() <= 3 * 15


def test_query_over_the_smallest_tables(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in rows.items()]
    component = plain_components(prints)
    got = sorted(map(tuple, S.op13_simhash_dedup(spark, DATA).collect()))
    assert got == sorted((i, f"{p:016x}", component[i]) for i, p in prints)
