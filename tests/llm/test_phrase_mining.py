import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from brinewave.llm import phrase_mining as M

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, rank string, n double"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows, longest):
    out, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                out.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return out, n


def plain(rows, support, longest=5, top=2000):
    f, n = counts(rows, longest)
    f = {k: v for k, v in f.items() if v >= support}
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        inside = any(q_lang == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (q_lang, q), b in f.items())
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, x in found.items():
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(x)[:top])]
    return sorted(out)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "naïve", "A", "x y"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary[: rng.choice((6, 29))]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(("new york city hall", "in spite of", "a b. c d", "the quick\tbrown  fox jumps", "p, q; r")))
        rows.append((k, " ".join(words) + rng.choice(("", ".", "\n\n", "!?")), rng.choice(("en", "fr", None, "und")), "x", 1.0))
    rows += [(5, rows[5][1], "en", "x", 1.0), (None, rows[6][1], "fr", None, None), (None, None, None, None, None), (200, "", "en", "", 0.0), (201, " \t\n.;", "en", "", 0.0)]
    rows += [(300, "Ha " * 4000 + ". " + "one two three four five six " * 300, "fr", "", 0.0)]
    return rows


@pytest.mark.parametrize("share", [1, 2, 8])
def test_equal_to_counting_everything(spark, share):
    """Odd rows, repeated rows, very long texts and clashing columns; samples of all, half and an eighth."""
    rows = corpus()
    got = M.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), support=12, share=share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(rows, 12)


def test_border_failures_are_made_good(spark):
    """A proposal of nothing: every level comes from an expansion, and all frequent phrases are there with exact counts."""
    rows = corpus(1)
    got = M.frequent_phrases(spark.createDataFrame(rows, SCHEMA), support=12, share=2, least=10**9)
    f, n = counts(rows, 5)
    expected = [(lang, " ".join(p), len(p), v) for (lang, p), v in f.items() if v >= 12] + [(k, "", 0, v) for k, v in n.items()]
    assert sorted((r.lang, r.phrase, r["size"], r.f) for r in got.collect()) == sorted(expected)


def test_small_chunks(spark, monkeypatch):
    """Chunks of few words, and few rows held, give the same numbers in sum."""
    class Sent:
        value = np.full(64, 2**64 - 1, np.uint64).tobytes()

    import pyarrow as pa

    rows = corpus(2)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(M, "CHUNK_WORDS", 300)
    monkeypatch.setattr(M, "HELD_ROWS", 50)
    total = Counter()
    for b in M.counter({1, 2, 3, 4, 5}, Sent, spelled=True)(iter([batch])):
        for r in b.to_pylist():
            total[r["lang"], tuple(r["phrase"].split(" ")) if r["size"] else ()] += r["n"]
    f, n = counts(rows, 5)
    assert {k: v for k, v in total.items() if k[1]} == dict(f) and {k[0]: v for k, v in total.items() if not k[1] and v} == {k: v for k, v in n.items() if v}
    hashed = sum((Counter({r["hash"]: r["n"]}) for b in M.counter({1, 2, 3, 4, 5}, Sent)(iter([batch])) for r in b.to_pylist()), Counter())
    assert sorted(hashed.values()) == sorted(f.values()) and Counter(h & 7 for h in hashed) == Counter(len(p) for _, p in f)


def test_last_pass_hands_on_each_phrase_a_few_times(spark):
    """Rows of the last pass follow the phrases and the cores, not the parts of the input; their sums are exact."""
    class Sent:
        value = np.full(64, 2**64 - 1, np.uint64).tobytes()

    rows = corpus(3) * 6
    texts = spark.createDataFrame([(r[2] or "und", r[1]) for r in rows], "lang string, text string").repartition(60)
    got = M.spelled(texts, 3, Sent).collect()
    f, n = counts(rows, 3)
    assert len(got) <= M.SPELLERS * spark.sparkContext.defaultParallelism * (len(f) + len(n))
    most = max(Counter((r.lang, r.phrase) for r in got).values())
    assert most <= M.SPELLERS * spark.sparkContext.defaultParallelism
    total = Counter()
    for r in got:
        total[r.lang, tuple(r.phrase.split(" "))] += r.n if r["size"] else 0
    assert {k: v for k, v in total.items() if v} == dict(f)


def test_cuts_ties_and_order(spark):
    """Equal cuts: the first counts. Equal scores and counts: by the bytes of the phrase. A language's first are cut off after ranking."""
    rows = [(k, "z y. é a. b a. " * 20, "en", "", 0.0) for k in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, M.mine(df, support=5).collect())) == plain(rows, 5)
    assert [tuple(r) for r in M.mine(df, support=5, top=2).collect()] == plain(rows, 5, top=2)


def test_exact_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "", 0, 7 * big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)]
    got = M.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, f long")).collect()
    assert [r.score for r in got] == [1000 * (big - 3) * 7 * big // (big * (big - 1))]


def test_sample_support():
    from math import comb

    least = M.least_in_sample(100, 8, 0.01)
    tail = lambda t: sum(comb(100, k) * 0.125**k * 0.875 ** (100 - k) for k in range(t))
    assert tail(least) <= 0.01 < tail(least + 1) and M.least_in_sample(100, 1) == 100


def test_filter_has_every_member(spark):
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    words = M.filter_words(spark.createDataFrame([(int(x),) for x in h], "hash long"))
    f = M.Filter(words)
    assert f.has(h.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 2**63 - 1, 100_000).astype(np.uint64)
    assert f.has(other).mean() < 0.05


def test_empty_and_query(spark):
    assert M.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = sorted(map(tuple, M.op11_phrase_mining(spark, DATA).collect()))
    assert got == sorted(c.sql(M.OP11_SQL).fetchall()) and len(got) > 20
