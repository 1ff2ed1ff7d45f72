from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brinewave.llm import quality_rules as Q

from .conftest import words


def by_hand(text):
    w, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, mark = Counter(zip(w, w[1:], w[2:])), set()  # noqa: B905
    for k in range(len(w) - 2):
        if n[tuple(w[k : k + 3])] > 1:
            mark |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(mark)


def test_statistics_by_hand(docs, texts):
    more = ["a b c a b c", "a\na\n\n\n b\n b", "#x $y | <z>", "a b a b a b a"]
    for t in [x for _, x in texts] + more:
        assert Q.stats_of(t)[:5] == by_hand(t)
    got = Q.judge(docs, Q.DecisionList())
    assert got.count() == len(texts) and {"lang", "source", "score"} <= set(got.columns)
    assert got.where("base_failed and kept").count() == 0


def test_learns_a_threshold():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    good = ~((x["a"] > 0.8) & (x["b"] > 0.5))
    rules = Q.learn(x, good)
    assert rules.rules and {c[0] for c in rules.rules[0].conditions} == {"a", "b"}
    hit = np.zeros(3000, bool)
    for r in rules.rules:
        hit |= r.matches(x)
    assert (hit == ~good).mean() > 0.97


def test_column_and_numpy_agree(spark):
    rules = Q.DecisionList((Q.Rule((("a", ">", 0.5), ("b", "<=", 0.3))), Q.Rule((("b", ">", 0.9),))))
    rng = np.random.default_rng(1)
    x = {k: rng.random(200) for k in "ab"}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in x.values()), strict=True)), "a double, b double")
    kept = [r.k for r in df.select(rules.verdict({k: F.col(k) for k in "ab"}).alias("k")).collect()]
    assert kept == (~(rules.rules[0].matches(x) | rules.rules[1].matches(x))).tolist()
    assert "reject" in str(rules)


def test_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, none).rules == ()
    assert Q.fit(empty, none).rules == ()
    assert Q.judge(empty, Q.DecisionList()).count() == 0
    assert Q.learn({"a": np.arange(5.0)}, np.ones(5, bool)).rules == ()


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = Q.fit(d, labels.where("doc_id % 2 = 0"))
    j = Q.judge(d.select("doc_id", "text"), rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in j]) > 0.97
