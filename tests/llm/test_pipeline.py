"""The pipeline against a plain version of its stages, over the smallest tables."""

import base64
import hashlib
import importlib.util
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline isn't there", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from brinewave.llm import byte_bpe, quality_rules  # noqa: E402

from .test_near_dedup import brute  # noqa: E402
from .test_source_mixing import targets_by_hand  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    import tiktoken

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    mixed = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        path = corpus_pipeline.fresh_path(spark, f"test-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert set(seen[-1].items()) <= set(seen[-2].items())
        if name == "source_mixing":
            mixed = docs.collect()
    for i in set(seen[0]) - set(seen[1]):
        n = quality_rules.stats_of(seen[0][i])
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert failed or n[2] > 0 or n[3] > 0 or n[6] > 0 or n[8] > 0  # rejected by a rule on symbols, lines or case
    component, _ = brute(list(seen[2].items()), 5, 80)
    assert set(seen[3]) == {i for i in seen[2] if component[i] == i}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies.values()) <= {1, 2}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    size = {i: len(t.encode().split()) for i, t in seen[3].items()}
    by: Counter = Counter()
    for i in seen[3]:
        by[source[i]] += size[i]
    goal = targets_by_hand(dict(by))
    for s in by:
        taken = sum(copies[i] * size[i] for i in seen[3] if source[i] == s)
        assert abs(taken - goal[s]) <= 1.5 * max(size[i] for i in seen[3] if source[i] == s)
    path, pattern = byte_bpe.default_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in got) == copies
    for r in got:
        ids = known.encode_ordinary(seen[4][r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_rows(spark, docs, empty):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars", "score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, DATA).count() <= 2 * d.count(), name
        assert stage(spark, empty.select("doc_id", "text", "lang", "source", "n_chars"), DATA).count() == 0, name
