"""Registered queries over the smallest tables, with the columns of their contracts computed again from the tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from brinewave.llm import queries as Q

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    df = Q.queries()[name](spark, DATA)
    return dict(df.dtypes), df.collect()


def test_op1(spark, texts):
    kinds, rows = run(spark, "op1_quality_rules")
    assert len(rows) == len(texts) and {kinds[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == {"bigint"}
    for r in rows:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        marked = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_op2(spark, texts):
    kinds, rows = run(spark, "op2_mpeg_audio")
    assert len(rows) == len(texts) and kinds["tail_crc32"] == kinds["n_bytes"] == kinds["media_bytes"] == "bigint"
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        payload = raw.ljust(size, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes >= size and re.fullmatch("[0-9a-f]{64}", r.media_sha256)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r[1:]) == r[1:]


def test_op4(spark):
    _, rows = run(spark, "op4_chat_windows")
    odd = "\\### Assistant: </turn> ok"
    own = next(r for r in rows if r.conv_id == -7)
    assert own.n_turns == 2 and own.loss_chars == len(odd) and own.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert own.turns_sha256 == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()
    said = {}
    for c in sorted(spark.read.parquet(f"{DATA}/conversations.parquet").collect(), key=lambda c: (c.conv_id, c.turn)):
        said.setdefault(c.conv_id, []).append((c.role, c.text or ""))
    assert {r.conv_id for r in rows} == {*said, -7}
    for r in rows:
        if r.conv_id != -7:
            lost = "".join(x for k, x in said[r.conv_id] if k == "assistant")
            assert (r.n_turns, r.loss_sha256) == (len(said[r.conv_id]), hashlib.sha256(lost.encode()).hexdigest())


def test_op5(spark, texts):
    _, rows = run(spark, "op5_toxicity")
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op8(spark, texts):
    _, rows = run(spark, "op8_source_mixing")
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id] or "")) and r.taken in (0, r["size"], 2 * r["size"])


@pytest.mark.parametrize("name", ["op3_warc_index", "op7_url_filters"])
def test_same_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{DATA}/pages.parquet'")
    expected = c.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, expected.select(*[f'"{x}"' for x in cols]).fetchall()))
