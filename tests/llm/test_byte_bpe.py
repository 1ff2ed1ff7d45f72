import base64
import hashlib
import random
from itertools import chain

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewave.llm import byte_bpe as B
from brinewave.llm.common import portions


@pytest.fixture(scope="module")
def known():
    import tiktoken

    path, pattern = B.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return B.Bpe.load(*B.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 　'sdt.,!19aé")), max_size=60))
def test_any_text_as_the_library(bpe, known, text):
    assert bpe.encode_texts([text])[0] == known.encode_ordinary(text)


def test_texts_as_the_library(bpe, known, texts):
    rng = random.Random(3)
    more = ["".join(rng.choice("abcdeéß") for _ in range(n)) for n in (63, 64, 65, 200, 3000)] + [" " * 300 + "x", "a" * 2000]
    for t in [x or "" for _, x in texts] + more:
        ids = bpe.encode_texts([t])[0]
        assert ids == known.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_long_and_short_merging_agree(bpe):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"theinganders ") for _ in range(rng.randrange(2, 60))) for _ in range(200)]
    assert bpe.merge_many(pieces, 64) == [bpe.merge_long(p) for p in pieces]


def test_memory_is_bounded(bpe, monkeypatch):
    bpe.forget()
    monkeypatch.setattr(B, "CACHE_BYTES", 10_000)
    for k in range(40):
        bpe.encode_texts([" ".join(f"w{k}x{j}" for j in range(20))])
        assert bpe.held <= 10_000 + 20 * 300 and len(bpe.cache) <= bpe.held / 200 + 1 and len(bpe.older) <= 16_000 / 200
    bpe.forget()
    assert not bpe.cache and not bpe.older


def test_portions_keep_all_texts():
    texts = pa.array(["a" * 10, None, "", "ü" * 400, "b", "c" * 3000, None])
    for size in (1, 50, 10**6):
        assert list(chain.from_iterable(portions(texts, size))) == texts.to_pylist()
        assert list(chain.from_iterable(portions(texts.slice(2, 4), size))) == texts.to_pylist()[2:6]


def test_operator(docs, texts, known, empty):
    got = B.round_trip(docs, *B.default_vocabulary())
    assert set(docs.columns) < set(got.columns)
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == known.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    d = B.digests(got).where("doc_id = 304").first()
    ids = known.encode_ordinary("One two")
    assert d.n_tokens == len(ids) and d.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert B.round_trip(empty, *B.default_vocabulary()).count() == 0
    one = docs.select(B.encode(docs.text, *B.default_vocabulary()).alias("i"))
    assert one.select(B.decode(one.i, *B.default_vocabulary()).alias("b")).where("b is null").count() == 0
