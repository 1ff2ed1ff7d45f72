import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from brinewave.llm import token_alignment as T

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def plain(rows, tokenizers):
    """The contract's numbers, token by token."""
    t, sp = tokenizers
    chars = {c: b for b, c in {**{b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}.items()}
    free = [b for b in range(256) if b not in chars.values()]
    chars |= {chr(256 + k): b for k, b in enumerate(free)}
    docs, holders = [], Counter()
    for i, text in rows:
        a = t.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(chars[c] for c in t.id_to_token(x)) for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [sp.id_to_piece(x)]]
        if not text or b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            docs.append((i, 0, 0, [], Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        n_a, n_b = len(a), len(b)
        common = sorted(set(ends_a) & set(ends_b))
        groups = []
        for e in common:
            ga, gb = [], []
            for ids, at, into in ((a, ends_a, ga), (b, ends_b, gb)):
                while at and at[0] <= e:
                    into.append(ids.pop(0))
                    at.pop(0)
            groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        holders.update(links.keys())
        docs.append((i, n_a, n_b, groups, links))
    highest = {}
    for (x, _), n in holders.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        best = sum(n for p, n in links.items() if holders[p] == highest[p[0]])
        out.append((i, n_a, n_b, len(groups), sum(links.values()), best, sum(n * holders[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out, holders, highest


def odd():
    rng = random.Random(3)
    letters = "abcdefghij ..,,  \n\t0123456789éüñ漢字かな🙂🏽́ 　​"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))) for k in range(60)]
    rows += [(100, "<|endoftext|> <s> <unk> [INST] <0x41>"), (101, "▁ under ▁▁score"), (102, "ﬁ ½ Å \x00 \x7f \x85"), (103, "x" * 5000), (104, "-=" * 3000 + "=" * 777), (105, "".join(rng.choice("ACGT") for _ in range(20_000)))]
    rows += [(106, "  lead and trail  "), (107, "\n\n\n"), (108, "a\r\nb"), (109, " ".join(rng.choice(("Haus", "maison", "casa", "home", "1234")) for _ in range(3000)))]
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_texts(spark, tokenizers, monkeypatch):
    rows = odd() + [(200, None), (201, ""), (202, " "), (3, "again"), (None, "home casa"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, n_a int").repartition(3)
    out, pairs = T.align(docs)
    expected, holders, highest = plain(rows, tokenizers)
    assert rows_of(out) == sorted(expected, key=repr)
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == highest[p[0]]) for p, n in holders.items()}
    assert dict(out.dtypes)["n_best"] == dict(out.dtypes)["count_sum"] == "bigint"


def test_common_texts_and_columns(spark, docs, texts, tokenizers):
    assert rows_of(T.align(docs)[0]) == sorted(plain(texts, tokenizers)[0], key=repr)


def test_small_blocks_and_portions(tokenizers, monkeypatch):
    """Where blocks and portions are cut changes no document's numbers: the merged partial counts of many blocks."""
    rows = odd()
    a, b = T.tokenizer_a(str(public_tokenizers.path(T.A_NAME))), T.tokenizer_b(str(public_tokenizers.path(T.B_NAME)))
    monkeypatch.setattr(T, "LINKS", 7)
    total, seen = Counter(), []
    for k in range(0, len(rows), 9):
        block = T.Block()
        for j in range(k, min(k + 9, len(rows)), 4):
            part = rows[j : min(j + 4, k + 9)]
            block.add([i for i, _ in part], [t for _, t in part], a, b)
        docs, last = block.rows(k)
        names = last.to_pylist()[0]
        total.update(dict(zip(names["pairs"], names["holders"], strict=True)))
        for r in docs.to_pylist():
            at = np.cumsum(r["steps"]).astype(int)
            seen.append((r["doc_id"], r["n_links"], Counter({(names["pairs"][x] >> 32, names["pairs"][x] & 0xFFFFFFFF): n for x, n in zip(at, r["times"], strict=True)})))
    expected, holders, _ = plain(rows, tokenizers)
    assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in total.items()} == dict(holders)
    assert [(i, n) for i, n, _ in seen] == [(r[0], r[4]) for r in expected] and all(sum(c.values()) == n for _, n, c in seen)


def test_weighed_documents_without_links():
    docs = pa.table({"doc_id": [1, 2, 3], "n_a": [1, 0, 1], "n_b": [1, 0, 1], "n_groups": [1, 0, 1], "n_links": [3, 0, 2], "groups_sha256": ["x", "", "y"], "steps": pa.array([[1, 2], [], [0]], pa.list_(pa.int32())), "times": pa.array([[1, 2], [], [2]], pa.list_(pa.int32()))})
    counts = pa.table({"at": [3, 0, 1, 2], "count": [5, 7, 11, 13], "best": [True, False, True, False]})
    got = T.weighed(docs, counts).to_pylist()
    assert [(r["n_best"], r["count_sum"]) for r in got] == [(3, 11 + 10), (0, 0), (0, 14)]


def test_empty(spark, empty):
    out, pairs = T.align(empty)
    assert out.count() == 0 and pairs.count() == 0


def test_query_over_the_smallest_tables(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert rows_of(T.op12_token_alignment(spark, DATA)) == sorted(plain(rows, tokenizers)[0], key=repr)


def test_ids_of_a_are_those_of_its_file(tokenizers):
    """Ids by ranks equal the file's own tokenizer: entries, all kinds of characters beside letters, digits and signs, long runs."""
    t, _ = tokenizers
    encode, raw = T.tokenizer_a(str(public_tokenizers.path(T.A_NAME)))
    said = [x.decode("utf-8", "ignore") for x in raw.to_pylist()[::7]] + [t for _, t in odd()]
    said += [f"a{chr(c)}b 1{chr(c)} {chr(c)}'s{chr(c)}{chr(c)}x" for c in range(1, 0x11000, 3) if not 0xD800 <= c < 0xE000]
    said += ["x" * 30_000, " " * 9_000, "\n" * 5_000 + "a", "1" * 7_000]
    assert encode(said) == [e.ids for e in t.encode_batch(said, add_special_tokens=False)]
