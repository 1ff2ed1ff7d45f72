import hashlib

import pytest
from pyspark.sql import functions as F

from brinewave.llm import warc_index as W

LONG = "<p>" + "same " * 40


@pytest.fixture(scope="module")
def rows():
    rows = [(k, f"http://h{k % 5}.Example.com:80/p/{k}?q={k} x#f", f"<p>{k}" * 50) for k in range(60)]
    rows += [(100 + k, f"https://www.e.org/{k}", LONG) for k in range(30)]  # copies
    rows += [(200 + k, "http://hot.example.net/", f"hot {k} " * 30) for k in range(40)]  # one url
    rows += [(300, None, None), (301, "no scheme", ""), (302, "http://é.fr/ü\n2", "kurz"), (303, "http://é.fr/ü\n2", "kurz"), (None, "http://n.fr/", LONG), (5, rows[5][1], rows[5][2]), (304, "http://big.fr/", "é" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string").repartition(3)


def by_hand(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in first and sum((x or "").encode() == p for _, _, x in rows) > 1 and i != first[p]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


def test_all_pages_by_lookup(spark, pages, rows, monkeypatch):
    folder = W.fresh_path(spark, "test-warc")
    captures = W.write_archives(W.decided(pages), folder)
    index = W.build_index(captures, folder, block_lines=7)
    got = W.lookup(pages.select(W.key_of(F.col("url")).alias("key")), index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == by_hand(rows)
    assert {r.key for r in got if r.page_id == 302} == {"fr,é)/ü%202"}
    none = spark.createDataFrame([("zzz)/",), ("",)], "key string")
    assert W.lookup(none, index).count() == 0


def test_archives_are_readable_in_sequence(spark, pages, rows, tmp_path):
    captures = W.write_archives(W.decided(pages), str(tmp_path))
    n = 0
    for f in tmp_path.glob("*.warc.gz"):
        for raw in W.open_archive(f.read_bytes()):
            fields, _, payload = W.parse_record(raw)
            n += 1
            assert (len(payload) == 0) or fields["WARC-Type"] == "response"
    assert n == len(rows) == captures.count()


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = W.archive(none)
    assert index.parts == () and W.lookup(spark.createDataFrame([("a",)], "key string"), index).count() == 0


def test_a_broken_record_is_an_error():
    raw = W.record(1, "http://a/", b"x" * 10, "d", "response", None)
    with pytest.raises(ValueError, match="length"):
        W.parse_record(raw[:-1])
    with pytest.raises(ValueError, match="digest"):
        W.read_record(raw)
