import re
from urllib.parse import urlsplit  # noqa: F401

import pytest

from brinewave.llm import url_filters as U

URLS = [
    "http://example.com/en/1", "https://www.EXAMPLE.com/en/a?x#y", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/",
    "http://spam-farm.example.org/a", "http://shop.cheap-pills.org/", "http://x.org/ads/1", "http://x.org/click-9/track/2", "http://x.org/?u=/ads/", "http://a.com", "http://a.com?x=/",
    "ftp://b.com:21/x", "com/", "", None, "://", "http://///", "http://ÄÖ.com/Ü", "http://example.com/EN/1", "http://best-casino.net/es/", "http://a.b/%0A\n/ads/x",
]


def by_hand(url):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]
    best = None
    for r in U.HOST_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    if best:
        return host, path, best.text, best.verdict
    hit = any(re.search(".*".join(map(re.escape, p.text.split("*"))), host + path) for p in U.PATTERNS)
    return host, path, None, "block" if hit else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, u, "old", 1) for k, u in enumerate(URLS * 2)], "page_id long, url string, rule string, weight int")


@pytest.mark.parametrize("inline", [5000, 0])
def test_by_hand(pages, inline):
    rows = U.judge(pages, inline_rules=inline).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == by_hand(URLS[r.page_id % len(URLS)])


def test_rules_lie_under_their_rarest_token(pages):
    counts = U.rarity(pages.select("url"), U.HOST_RULES + U.PATTERNS)
    filed = U.index(U.HOST_RULES + U.PATTERNS, counts)
    assert {r["name"] for r in filed["cheap"] + filed.get("pills", [])} & {".cheap-pills."}
    assert "example.com/en/" not in {r["name"] for r in filed["com"]}


def test_tokens_have_borders():
    assert U.Rule("block", "spam-farm.", False).tokens == ["farm"]
    assert U.Rule("block", "/click-*/track/", False).tokens == ["click", "track"]
    assert U.Rule("block", "x.com/abc").tokens == ["x", "com"]


def test_many_rules(pages):
    more = tuple(U.Rule("block", f"/made-up-{k}/", False) for k in range(6000))
    rows = U.judge(pages, U.HOST_RULES + U.PATTERNS + more).collect()
    assert all((r.host, r.path, r.rule, r.verdict) == by_hand(URLS[r.page_id % len(URLS)]) for r in rows)


def test_without_rules_or_rows(spark, pages):
    assert {r.verdict for r in U.judge(pages, ()).collect()} == {"allow"}
    assert U.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_rules_of_equal_text_on_both_sides_of_the_limit(spark, swap):
    """Of rules with equal texts the blocking one decides, in either order, as a constant and as a joined table."""
    pairs = [U.Rule("allow", "a.com/"), U.Rule("block", "a.com/"), U.Rule("allow", "/ads/", False), U.Rule("block", "/ads/", False)]
    rules = tuple(pairs[::-1] if swap else pairs)
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/ads/1"), (3, "http://b.org/")], "page_id long, url string")
    verdicts = [{r.page_id: (r.rule, r.verdict) for r in U.judge(df, rules, inline_rules=n).collect()} for n in (0, 3, 4, 5_000)]
    assert all(v == {1: ("a.com/", "block"), 2: (None, "block"), 3: (None, "allow")} for v in verdicts)
