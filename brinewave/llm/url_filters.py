"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host with all its subdomains, a path prefix, or a pattern in which * stands for anything. Each rule is
filed under the one of its literal tokens that the fewest URLs have. A URL's own tokens fetch the rules filed under
them, and only those run regular expressions. Rules without a whole literal token are tried on every URL.

Up to INLINE_RULES rules the index is a constant of the plan, so judging is a projection without shuffle. Beyond that
the index is a table, joined by token to the distinct URLs.

Only DataFrame operations are used.

Defined cases. A null URL, or one without ://, has an empty host and an empty path; no host rule fits it and patterns see
the empty string. Very long URLs are judged whole; an empty table gives no rows. Of host rules that fit the longest
wins; of patterns a blocking one before an allowing one, then the longer; of rules of equal text the blocking one. Repeated rows get equal verdicts. Without rules everything is allowed. Extra columns are kept by `judge`; outputs
replace columns of the same names, and __ columns are reserved.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm.common import table

INLINE_RULES = 5_000
BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[^a-z0-9]+"
RULE_TYPE = "struct<name:string,block:boolean,weight:int,host:boolean,expression:string>"


@dataclass(frozen=True)
class Rule:
    """host rules are written host/path; patterns have no host and may hold * anywhere."""

    verdict: str
    text: str
    host_rule: bool = True

    @property
    def host(self) -> str:
        return self.text.partition("/")[0] if self.host_rule else ""

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if self.host_rule else ""

    @property
    def expression(self) -> str:
        """A regular expression for host + path; host rules are anchored at a label of the host, patterns are not."""
        quote = lambda s: re.sub(r"([^A-Za-z0-9_/\-])", r"\\\1", s)
        if self.host_rule:
            return f"^(?:[^/]*\\.)?{quote(self.host)}{quote(self.path)}"
        return ".*".join(quote(x) for x in self.text.split("*"))

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL has whole: those with a border inside the rule on both sides."""
        s = self.text.lower()
        if self.host_rule:
            s = f".{s}"
        found = []
        for m in re.finditer("[a-z0-9]+", s):
            before, after = s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]
            if before and after and before != "*" and after != "*":
                found.append(m.group())
        return found


#: The rules that every judgement knows; the longest that fits wins.
HOST_RULES = (
    Rule(ALLOW, "com/"),
    Rule(BLOCK, "example.com/en/"),
    Rule(ALLOW, "www.example.com/en/"),
    Rule(BLOCK, "net/es/"),
    Rule(BLOCK, "net/fr/"),
)
#: What decides where no host rule fits.
PATTERNS = tuple(Rule(BLOCK, x, False) for x in ("spam-farm.", ".cheap-pills.", "/ads/", "-casino.", "/click-*/track/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, F.translate(path, UPPER, LOWER)), TOKEN), lambda t: t != ""))


def rarity(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens; as many numbers as the rules have tokens."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    host, path = host_and_path(F.col("url"))
    found = urls.select(F.explode(F.array_intersect(tokens(host, path), F.array(*map(F.lit, known)))).alias("t"))
    return dict.fromkeys(known, 0) | {r.t: r.n for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str, list[dict]]:
    """token -> rules filed under it; rules without a token are under the empty string."""
    out: dict[str, list[dict]] = {"": []}
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        out.setdefault(key, []).append({"name": r.text, "block": r.verdict == BLOCK, "weight": len(r.text), "host": r.host_rule, "expression": r.expression})
    return out


def _best(fitting: Column) -> Column:
    """Of the rules that fit, the longest host rule, else a blocking pattern before an allowing one."""
    key = lambda r: F.struct(r["host"].alias("h"), F.when(r["host"], r["weight"]).otherwise(r["block"].cast("int")).alias("k"), r["weight"].alias("w"), r["name"].alias("name"), r["block"].alias("block"))
    return F.array_max(F.transform(fitting, key))


def _verdict(df: DataFrame) -> DataFrame:
    best = F.col("__best")
    return df.withColumns({
        "rule": F.when(best["h"], best["name"]),
        "verdict": F.when(F.coalesce(best["block"], F.lit(False)), F.lit(BLOCK)).otherwise(F.lit(ALLOW)),
        "pattern": F.when(~best["h"], best["name"]),
    }).drop("__best")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERNS, *, counts: dict[str, int] | None = None, inline_rules: int = INLINE_RULES) -> DataFrame:
    """The pages with host, path, rule (the host rule that decides, else null), verdict, and the pattern that decides, if one does."""
    counts = rarity(pages.select("url"), rules) if counts is None else counts
    filed = index(rules, counts)
    host, path = host_and_path(F.col("url"))
    whole = F.concat(F.col("host"), F.col("path"))
    if len(rules) <= inline_rules:
        by = F.from_json(F.lit(json.dumps(filed)), f"map<string,array<{RULE_TYPE}>>")
        candidates = F.flatten(F.transform(F.array_append(tokens(F.col("host"), F.col("path")), F.lit("")), lambda t: F.coalesce(F.try_element_at(by, t), F.array().cast(f"array<{RULE_TYPE}>"))))
        fitting = F.filter(candidates, lambda r: F.rlike(whole, r["expression"]))
        return _verdict(pages.withColumns({"host": host, "path": path}).withColumn("__best", _best(fitting)))
    spark = pages.sparkSession
    rows = [(t, r["name"], r["block"], r["weight"], r["host"], r["expression"]) for t, rs in filed.items() if t for r in rs]
    table_ = spark.createDataFrame(rows, "token string, name string, block boolean, weight int, host_rule boolean, expression string")
    urls = pages.select(F.coalesce("url", F.lit("")).alias("__url")).distinct()
    h, p = host_and_path(F.col("__url"))
    parts = urls.select("__url", h.alias("__h"), p.alias("__p"))
    split = parts.withColumn("token", F.explode(tokens(F.col("__h"), F.col("__p"))))
    hit = split.join(table_, "token").where(F.rlike(F.concat("__h", "__p"), F.col("expression"))).select("__url", "name", "block", "weight", "host_rule", "expression")
    if filed[""]:  # rules without a token meet every URL, as a constant and not by a key that all URLs share
        free = F.from_json(F.lit(json.dumps(filed[""])), f"array<{RULE_TYPE}>")
        met = parts.select("__url", F.explode(F.filter(free, lambda r: F.rlike(F.concat("__h", "__p"), r["expression"]))).alias("r"))
        hit = hit.unionByName(met.select("__url", "r.name", "r.block", "r.weight", F.col("r.host").alias("host_rule"), "r.expression"))
    rule = F.struct("name", "block", "weight", F.col("host_rule").alias("host"), "expression")
    rank = F.struct("host_rule", F.when(F.col("host_rule"), F.col("weight")).otherwise(F.col("block").cast("int")), "weight", "name", "block")
    best = hit.groupBy("__url").agg(F.max_by(rule, rank).alias("__r"))
    out = pages.withColumns({"host": host, "path": path, "__url": F.coalesce("url", F.lit(""))}).join(best, "__url", "left")
    return _verdict(out.withColumn("__best", _best(F.when(F.col("__r").isNotNull(), F.array("__r")))).drop("__url", "__r"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


OP7_SQL = r"""
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from cut
), judged as (
  select page_id, host, path,
         case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
              when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
              when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
         case when regexp_matches(host || path, '/click-.*/track/') then '/click-*/track/' end as p5,
         case when contains(host || path, 'spam-farm.') then 'spam-farm.' end as p1,
         case when contains(host || path, '.cheap-pills.') then '.cheap-pills.' end as p2,
         case when contains(host || path, '/ads/') then '/ads/' end as p3,
         case when contains(host || path, '-casino.') then '-casino.' end as p4
  from parts
)
select page_id, host, path, rule,
       case when rule is not null then case when rule in ('com/', 'www.example.com/en/') then 'allow' else 'block' end
            when coalesce(p5, p2, p1, p4, p3) is not null then 'block' else 'allow' end as verdict,
       case when rule is null then coalesce(p5, p2, p1, p4, p3) end as pattern
from judged
"""
