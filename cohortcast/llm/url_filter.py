"""URL filters: path rules, then a block list held in a cascade of Bloom filters.

Level 1 of the cascade encodes the listed keys; level 2 the keys of the corpus's complete key universe
(hosts and their parent domains) that level 1 takes for listed ones; level 3 the listed keys that level
2 takes for such; and so on until none is left. The first level that doesn't have a key settles it, so
membership is exact for every key of the corpus, without a join: the levels are constants of a few bits
a listed key (`max_bits` bounds each; beyond it the list is applied by a join instead).

Building reads the distinct keys once, by aggregation; a host with a third of all rows is one key.
Null urls and urls without :// have an empty host and path, no rule, and are allowed. Repeated rows are
judged alike; empty tables give empty results; an empty list blocks nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import ascii_lower, let, packed, unpacked
from .graphs import ready

#: The default block list; a domain stands for its subdomains as well.
BLOCKED_DOMAINS = ["adult-x.example.com", "adult-x.example.net", "ads-track.example.com", "casino-win.example.com", "casino-win.example.net", "cheap-pills.example.com", "cheap-pills.example.net", "free-bets.example.com", "free-bets.example.net", "spam-farm.example.com", "spam-farm.example.org"]


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domains_of(host: Column) -> Column:
    """The host and each of its parent domains: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return let(parts, lambda p: F.transform(p, lambda x, i: F.array_join(F.slice(p, i + 1, F.size(p)), ".")))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(h)), F.lit(bits)) for h in range(hashes)]


class Cascade:
    """Levels of (bits, hash functions, words); `has` is their verdict as a column."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    def _in_level(self, key: Column, k: int) -> Column:
        bits, hashes, words = self.levels[k]
        held = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded into one constant
        hit = F.lit(True)
        for at in _places(key, k, bits, hashes):
            hit = hit & (F.expr("1L") == F.call_function("shiftright", F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")))
        return hit

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(self._in_level(key, k), out).otherwise(F.lit(k % 2 == 1))
        return out if self.levels else F.lit(False)


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 0.05, rate: float = 0.5, max_bits: int = 1 << 23) -> Cascade | None:
    """A cascade over tables of distinct keys (column key). None if a level would need more than max_bits."""
    ready(listed.sparkSession)
    inside = listed.join(universe, "key", "left_semi").distinct().checkpoint()
    outside = universe.join(listed, "key", "left_anti").checkpoint()
    levels: list[tuple[int, int, list[int]]] = []
    mine, theirs = inside, outside
    while n := mine.count():
        p = first_rate if not levels else rate
        bits = max(64, 1 << math.ceil(math.log2(n * -math.log(p) / math.log(2) ** 2)))
        if bits > max_bits:
            return None
        hashes = max(1, round(bits / n * math.log(2)) if len(levels) == 0 else 1)
        hashes, k = min(hashes, 8), len(levels)
        at = mine.select(F.explode(F.array(*_places(F.col("key"), k, bits, hashes))).alias("at"))
        rows = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v")).collect()  # at most bits / 64 rows
        words = [0] * (bits // 64)
        for r in rows:
            words[r["w"]] = r["v"]
        levels.append((bits, hashes, words))
        hit = Cascade([*[(64, 0, [])] * k, levels[k]])._in_level(F.col("key"), k)
        mine, theirs = theirs.where(hit).checkpoint(), mine
    return Cascade(levels)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, "host/path") that fits the host or a parent domain of it, and the path's beginning."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked: DataFrame | list[str] | None = None, url_col: str = "url", max_bits: int = 1 << 23) -> DataFrame:
    """pages with host, path, rule and verdict (such columns of pages are replaced): the longest rule's
    verdict, else block where the host or a parent domain is listed, else allow."""
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict"]
    others = [c for c in pages.columns if c not in made]
    judged = pages.select(packed(others).alias("_pages"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    blocked = BLOCKED_DOMAINS if blocked is None else blocked
    listed = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(b,) for b in blocked], "key string")
    listed = listed.toDF("key").select(ascii_lower(F.col("key")).alias("key")).distinct()
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).where("host <> ''").distinct()
    cascade = build_cascade(listed, hosts.select(F.explode(domains_of(F.col("host"))).alias("key")).distinct(), max_bits=max_bits)
    if cascade is None:
        bad = hosts.select("host", F.explode(domains_of(F.col("host"))).alias("key")).join(listed, "key", "left_semi").select("host").distinct().withColumn("_bad", F.lit(True))
        judged = judged.join(bad, "host", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    else:
        judged = judged.withColumn("_bad", F.exists(domains_of(F.col("host")), cascade.has))
    verdicts = {rule: verdict for verdict, rule in rules}
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    return judged.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("_bad"), "block").otherwise("allow"))).select(*unpacked("_pages", others), *made)
