"""URL filters: a Bloom filter cascade over the corpus's whole key universe, exact and without joins.

A url's keys are its host, the host's parent domains of two labels or more, and host and path together: a list can name
domains, which covers their subdomains, and single urls. Level 1 encodes the listed keys of the corpus; level 2 the keys
of the rest that level 1 wrongly admits; level 3 the listed keys that level 2 wrongly admits, and so on until a level
admits nothing wrongly. A key of the corpus is listed if and only if the number of levels that admit it before the first
refusal is odd; no key of the corpus is judged wrongly, whatever the filters' rates.

The levels are bit arrays in the plan as literals. Keys are dealt by hash into as many parts as it takes to keep each
part's levels, planned from the counts, within ``max_bits``; each part has a cascade of its own. Of many parts, each
PASS are applied in one pass over the urls, and the answers so far are written between passes: a longer list costs more
passes, never a join and never a larger plan.

Everything is DataFrame expressions. Edge cases: a null url or one without ``://`` has empty host and path, no keys,
and is allowed; an empty table gives no rows; an empty list lists nothing; repeated rows are judged row by row; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.runtime import Scratch


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Explicit rules; of those that fit a url the longest wins.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Families whose urls the registered query's list names one by one; those of bad_hosts.txt are listed as domains.
FEED = ("spam-farm", "free-bets", "cheap-pills")
#: Bits of a part's levels, as planned (512 KiB), and parts that are applied in one pass.
MAX_BITS, PASS = 1 << 22, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """Host and path, the host, and its parent domains down to two labels; no empty key."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    domains = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.filter(F.array_distinct(F.concat(domains, F.array(F.concat(host, path)))), lambda k: k != "")


class Level(NamedTuple):
    bits: int
    hashes: int
    words: list[int]


def _places(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key: double hashing of two 64-bit hashes."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * seed + i)), F.lit(1 << 31)) for i in (0, 1))
    return [F.pmod(a + F.lit(i) * (b.bitwiseOR(F.lit(1))), F.lit(bits)) for i in range(hashes)]


def _admits(key: Column, seed: int, level: Level) -> Column:
    words = F.expr("array(" + ",".join(f"{w}L" if w != -(1 << 63) else f"({w + 1}L - 1L)" for w in level.words) + ")")
    ok = F.lit(True)
    for p in _places(key, seed, level.bits, level.hashes):
        ok &= F.getbit(F.element_at(words, F.shiftright(p, 6).cast("int") + 1), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return ok


class Cascade(NamedTuple):
    """Built levels; ``listed(key)`` holds for exactly the listed keys of the universe it was built over."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            verdict = F.when(_admits(key, i, self.levels[i]), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits (whole words) and hashes of a Bloom filter of n keys."""
    bits = max(64, math.ceil(n * 1.4427 * math.log2(1 / rate)))
    return -(-bits // 64) * 64, max(1, round(math.log2(1 / rate)))


def build_cascade(universe: DataFrame) -> Cascade:
    """Cascade over ``universe`` (key string, listed boolean; each key once).

    Each level is one aggregation of its keys' bits into words; only those words reach the driver.
    """
    include, against = universe.filter("listed").select("key"), universe.filter("NOT listed").select("key")
    n, others = (r := universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())[0], r[1]
    if not n:
        return Cascade(())
    levels, rate = [], min(0.5, max(n, 1) / max(others, 1) * math.sqrt(0.5))
    while True:
        bits, hashes = _shape(n, rate)
        place = F.explode(F.array(*_places(F.col("key"), len(levels), bits, hashes)))
        words = include.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v"))
        got = {r["w"]: r["v"] for r in words.collect()}  # at most bits / 64 rows
        levels.append(Level(bits, hashes, [got.get(i, 0) for i in range(bits // 64)]))
        wrong = against.filter(_admits(F.col("key"), len(levels) - 1, levels[-1]))
        n, rate = wrong.count(), 0.5
        if not n:
            return Cascade(tuple(levels))
        include, against = wrong, include


def planned_bits(n: int, others: int) -> int:
    """Bits of all levels over n listed keys and others, about: the first level, then one and a half bits for each key that
    is wrongly admitted, halving from the listed keys on."""
    rate = min(0.5, max(n, 1) / max(others, 1) * math.sqrt(0.5))
    return _shape(n, rate)[0] + 4 * 64 + int(1.4427 * (others * rate + n))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def cascades(universe: DataFrame, max_bits: int = MAX_BITS) -> list[Cascade]:
    """The cascades of the parts of ``universe``."""
    n, others = (r := universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())[0], r[1]
    parts = max(1, -(-planned_bits(n, others) // max_bits))
    return [build_cascade(universe.filter(_part(F.col("key"), parts) == i)) for i in range(parts)]


def _among(levels: list[Cascade], start: int):
    """Whether a key is listed by its part, for the parts of the pass that begins at start."""

    def listed(key: Column) -> Column:
        part, verdict = _part(key, len(levels)), F.lit(False)
        for i in range(start, min(start + PASS, len(levels))):
            verdict = F.when(part == i, levels[i].listed(key)).otherwise(verdict)
        return verdict

    return listed


def key_universe(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Every key of the corpus once, with whether it is listed (``listed``: one column ``key``)."""
    host, path = host_path(F.col(url_col))
    seen = pages.select(host.alias("h"), path.alias("p")).select(F.explode(keys_of(F.col("h"), F.col("p"))).alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("seen"))
    wanted = listed.select(F.col("key"), F.lit(True).alias("listed"), F.lit(False).alias("seen"))
    both = seen.unionByName(wanted).groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or("seen").alias("seen"))
    return both.filter("seen AND key IS NOT NULL").select("key", "listed")


def _rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """id, host, path, rule, verdict and ``listed`` (the cascade's answer) for every page."""
    scratch = Scratch(pages.sparkSession)
    universe = scratch.keep(key_universe(pages, listed, url_col))
    levels = cascades(universe, max_bits)
    scratch.drop(universe)
    host, path = host_path(F.col(url_col))
    out = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    for start in range(0, len(levels), PASS):
        mine = F.exists(keys_of(F.col("host"), F.col("path")), _among(levels, start))
        before = out
        out = before.withColumn("listed", mine if not start else F.col("listed") | mine)
        if start + PASS < len(levels):
            out = scratch.keep(out)
            scratch.drop(before)
    ruled = out.withColumn("r", _rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")


def bad_hosts(spark: SparkSession) -> DataFrame:
    """The keys of bad_hosts.txt, a list for ``listed``: one column ``key``."""
    lines = (Path(__file__).parent / "bad_hosts.txt").read_text().split("\n")
    return spark.createDataFrame([(k,) for k in lines if k and not k.startswith("#")], "key string")


def listed_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The registered query's list: the domains of bad_hosts.txt but those of the families in FEED, and of these every url
    that occurs, by itself, as a feed of reported urls has them. Grows with the corpus: thousands at 64,000 pages."""
    spark, (host, path) = pages.sparkSession, host_path(F.col(url_col))
    of_feed = F.lit(False)
    for family in FEED:
        of_feed |= F.col("key").startswith(family + ".")
    feed = pages.select(host.alias("h"), path.alias("p")).filter(F.col("h").rlike(rf"(^|\.)({'|'.join(FEED)})\.example\.(com|net|org)$"))
    return bad_hosts(spark).filter(~of_feed).unionByName(feed.select(F.concat("h", "p").alias("key")).distinct())


def op2_url_cascade(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; where no rule fits, the cascade over ``listed_keys`` decides."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, listed_keys(pages))


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    ordered = sorted(RULES, key=lambda r: -len(r.host + r.path))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ordered]
    lines = (Path(__file__).parent / "bad_hosts.txt").read_text().split("\n")
    listed = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in lines if k and not k.startswith("#"))
    return rf"""
WITH s AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{r.host}{r.path}'" for f, r in fits)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits)} END AS ruled, ({listed}) AS listed FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r"""
