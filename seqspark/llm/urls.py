"""URL filters: rules by host and path, and exact lists held as cascades of Bloom filters. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: (verdict, host, path): a rule holds for its host and all subdomains where the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that put the urls of a host on the list of the query, as whole parts of its name.
WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "warez")
#: A bitmap has at most so many bits, so many listed keys share one, and filters up to so many bytes travel within the plan.
BITMAP_BITS, PART_KEYS, MOST_BYTES = 32768, 1024, 1 << 18
#: Copies of each filter where filters are joined: rows of one key, however many, go to as many tasks.
COPIES = 16
MOST_LEVELS = 99
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that holds, of equally long ones the least by text; null if none does."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))[::-1]:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _hashed(keys: DataFrame, parts: int) -> DataFrame:
    """keys with two independent hashes of key, and the part that its bits are in."""
    two = keys.withColumn("h", F.xxhash64("key")).withColumn("g", F.xxhash64(F.lit(7), "key"))
    return two.withColumn("part", F.pmod(F.xxhash64(F.lit(-1), "h", "g"), F.lit(parts)).cast("int"))


@dataclass
class Cascade:
    """Bloom filters by level. Level 1 holds the listed keys, each further one those keys of the other kind that the level above
    accepts wrongly, until none is left: a key of the universe is listed if the first level that rejects it has an even number.
    A level's filter is a bitmap for each part of the keys. As long as all are small they are literals of the plan, and later a
    table (part, l1, l2, ...) that is joined by part."""

    parts: int
    bits: list[int] = field(default_factory=list)
    probes: list[int] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)
    held: list[bytes] | None = field(default_factory=list)

    def _places(self, level: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(100 * level + i), "h", "g"), F.lit(self.bits[level])).cast("int") for i in range(self.probes[level])]

    def add(self, keys: DataFrame, n: int, probes: int, most_bytes: int) -> None:
        """A level that holds keys (h, g, part), n of them."""
        level = len(self.bits)
        self.bits.append(min(BITMAP_BITS, 8 * ceil(max(64, 1.4427 * probes * n / self.parts) / 8)))
        self.probes.append(probes)
        bitmaps = keys.select("part", F.explode(F.array(*self._places(level))).alias("place")).groupBy("part").agg(F.bitmap_construct_agg("place").alias("b"))
        size = self.bits[level] // 8
        self.tables.append(settle(bitmaps.select("part", F.substring("b", 1, size).alias("b")), "cascade"))
        if self.held is not None and sum(self.bits) // 8 * self.parts <= most_bytes:
            rows = {r["part"]: bytes(r["b"]) for r in self.tables[level].collect()}  # most_bytes at most
            self.held.append(b"".join(rows.get(p, bytes(size)) for p in range(self.parts)))
        else:
            self.held = None

    def _accepts(self, level: int, filters: Column, base: Column) -> Column:
        out = F.lit(True)
        for place in self._places(level):
            byte = F.ascii(F.decode(F.substring(filters, base + F.floor(place / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            out = out & (F.getbit(byte, F.pmod(place, F.lit(8))) == 1)
        return out

    def _joined(self, keys: DataFrame, tables: list[DataFrame], copies: int) -> DataFrame:
        filters = tables[0].select("part", F.col("b").alias("b0"))
        for i, t in enumerate(tables[1:], 1):
            filters = filters.join(t.select("part", F.col("b").alias(f"b{i}")), "part", "full")
        if copies == 1:
            return keys.join(filters, "part", "left")
        spread = filters.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return keys.withColumn("copy", F.floor(F.rand(1) * copies).cast("int")).join(spread, ["part", "copy"], "left")

    def accepted(self, keys: DataFrame, level: int) -> DataFrame:
        """Those of keys (h, g, part) that a level accepts."""
        if self.held is not None:
            return keys.where(self._accepts(level, F.lit(self.held[level]), F.col("part") * (self.bits[level] // 8)))
        joined = self._joined(keys, [self.tables[level]], 1)
        return joined.where(F.col("b0").isNotNull() & self._accepts(level, F.col("b0"), F.lit(0))).select(*keys.columns)

    def member(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (key, ...) with the boolean name: whether key is listed. Exact for all keys of the universe."""
        asked = _hashed(rows, self.parts)
        if not self.bits:
            return rows.withColumn(name, F.lit(False))
        if self.held is None:
            asked = self._joined(asked, self.tables, COPIES)
        answer = F.lit(len(self.bits) % 2 == 1)
        for level in reversed(range(len(self.bits))):
            if self.held is not None:
                accepts = self._accepts(level, F.lit(self.held[level]), F.col("part") * (self.bits[level] // 8))
            else:  # a part without a bitmap in a level accepts nothing there
                accepts = F.coalesce(self._accepts(level, F.col(f"b{level}"), F.lit(0)), F.lit(False))
            answer = F.when(accepts, answer).otherwise(F.lit(level % 2 == 1))
        return asked.select(*rows.columns, answer.alias(name))


def cascade(keys: DataFrame, part_keys: int = PART_KEYS, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade of keys (key string, listed boolean): the whole universe, each key once.

    Level 1 has so many bits a key that about as many other keys as listed ones get through; each further level lets half of what
    it is asked through, so sizes halve. Each round is a written table; none of it is a join unless filters are larger than
    most_bytes.
    """
    counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    probes = min(20, max(1, ceil(log2(max(1.0, others / max(1, listed)) * 1.4143))))
    out = Cascade(max(1, ceil(listed / part_keys), ceil(others / 2**probes / (16 * part_keys))))
    if not listed:
        return out
    both = settle(_hashed(keys, out.parts).select("h", "g", "part", "listed"), "cascade")
    inside, outside, n = both.where("listed").drop("listed"), both.where("NOT listed").drop("listed"), listed
    while n:
        if len(out.bits) == MOST_LEVELS:
            raise ValueError("a listed key and another one have the same hashes")
        out.add(inside, n, probes, most_bytes)
        wrong = settle(out.accepted(outside, len(out.bits) - 1), "cascade")
        inside, outside, n, probes = wrong, inside, wrong.count(), 1
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", part_keys: int = PART_KEYS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict), one row for each row of pages.

    verdict is that of the longest rule that holds, else block for urls whose host and path, put together, are a key of listed
    (a table whose first column holds them), else allow. The list is met through a cascade of Bloom filters that is exact as all keys
    of pages were its universe. Null urls and those without :// have an empty host and path, no rule, and are never listed; rules
    with the path / don't hold for an empty path; repeated rows fare alike, also in the list; null keys of the list count for nothing, nor
    do those that no page has; rows without page_id are judged like others; an empty table gives no rows; other columns don't matter.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    own = listed.select(F.col(f"`{listed.columns[0]}`").cast("string").alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("here"))
    there = rows.select("key", F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(own).where("key <> ''")
    # Listed keys that no page has would only make the filters larger.
    universe = settle(there.groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).where("here").select("key", "listed"), "universe")
    told = cascade(universe, part_keys, most_bytes).member(rows, "told")
    best = told.withColumn("best", rule_for(F.col("host"), F.col("path"), rules)).withColumn("listed", F.col("told") & (F.col("key") != ""))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), "listed", verdict.alias("verdict"))


def suspects(pages: DataFrame, words=WORDS, url: str = "url") -> DataFrame:
    """(key) of the urls whose host has one of words among the parts of its name, parted by dots and hyphens."""
    host = host_of(F.col(url))
    return pages.where(host.rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")).select(F.concat(host, path_of(F.col(url))).alias("key"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, suspects(pages))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (
  SELECT *, regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|porn|spam|warez)([.-]|$)') AS listed, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, listed,
  CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
    ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM r"""

QUERIES = {"op13_urls": op13_urls}
ORACLE = {"op13_urls": ORACLE_SQL}
