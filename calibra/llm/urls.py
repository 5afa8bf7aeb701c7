"""URL filter: host and path rules, looked up in Bloom filter cascades made and asked with SQL functions alone.

A cascade holds a set of listed keys. Its first level is a Bloom filter of them, the second one of those keys of the
universe that pass the first without being listed, the third one of the listed keys that pass the second, and so on
until a level has no false positive. The universe is every key that any row can ask for, so the answer is exact for
each of them: the parity of the first level that a key doesn't pass. A level's bits travel as one literal, some ten to
thirty bits for a listed key, so a list of MAX_LISTED keys takes a few MB; only beyond, a list is looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LISTED = 1_000_000
#: (verdict, host, path); a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts blocked where no rule fits.
LISTED_HOSTS = ("spam-farm.example.org",)

HOST_OF = "^[^/?#]*"
PATH_OF = "^[^/?#]*([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    lower = F.translate(F.regexp_extract(rest, HOST_OF, 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, PATH_OF, 1), F.lit(""))


def _bits(key: Column, level: int, m: int, k: int) -> list[Column]:
    """The places of a key in a level's m bits."""
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(m)) for i in range(k)]


class Cascade:
    """levels: (bits, hashes, words of 64 bits), first to last."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, list[int]]] = []

    def _passes(self, key: Column, level: int) -> Column:
        m, k, words = self.levels[level]
        have = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # one literal, whatever the number of words
        hit = F.lit(True)
        for b in _bits(key, level, m, k):
            hit = hit & (F.getbit(F.element_at(have, (F.floor(b / 64) + 1).cast("int")), (b % 64).cast("int")) == 1)
        return hit

    def _add(self, keys: DataFrame, n: int, p: float) -> None:
        level, m = len(self.levels), max(64, 64 * math.ceil(-n * math.log(p) / math.log(2) ** 2 / 64))
        k = max(1, round(m / n * math.log(2))) if n else 1
        k = min(k, 8)
        places = keys.select(F.explode(F.array(*_bits(F.col("key"), level, m, k))).alias("b"))
        rows = places.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("v")).collect()
        words = dict((r.w, r.v) for r in rows)
        self.levels.append((m, k, [words.get(w, 0) for w in range(m // 64)]))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """listed, universe: a column key each. Listed keys needn't stand in the universe."""
        out, own = cls(), listed.where("key is not null").distinct().cache()
        n, others = own.count(), universe.where("key is not null").select("key")
        if not n:
            return out
        size = max(1, others.agg(F.approx_count_distinct("key")).first()[0])
        out._add(own, n, min(0.5, math.sqrt(0.5) * n / size if size > n else 0.5))
        wrong = others.where(out._passes(F.col("key"), 0)).distinct().join(own, "key", "left_anti").cache()
        inside, outside, made = own, wrong, [own, wrong]
        while (count := outside.count()) and len(out.levels) < 64:
            level = len(out.levels)
            out._add(outside, count, 0.5)
            inside, outside = outside, inside.where(out._passes(F.col("key"), level)).cache()
            made.append(outside)
        for keys in made:
            keys.unpersist()
        if count:
            raise RuntimeError("two keys share every bit on 64 levels")
        return out

    def has(self, key: Column) -> Column:
        """Whether a key of the universe or the list is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self._passes(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _suffixes(host: Column, most: int) -> Column:
    """The last 1 to most labels of a host, joined, longest first."""
    labels = F.split(host, "\\.", -1)
    return F.transform(F.sequence(F.least(F.lit(most), F.size(labels)), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed_hosts: Sequence[str] = LISTED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    rule: host and path of the longest rule that fits, null if none does; verdict: allow or block, the rule's, else
    block for a host that is or lies below a listed one, else allow. Null urls and urls without :// have an empty host
    and path, and no rule. Repeated rows and null ids give a row each; an empty table an empty one. No host, path or
    list is shuffled for the lookups. Other columns aren't read. Equally long rules are taken by the longer host.
    """
    spark = pages.sparkSession
    if len(rules) + len(listed_hosts) > MAX_LISTED:
        return _by_join(pages, rules, listed_hosts, id_col, url_col)
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = max([1, *(h.count(".") + 1 for _, h, _ in rules), *(h.count(".") + 1 for h in listed_hosts)])
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    hosts = _suffixes(F.col("host"), labels)
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.left(F.col("path"), F.lit(n))) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    rows = rows.withColumn("hosts", hosts).withColumn("keys", F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("key"))), asc=False).key)
    urls, sites = rows.select(F.explode("keys").alias("key")), rows.select(F.explode("hosts").alias("key"))
    block, allow = (Cascade.build(_keys(spark, [h + p for v, h, p in rules if v == verdict]), urls) for verdict in ("block", "allow"))
    listed = Cascade.build(_keys(spark, listed_hosts), sites)
    rule = F.get(F.filter(F.col("keys"), lambda k: block.has(k) | allow.has(k)), F.lit(0))
    rows = rows.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNotNull(), F.when(allow.has(F.col("rule")), "allow").otherwise("block")).when(F.exists("hosts", listed.has), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _by_join(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed_hosts: Sequence[str], id_col: str, url_col: str) -> DataFrame:
    """As filter_urls, for lists too long for literals: candidate keys are joined to the lists, and the longest hit of a row kept."""
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    labels = max([1, *(h.count(".") + 1 for _, h, _ in rules), *(h.count(".") + 1 for h in listed_hosts)])
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    distinct = rows.select("host", "path").distinct()
    asked = distinct.select("host", "path", F.explode(_suffixes(F.col("host"), labels)).alias("h"))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.left(F.col("path"), F.lit(n))) for n in lengths] or [F.lit(None).cast("string")])
    rule_rows = spark.createDataFrame([(h + p, v) for v, h, p in rules], "key string, v string").groupBy("key").agg(F.min("v").alias("v"))
    site_rows = spark.createDataFrame([(h,) for h in listed_hosts], "h string").distinct().withColumn("site", F.lit(True))
    hit = asked.select("host", "path", F.explode(prefixes).alias("p"), "h").where("p is not null").withColumn("key", F.concat("h", "p")).join(rule_rows, "key")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("key"), F.length("h"), "key", "v")).alias("m")).select("host", "path", "m.key", "m.v")
    sites = asked.join(site_rows, "h").select("host", "path", "site").distinct()
    out = distinct.join(best, ["host", "path"], "left").join(sites, ["host", "path"], "left")
    verdict = F.coalesce("v", F.when(F.col("site"), "block").otherwise("allow"))
    return rows.join(out, ["host", "path"]).select("page_id", "host", "path", F.col("key").alias("rule"), verdict.alias("verdict"))
