"""URL filters: a cascade of Bloom filters gives exact membership in a list without joins.

A rule is a host and the start of a path (`example.com/en/`). Each url has a few candidate keys: every suffix of
its host at a dot, with every start of its path that is as long as some rule's path. The distinct candidates of all
urls are the complete key universe; the candidates equal to a rule are the listed keys. Level 1 of the cascade is a
Bloom filter of the listed keys; level 2 one of the unlisted keys that level 1 lets through; level 3 one of the
listed keys that level 2 lets through; and so on until nothing is let through wrongly. A key of the universe is
listed exactly if the first level that turns it away is an even one (or, if none does, if the number of levels is
odd). There is one cascade for blocking rules and one for allowing rules; of a url's listed candidates the longest
decides (of equally long ones the first in order), and urls without one are allowed.

Rules are given as Rule objects or, for long lists, as a table (host, path, allow). Filters are built in distributed
form (each task makes a partial bit array, arrays are merged by bitwise or) and have a checked size: if one would pass
max_filter_bytes, or two keys had the same hashes, the urls are judged by joins with the listed keys instead
(`judged_by_join`), with the same result. Keys are held as two independent 64-bit hashes.

A null url, one without `://` or one with an empty host has no candidates that match and is allowed. Repeated rows
are judged alike. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, col, join_classes, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, allow: bool) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, allow)


RULES = (rule("com/", True), rule("example.com/en/", False), rule("www.example.com/en/", True), rule("net/es/", False), rule("net/fr/", False))


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Suffixes of the host at dots, each with the starts of the path of the given lengths, longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring(path, 1, n).alias("start")) for n in sorted(path_lengths, reverse=True)]), lambda s: F.length(s["start"]) == s["n"])
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda s: F.concat(h, s["start"]))))
    by_length = F.transform(pairs, lambda k: F.struct((-F.length(k)).alias("order"), k.alias("key")))
    return F.transform(F.array_sort(by_length), lambda x: x["key"])


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, count: int) -> np.ndarray:
    """The bit numbers of each key at a level: rows are keys."""
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    for word in (np.uint64(level * 2 + 1), np.uint64(level * 2 + 2)):  # other positions at each level
        a = (a ^ (b >> np.uint64(29)) ^ word) * np.uint64(0x9E3779B97F4A7C15)
        b = (b ^ (a >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    steps = np.arange(count, dtype=np.uint64)
    return (a[:, None] + steps * (b | np.uint64(1))[:, None]) % np.uint64(bits)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def lets_through(self, h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
        at = _positions(h1, h2, number, self.bits, self.hashes)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level]

    @property
    def size_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for number, level in enumerate(self.levels):
            through = level.lets_through(h1[open_], h2[open_], number)
            out[open_[~through]] = number % 2 == 1
            open_ = open_[through]
        return out


def _bloom(keys: DataFrame, number: int, count: int, rate: float, max_bytes: int) -> Level:
    bits = max(64, -(-math.ceil(-count * math.log(rate) / math.log(2) ** 2) // 64) * 64)
    if bits // 8 > max_bytes:
        raise OverflowError(f"a filter of {bits // 8} bytes is over the limit of {max_bytes}")
    hashes_ = max(1, round(bits / count * math.log(2)))

    def partial(batches):
        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            at = _positions(b.column(0).to_numpy(), b.column(1).to_numpy(), number, bits, hashes_).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        full = np.nonzero(words)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(words[full].view(np.int64))], ["word", "bits"])

    merged = keys.select("h1", "h2").mapInArrow(partial, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = np.zeros(bits // 64, np.uint64)
    for batch in [merged.toArrow()]:  # at most bits / 64 rows, checked above
        words[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return Level(bits, hashes_, words)


def bounded_filter(keys: DataFrame, max_bytes: int, rate: float = 0.01) -> Level | None:
    """A filter of keys (h1, h2) of at most about max_bytes: it lets all of them through, and of others a share `rate`, more where the bytes do not suffice. None without keys."""
    count = keys.count()
    return _bloom(keys, 0, count, max(rate, math.exp(-8 * max_bytes / count * math.log(2) ** 2)), max_bytes + 8) if count else None


def build_cascade(universe: DataFrame, max_filter_bytes: int = 64 << 20) -> Cascade:
    """universe: h1, h2 and listed, one row for each key."""
    counts = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    listed, others = counts.get(True, 0), counts.get(False, 0)
    if not listed:
        return Cascade([])
    spark, levels = universe.sparkSession, []
    first_rate = min(0.5, max(1e-6, listed / max(1, others) / math.sqrt(2)))
    inside, outside, n = universe.filter("listed"), universe.filter("not listed"), listed
    while n:
        number = len(levels)
        if number == MAX_LEVELS:
            raise ArithmeticError("two keys of the universe have the same hashes")
        levels.append(_bloom(inside, number, n, first_rate if number == 0 else 0.5, max_filter_bytes))
        level = spark.sparkContext.broadcast(levels[-1])

        def through(batches, level=level, number=number):
            for b in batches:
                yield b.filter(pa.array(level.value.lets_through(b.column(0).to_numpy(), b.column(1).to_numpy(), number)))

        wrong = outside.select("h1", "h2").mapInArrow(through, "h1 long, h2 long")
        wrong = checkpointed(wrong)
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """key, n (length of the path) and blocked of each rule; of a host and path given twice the blocking rule counts."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.allow) for r in rules], "host string, path string, allow boolean")
    return rules.groupBy(F.concat("host", "path").alias("key"), F.length("path").alias("n")).agg((~F.bool_and("allow")).alias("blocked"))


def judged_by_join(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """key and blocked of the longest listed key of each row that has one. rows: row, keys; listed: key, blocked, n (urls that have the key)."""
    candidates = rows.select("row", F.explode("keys").alias("key"))
    found = join_classes(candidates, listed, ["key"])
    return found.groupBy("row").agg(F.min_by(F.struct("key", "blocked"), F.struct(-F.length("key"), "key")).alias("found")).select("row", "found.*")


def filter_urls(df: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of df."""
    listed = checkpointed(rule_table(df.sparkSession, rules))
    lengths = [r[0] for r in listed.select("n").distinct().orderBy("n").collect()]  # a row for each length of a path
    urls = df.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"))
    parts = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    counted = keyed.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    marked = counted.join(listed.select("key", "blocked").hint("merge"), "key", "left")  # one row for each key of the universe
    universe = checkpointed(marked.select("key", "n", "blocked", *[h.alias(x) for h, x in zip(hashes(F.col("key")), ("h1", "h2"))]))
    try:
        cascades = {name: build_cascade(universe.select("h1", "h2", F.coalesce(is_it, F.lit(False)).alias("listed")), max_filter_bytes) for name, is_it in (("blocked", F.col("blocked")), ("allowed", ~F.col("blocked")))}
    except ArithmeticError:  # OverflowError is one
        rows = checkpointed(keyed.withColumn("row", F.monotonically_increasing_id()))
        judged = judged_by_join(rows, universe.filter("blocked is not null").select("key", "blocked", "n"))
        verdict = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
        return rows.drop("keys").join(judged.hint("merge"), "row", "left").select("page_id", "host", "path", F.col("key").alias("rule"), verdict.alias("verdict"))
    shipped = df.sparkSession.sparkContext.broadcast(cascades)

    def judge(batches):
        found = shipped.value
        for b in batches:
            keys, h1, h2 = (b.column(n) for n in ("keys", "h1", "h2"))
            at, a1, a2 = keys.offsets.to_numpy(), h1.flatten().to_numpy(), h2.flatten().to_numpy()
            at = at - at[0]
            flags = {name: cascade.listed(a1, a2) for name, cascade in found.items()}
            hit = np.append(np.nonzero(flags["blocked"] | flags["allowed"])[0], len(a1))
            first = hit[np.searchsorted(hit, at[:-1])]  # the longest listed key, if it is the row's own
            has = first < at[1:]
            first = np.where(has, first, 0)
            words = keys.flatten()
            matched = words.take(pa.array(first, mask=~has)) if len(words) else pa.nulls(len(at) - 1, pa.string())
            blocks = has & flags["blocked"][first] if len(a1) else has
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), matched, pa.array(np.where(blocks, "block", "allow"), pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    hashed = keyed.select("page_id", "host", "path", "keys", F.transform("keys", lambda k: hashes(k)[0]).alias("h1"), F.transform("keys", lambda k: hashes(k)[1]).alias("h2"))
    id_type = urls.schema["page_id"].dataType.simpleString()
    return hashed.mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
