"""URL rules looked up in a cascade of Bloom filters that is exact over the corpus's own keys. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import LOWER, UPPER, cut

#: Most keys of a filter whose bits go into the plan as one literal. The bits of a larger one are an array in a table of one row, which is
#: broadcast: 2 to 4 bytes a listed key.
MAX_LISTED = 200_000


@dataclass(frozen=True)
class Level:
    salt: int
    bits: int
    hashes: int
    words: str  # 64-bit words, joined by a comma
    table: DataFrame | None = None  # or a table of one row, which has them as an array

    def column(self) -> Column:
        """The text of the words is a literal, which Catalyst folds into one array."""
        return F.col(f"words_{self.salt}") if self.table is not None else F.split(F.lit(self.words), ",").cast("array<bigint>")

    def has(self, key: Column) -> Column:
        """All positions of a key are set."""
        words = self.column()
        return _all([F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _positions(key, self)])


def attach(frame: DataFrame, levels: list[Level]) -> DataFrame:
    """The frame with the words of levels that are tables."""
    for level in levels:
        if level.table is not None:
            frame = frame.crossJoin(F.broadcast(level.table))
    return frame


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _positions(key: Column, level: Level) -> list[Column]:
    m = F.lit(level.bits).cast("long")
    a, b = (F.pmod(F.xxhash64(F.lit(2 * level.salt + k), key), m) for k in (0, 1))
    return [F.pmod(a + b * i + (i * i * i - i) // 6, m) for i in range(level.hashes)]


def build_level(keys: DataFrame, n: int, rate: float, salt: int, max_listed: int = MAX_LISTED) -> Level:
    """A Bloom filter over a `key` column of n keys."""
    hashes = max(1, round(-math.log2(rate)))
    shape = Level(salt, max(64, 64 * math.ceil(n * -math.log2(rate) / math.log(2) / 64)), hashes, "")
    set_ = keys.select(F.explode(F.array(*_positions(F.col("key"), shape))).alias("p")).select(
        F.floor(F.col("p") / 64).alias("w"), F.pmod("p", F.lit(64)).cast("int").alias("s")
    )
    words = set_.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, s))").alias("v"))
    if n > max_listed:
        every = keys.sparkSession.range(shape.bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("x"))
        array = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(f"words_{salt}")
        return Level(salt, shape.bits, hashes, "", cut(every.agg(array)))
    found = {r.w: r.v for r in words.collect()}
    return Level(salt, shape.bits, hashes, ",".join(str(found.get(w, 0)) for w in range(shape.bits // 64)))


def build_cascade(universe: DataFrame, listed: DataFrame, salt: int = 0, max_listed: int = MAX_LISTED) -> list[Level]:
    """Levels that tell listed keys from all other keys of the universe without error (both have a `key` column).

    Level 1 holds the listed keys, level 2 the other keys that level 1 takes for listed, level 3 the
    listed keys that level 2 takes for others, and so on until a level errs no more. The first level's
    rate is set so that about as many others pass it as there are listed keys: all levels stay in
    proportion to the list, whatever the universe's size.
    """
    listed = listed.distinct()
    n, total = listed.count(), universe.count()
    inside, outside, levels = listed, universe.join(F.broadcast(listed) if n <= max_listed else listed, "key", "left_anti"), []
    rate = min(0.5, math.sqrt(0.5) * max(n, 1) / max(total, 1))
    while n:
        levels.append(build_level(inside, n, rate, salt + len(levels), max_listed))
        wrong = cut(attach(outside, levels[-1:]).where(levels[-1].has(F.col("key"))).select("key"))
        inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe: the first level that lacks a key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].has(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys of a url that a rule may have: for each (labels of the host, length of the path) among the rules, the host's
    last labels and the path's beginning."""
    labels = F.size(F.split(host, r"\.", -1))
    made = [F.when((labels >= n) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size))) for n, size in shapes]
    return F.array_distinct(F.filter(F.array(*made), lambda k: k.isNotNull()))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_listed: int = MAX_LISTED) -> DataFrame:
    """(id, host, path, rule, verdict) for every row. `rules` are (key, allow or block), a key like example.com/en/.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting
    rule wins (of equally long ones that with the longer host). Without one, rule is null and the
    verdict is `default`: the filter does not list the url. Null urls and those without :// have empty
    host and path and fit no rule. Repeated rows and ids stay; extra columns are not read. Rules that
    repeat a key must agree.

    Which of a url's keys are rules, and which rules block, is read from two cascades built over all
    distinct keys of the table. Filters of more than `max_listed` keys are held in tables of one row instead of the plan.
    """
    spark, verdicts = pages.sparkSession, dict(rules)
    if len(verdicts) != len(set(rules)):
        raise ValueError("rules that repeat a key must agree")
    shapes = sorted({(k.split("/", 1)[0].count(".") + 1, len(k) - k.index("/")) for k in verdicts}, key=lambda s: (-s[1], -s[0]))
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rules:
        return parts.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    longest = lambda keys: F.array_max(F.transform(keys, lambda k: F.struct(F.length(k), F.length(F.substring_index(k, "/", 1)), k.alias("key")))).getField("key")
    keyed = parts.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    entries = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in sorted(verdicts.items())] if len(verdicts) <= max_listed else None
    listed = spark.range(1).select(F.inline(F.array(*entries))) if entries else cut(spark.createDataFrame(sorted(verdicts.items()), "key string, verdict string"))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct())
    rule_levels = build_cascade(universe, listed.select("key"), 0, max_listed)
    block_levels = build_cascade(listed.select("key"), listed.where("verdict = 'block'").select("key"), 1_000, max_listed)
    rule = longest(F.filter("keys", lambda k: in_cascade(k, rule_levels)))
    return attach(keyed, rule_levels + block_levels).withColumn("rule", rule).select(
        id_col, "host", "path", "rule", F.when(F.col("rule").isNull(), default).when(in_cascade(F.col("rule"), block_levels), "block").otherwise("allow").alias("verdict")
    )
