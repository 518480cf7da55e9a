"""URL filters: rules by host and path, and a Bloom filter cascade over hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import free_name, read_table, store

#: The rules of the registered query as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Site names whose hosts the registered query lists as blocked.
LISTED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")

WORD_BITS = 64


def lower_az(value: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a one-row table ``bits`` of 64-bit words per segment, and its shape.

    Keys are dealt to segments by a hash; each segment is a filter of ``words`` words.
    """

    segments: list[DataFrame]
    words: int
    hashes: int
    seed: int


@dataclass
class BloomCascade:
    """Exact membership in ``listed`` for every key of the universe it was built over.

    Level 1 holds the listed keys. Each further level holds the keys the level
    before wrongly lets through: other keys of the universe at even levels, listed
    keys at odd ones, each shorter than the one before, until none is left. A key
    is listed if the first level that lacks it is an even one, or the cascade ends
    with an odd one. Keys outside the universe may be judged either way.

    A level is built from hash positions by aggregation (``bit_or`` per word) and
    read as scalar subqueries: judging rows takes no join and no shuffle. A level over
    ``segment_bytes`` is cut into segments, each packed by a task and read by a subquery of
    its own, so lists of any length keep the method; a process that judges rows holds
    ``bits_per_key`` bits per listed key and those of the shorter levels.
    """

    levels: list[Level] = field(default_factory=list)

    @classmethod
    def build(
        cls,
        universe: DataFrame,
        listed: DataFrame,
        bits_per_key: float = 8.0,
        segment_bytes: int = 8 << 20,
    ) -> BloomCascade:
        """Both tables have one column ``key``; null keys are left out.

        Listed keys that the universe lacks are dropped: nothing will ask for them.
        """
        keys = universe.select("key").where(F.col("key").isNotNull()).distinct()
        marks = listed.select("key").where(F.col("key").isNotNull()).distinct().withColumn("is_listed", F.lit(True))
        keys = store(
            keys.join(marks, "key", "left").select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")),
            "cascade-keys",
        )
        cascade = cls()
        passing, inside = keys, True
        while True:
            held = passing.where(F.col("is_listed") == inside)
            count = held.count()
            if count == 0 and cascade.levels:
                return cascade
            words = max(1, math.ceil(count * bits_per_key / WORD_BITS))
            segments = math.ceil(words * WORD_BITS // 8 / segment_bytes)
            hashes = max(1, round(bits_per_key * math.log(2)))
            level = _fill(held, segments, math.ceil(words / segments), hashes, seed=len(cascade.levels) + 1)
            cascade.levels.append(level)
            passing = store(
                passing.where((F.col("is_listed") != inside) & _has(F.col("key"), level)), "cascade-passing"
            ).unionByName(held)
            inside = not inside

    def contains(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``; a null key is not listed."""
        member = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            member = F.when(_has(key, self.levels[depth]), member).otherwise(F.lit(depth % 2 == 1))
        return df.withColumn(name, F.coalesce(key.isNotNull() & member, F.lit(False)))


def _positions(key: Column, words: int, hashes: int, seed: int) -> list[Column]:
    """Bit positions of a key: two hashes combined, as many as asked for."""
    size = words * WORD_BITS
    a = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(size))
    b = F.pmod(F.xxhash64(F.lit(-seed), key), F.lit(size - 1)) + 1
    return [F.pmod(a + b * i, F.lit(size)) for i in range(hashes)]


def _segment(key: Column, segments: int, seed: int) -> Column:
    """The segment of a key, by a hash that its positions do not depend on."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("segment"), key), F.lit(segments)).cast("int")


def _fill(keys: DataFrame, segments: int, words: int, hashes: int, seed: int) -> Level:
    """The words of each segment as one array, of bounded length."""
    key = F.col("key")
    places = F.explode(F.array(*_positions(key, words, hashes, seed))).alias("bit")
    bits = keys.select(_segment(key, segments, seed).alias("segment"), places).select(
        "segment",
        F.shiftright("bit", 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(WORD_BITS)).cast("int")).alias("mask"),
    )
    blank = keys.sparkSession.range(segments * words).select(
        F.floor(F.col("id") / words).cast("int").alias("segment"),
        (F.col("id") % words).cast("int").alias("word"),
        F.lit(0).cast("long").alias("mask"),
    )
    per_word = bits.unionByName(blank).groupBy("segment", "word").agg(F.bit_or("mask").alias("mask"))
    packed = per_word.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("pairs"))
    stored = store(packed.select("segment", F.transform("pairs", lambda p: p["mask"]).alias("bits")), "cascade-level")
    tables = [stored.where(F.col("segment") == n).select("bits") for n in range(segments)]
    return Level(tables, words, hashes, seed)


def _has(key: Column, level: Level) -> Column:
    bits = level.segments[0].scalar()
    if len(level.segments) > 1:
        segment = _segment(key, len(level.segments), level.seed)
        for n, table in enumerate(level.segments[1:], 1):
            bits = (F.when(segment == 0, bits) if n == 1 else bits).when(segment == n, table.scalar())
    tests = [
        F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(WORD_BITS)).cast("int")) == 1
        for p in _positions(key, level.words, level.hashes, level.seed)
    ]
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return found


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url: str = "url",
    **sizes,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict; other columns named so give way.

    Where no rule fits, the verdict is ``block`` if the host is in ``listed``
    (column ``key``), by a cascade over all hosts of ``pages``, else ``allow``.
    Null urls, urls without ``://`` and empty hosts are allowed unless the empty
    host is listed. Repeated rows are judged alike; an empty table stays empty.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    cascade = BloomCascade.build(pages.select(host.alias("key")), listed, **sizes)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.withColumns({"host": host, "path": path}).withColumn("rule", rule)
    mark = free_name(parsed, "listed")
    judged = cascade.contains(parsed, F.col("host"), mark)
    fallback = F.when(F.col(mark), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", F.coalesce(verdict, fallback)).drop(mark)


def listed_hosts(pages: DataFrame, sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """The block list of the query: hosts that have one of ``sites`` as a label."""
    hosts = pages.select(url_host(F.col("url")).alias("key")).distinct()
    return hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, sites))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, listed_hosts(pages)).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    fits = "\n".join(
        f"  SELECT '{verdict}' AS verdict, '{host}' AS h, '{path}' AS p UNION ALL" for verdict, host, path in RULES
    ).removesuffix(" UNION ALL")
    sites = ", ".join(f"'{s}'" for s in LISTED_SITES)
    return f"""
WITH rules AS (
{fits}
), u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         row_number() OVER () AS n
  FROM pages
), fit AS (
  SELECT u.n, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule,
         arg_max(rules.verdict, length(rules.h || rules.p)) AS verdict
  FROM u JOIN rules ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p)
  GROUP BY u.n
)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN list_has_any(string_split(host, '.'), [{sites}])
                             THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (n)
"""


OP10_SQL = _op10_sql()
