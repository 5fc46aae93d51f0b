"""URL allow and block lists answered by a cascade of Bloom filters.

A rule is a host and a path prefix, written as one key such as ``example.com/en/``.  A url has one candidate key
for every pair of label count and path length that occurs in the rules: the last labels of its host and the first
characters of its path.  So a rule fits the host itself and all subdomains, and the candidates of a url are few,
whatever its length.

Exact membership of a key without a join comes from filters in turn.  The first encodes the listed keys.  The
candidate keys of the whole corpus are all that will ever be asked, so those that pass the first filter without
being listed are all its errors; the second encodes these, the third the listed keys that wrongly pass the second,
and so on until a filter makes no error.  Only the first filter is held against the corpus; the later sets are
small.  All of it is DataFrame functions.

A filter travels inside the plan.  Its size is bounded by SEGMENT_KEYS: a longer list is divided by hash into
segments of at most that many keys, each with a cascade of its own and a pass of its own over the urls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.columns import lower_ascii
from flowloom.storage import materialize

#: Listed keys of one segment; with up to 40 bits a key a filter has 330 KB at most.
SEGMENT_KEYS, MOST_BITS = 1 << 16, 40


@dataclass(frozen=True)
class Level:
    """One filter: its number (for the hashes), its size in bits, hashes a key, and its bytes."""

    number: int
    bits: int
    hashes: int
    data: bytes = b""

    def positions(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(key, F.lit(2 * self.number + i)), F.lit(self.bits)) for i in (0, 1))
        return [F.pmod(a + b * i, F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(F.lit(self.data), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found = found & (F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def _filled(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """A filter over ``keys`` with about this rate of errors."""
    doublings = min(-math.log2(rate), MOST_BITS / 1.45)
    level = Level(number, max(64, 8 * math.ceil(count * 1.45 * doublings / 8)), max(1, round(doublings)))
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("at"), F.lit(32)).cast("int"))).alias("v"))
    data = bytearray(4 * math.ceil(level.bits / 32))
    for r in words.collect():  # a row for 32 bits of the filter
        data[4 * r["w"] : 4 * r["w"] + 4] = r["v"].to_bytes(4, "little")
    return Level(number, level.bits, level.hashes, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first filter without it decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            answer = F.when(~self.levels[i - 1].has(key), F.lit(i % 2 == 0)).otherwise(answer)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade for distinct ``listed(key)`` among ``universe(key)``, which may repeat keys and hold nulls."""
    n = listed.count()
    if not n:
        return Cascade(())
    others = universe.filter("key IS NOT NULL")
    size = others.agg(F.approx_count_distinct("key")).first()[0]
    levels = [_filled(listed, 0, n, min(0.5, n * math.sqrt(0.5) / max(size, 1)))]
    inside, outside = listed, materialize(others.filter(levels[0].has(F.col("key"))).distinct().join(listed, "key", "left_anti"), "url-errors")
    while n := outside.count():
        levels.append(_filled(outside, len(levels), n, 0.5))
        inside, outside = outside, materialize(inside.filter(levels[-1].has(F.col("key"))), "url-errors")
    return Cascade(tuple(levels))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path of a url; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def _keys(spark: SparkSession, rules: list[str] | DataFrame) -> DataFrame:
    """Rules as distinct ``key`` rows; of a DataFrame, the first column."""
    if isinstance(rules, DataFrame):
        return rules.select(F.col(rules.columns[0]).alias("key")).filter("key IS NOT NULL").distinct()
    if not rules:
        return spark.range(0).select(F.lit("").alias("key"))
    return spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in sorted(set(rules))])).alias("key"))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The label counts and path lengths of the rules; a row for each pair that occurs."""
    host = F.substring_index("key", "/", 1)
    shapes = rules.select(_labels(host).alias("labels"), (F.length("key") - F.length(host)).alias("path"), (host == "").alias("bare")).distinct().collect()
    if any(r["bare"] for r in shapes):
        raise ValueError("a rule needs a host")
    return sorted((r["labels"], r["path"]) for r in shapes)


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys under which a rule could fit this url."""
    keys = [
        F.when((host != "") & (_labels(host) >= c) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -c), F.substring(path, F.lit(1), F.lit(n))))
        for c, n in shapes
    ]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _listed_among(keys: str, cascade: Cascade, segment: int, segments: int) -> Column:
    """Those of an array of keys that the cascade of a segment finds listed."""

    def test(k: Column) -> Column:
        return _in_segment(k, segment, segments) & cascade.has(k)

    return F.filter(keys, test)


def _in_segment(key: Column, segment: int, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(segments)) == segment


def judge_urls(
    pages: DataFrame,
    allow: list[str] | DataFrame,
    block: list[str] | DataFrame,
    keep: tuple[str, ...] = ("page_id",),
    url: str = "url",
    segment_keys: int = SEGMENT_KEYS,
) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    The longest rule that fits decides (host characters count as well as path characters).  Where a key is in
    both lists it blocks.  Without a fitting rule, ``rule`` is null and the cascades have found no listed key, so
    the verdict is ``allow``.  Null urls and urls without ``://`` have empty host and path and fit no rule.  Every
    row gets a row, repeated ones too; empty tables and empty lists are fine; other columns are ignored.  ``keep`` cannot
    name a column like one of the results.
    """
    if clash := {"host", "path", "rule", "verdict"} & {k.lower() for k in keep}:
        raise ValueError(f"cannot keep columns named like results: {sorted(clash)}")
    host, path = split_url(F.col(url))
    urls = pages.select(F.struct(*keep).alias("_kept"), host.alias("host"), path.alias("path"))
    blocked, allowed = _keys(pages.sparkSession, block), _keys(pages.sparkSession, allow)
    shapes = rule_shapes(blocked.union(allowed))
    if not shapes:
        return urls.select("_kept.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    asked = urls.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = asked.select(F.explode("_keys").alias("key"))
    hits = []
    for name, listed in (("block", blocked), ("allow", allowed.join(blocked, "key", "left_anti"))):
        segments = math.ceil(listed.count() / segment_keys)
        for s in range(segments):
            mine = _in_segment(F.col("key"), s, segments)
            cascade = build_cascade(listed.filter(mine), universe.filter(mine))
            if not cascade.levels:
                continue
            found = _listed_among("_keys", cascade, s, segments)
            verdict = F.lit(name).alias("verdict")
            hits.append(f"_hit{len(hits)}")
            asked = asked.withColumn(hits[-1], _with_length(found, verdict))
            if segments > 1:
                asked = materialize(asked, "url-pass")
    best = F.array_max(F.concat(*hits)) if hits else F.lit(None)
    return asked.withColumn("_best", best).select("_kept.*", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))


def _with_length(keys: Column, verdict: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), verdict))
