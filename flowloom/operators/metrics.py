"""Summary metrics over groups and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_frequency(lines: DataFrame) -> DataFrame:
    """``(member, n)``: in how many places of comma-joined ``members`` a member stands; empty ones do not count, nor do
    null lines.  Repeated lines count again; an empty table gives no rows."""
    rows = lines.select(F.explode(F.split("members", ",")).alias("member")).select(F.trim("member").alias("member"))
    return rows.filter("member <> ''").groupBy("member").agg(F.count(F.lit(1)).alias("n"))


def distinct_member_count(lines: DataFrame) -> DataFrame:
    """``(source, n_lines, n_members)`` per source of lines, and in total with a null source.

    Lines and members count once however often they stand there, null lines not at all.  Lines without a source have
    a row with a null source of their own.  An empty table gives the total of nothing.
    """
    rows = lines.select("source", "members", F.explode(F.split("members", ",")).alias("member"))
    per = rows.rollup("source").agg(F.count_distinct("members").alias("n_lines"), F.count_distinct("member").alias("n_members"))
    return per


def nonempty_with_backup(anchors: DataFrame, main: DataFrame, backup: DataFrame) -> DataFrame:
    """``(n_anchors, n_main, n_found)``: anchors with a result in ``main``, and with one there or else in ``backup``.

    All have ``anchor``; results are rows, and repeated ones count once.  A null anchor is one without results.  Empty
    tables give one row of zeros.
    """
    ids = anchors.select("anchor").distinct()
    have = lambda d, name: d.select("anchor").distinct().withColumn(name, F.lit(1))
    rows = ids.join(have(main, "m"), "anchor", "left").join(have(backup, "b"), "anchor", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_anchors"), F.count("m").alias("n_main"), F.count(F.coalesce("m", "b")).alias("n_found"))


def anchor_sample(nodes: DataFrame, size: int = 100, seed: str = "0") -> DataFrame:
    """``(id)``: a reproducible sample of distinct ids, those with the smallest seeded hashes; ties go to the smaller
    id.  Null ids are never in it; of fewer than ``size`` ids all are."""
    return nodes.select("id").filter("id IS NOT NULL").distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col("id"))), "id").limit(size)


def anchor_assets(transfers: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(id, asset)``: the distinct assets on any edge of an anchor, a null asset being one; null ids have none."""
    ends = transfers.select(F.explode(F.array("src", "dst")).alias("id"), "asset")
    return ends.join(anchors.select("id").distinct(), "id", "left_semi").distinct()
