"""Layered neighbourhood export around seed nodes.

Seeds are layer 2.  Forward, the most frequent targets of the seeds are layer 3 and the most frequent targets of
those layer 4; backward, the most frequent sources are layers 1 and 0.  A node keeps the first layer it gets in a
direction.  A node that forward has seen appears again backward under its id with ``_1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.storage import materialize

#: Fixed values of the export format: labels of the first seed, other seeds, nodes in clusters and all others.
SOURCE, SEED, CLUSTERED, OTHER = "sourceNode", "imporNode", "clusterNode", "otherNode"


def _top(edges: DataFrame, near: DataFrame, at: str, far: str, limit: int, dedup: bool) -> DataFrame:
    """The ``limit`` most frequent far ends of the edges at the near nodes; ties go to the smaller id."""
    rows = edges.join(near.select(F.col("id").alias(at)), at, "left_semi")
    n = F.count_distinct(at) if dedup else F.count(F.lit(1))
    return rows.groupBy(F.col(far).alias("id")).agg(n.alias("n")).orderBy(F.desc("n"), "id").limit(limit).select("id")


def layered_neighbourhood(transfers: DataFrame, seeds: DataFrame, clusters: DataFrame, first: int = 30, second: int = 60, dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """``nodes(id, label, layer)`` and ``edges(source, target)``.

    ``seeds`` has ``id`` and the first in order of ``rank`` is the source; ``clusters`` has ``id``.  ``first`` and
    ``second`` limit the hops.  ``dedup`` counts distinct neighbours instead of edges.  Each hop is one pass over
    the edges of the nodes that the hop before kept, which are few.  Edges with a null end are left out, repeated ones
    count; a repeated seed has its smallest rank, of seeds of one rank the one with the smaller id is the source, and a
    null seed is a node without edges.  Without seeds there are no nodes and no edges.
    """
    edges = transfers.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    seed = seeds.groupBy("id").agg(F.min("rank").alias("rank"))
    out1 = materialize(_top(edges, seed, "src", "dst", first, dedup), "export")
    out2 = materialize(_top(edges, out1, "src", "dst", second, dedup), "export")
    in1 = materialize(_top(edges, seed, "dst", "src", first, dedup), "export")
    in2 = materialize(_top(edges, in1, "dst", "src", second, dedup), "export")
    forward = seed.select("id", F.lit(2).alias("layer")).union(out1.withColumn("layer", F.lit(3))).union(out2.withColumn("layer", F.lit(4)))
    forward = forward.groupBy("id").agg(F.min("layer").alias("layer"))
    backward = in1.withColumn("layer", F.lit(1)).union(in2.withColumn("layer", F.lit(0))).groupBy("id").agg(F.max("layer").alias("layer"))
    shown = F.when(F.col("fid").isNotNull(), F.concat("id", F.lit("_1"))).otherwise(F.col("id"))
    again = backward.join(forward.select(F.col("id").alias("fid")), F.col("id") == F.col("fid"), "left").select("id", shown.alias("shown"), "layer", F.lit(False).alias("is_seed"))
    every = forward.join(seed.select(F.col("id"), F.lit(True).alias("is_seed")), "id", "left").select("id", F.col("id").alias("shown"), "layer", F.coalesce("is_seed", F.lit(False)).alias("is_seed")).union(again)
    source = seed.orderBy("rank", "id").limit(1).select("id", F.lit(True).alias("is_source"))
    known = clusters.select("id").distinct().withColumn("in_cluster", F.lit(True))
    label = (
        F.when(F.col("is_seed") & F.col("is_source"), SOURCE).when(F.col("is_seed"), SEED).when(F.col("in_cluster"), CLUSTERED).otherwise(OTHER)
    )
    nodes = every.join(source, "id", "left").join(known, "id", "left").select(F.col("shown").alias("id"), label.alias("label"), "layer")

    def between(a: DataFrame, b: DataFrame) -> DataFrame:
        return edges.join(a.select(F.col("id").alias("src"), F.col("shown").alias("source")), "src").join(b.select(F.col("id").alias("dst"), F.col("shown").alias("target")), "dst").select("source", "target")

    plain = lambda d: d.select("id", F.col("id").alias("shown"))
    suffixed = lambda d: d.join(again.select("id", "shown"), "id")
    links = between(plain(seed), plain(out1)).union(between(plain(out1), plain(out2)))
    links = links.union(between(suffixed(in1), plain(seed))).union(between(suffixed(in2), suffixed(in1)))
    return nodes, links.distinct()
