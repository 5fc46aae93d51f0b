"""Connected components by alternating star contraction.

Every round is two aggregations and two equi-joins over the remaining edges, so no node's neighbourhood is ever
gathered in one task: the minimum of a hub's neighbours is a partial aggregate, and the join that hands it back
is one that adaptive execution may split.  The number of rounds is logarithmic in the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowloom.operators.joins import split_join
from flowloom.storage import materialize


def _canonical(pairs: DataFrame) -> DataFrame:
    """Distinct edges with the larger end first, without loops or missing ends."""
    return (
        pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _canonical(split_join(both.filter("v > u"), low, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.toDF("u", "v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = split_join(down, low, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return _canonical(moved.union(low.toDF("a", "b")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with a count and a checksum observed while they are written."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), checksum.alias("sum")), "cc")
    return table, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for every node with an edge to another node; the component is its smallest node.

    Loops, repeated edges and edges with a null end are allowed and add nothing.  An edge table without proper
    edges gives no rows.
    """
    now, signature = _written(_canonical(edges.select(F.col(left).alias("a"), F.col(right).alias("b"))))
    while signature[0]:
        before, (now, signature) = signature, _written(_small_star(_large_star(now)))
        if before == signature:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def group_components(groups: DataFrame, group: str, member: str) -> DataFrame:
    """``(node, component)`` over members, where all members of a group belong together.

    ``groups`` is in long form.  A group becomes a star around its smallest member, which has the same
    components as the clique at linear cost.  Members of one-member groups are their own component.
    """
    rows = groups.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g IS NOT NULL AND m IS NOT NULL")
    centre = rows.groupBy("g").agg(F.min("m").alias("c"))
    star = split_join(rows, centre, ["g"]).select("m", "c")
    linked = connected_components(star, "m", "c")
    members = rows.select(F.col("m").alias("node")).distinct()
    return members.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
