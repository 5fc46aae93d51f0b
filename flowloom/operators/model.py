"""The transfer graph: edges, channels and half-edges.

``transfers`` has ``src``, ``dst``, ``block_number``, ``value`` (decimal(38,0)), ``behaviour``, ``asset`` and
``tie``, a struct that orders the edges of one block.  An edge is in the *token* channel of its asset if its
behaviour is TT, else in the *native* channel, which is named by the empty string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.rules import amount

NATIVE = ""


def with_channel(transfers: DataFrame) -> DataFrame:
    """Edges with their channel; edges without behaviour or ends belong to none and are left out."""
    channel = F.when(F.col("behaviour") == "TT", F.col("asset")).otherwise(F.lit(NATIVE))
    return transfers.filter("behaviour IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").withColumn("channel", channel).filter("channel IS NOT NULL")


def half_edges(transfers: DataFrame, keep_zero: bool = False) -> DataFrame:
    """``(channel, node, dir, other, block, value, tie)``: every edge once at its source (O) and once at its target
    (I), read in one scan.  A self-loop has both.  Edges without value are left out unless ``keep_zero``."""
    edges = with_channel(transfers)
    if not keep_zero:
        edges = edges.filter("value <> 0")
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit("O").alias("dir"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.lit("I").alias("dir"), F.col("src").alias("other")),
    )
    return edges.select("channel", F.explode(ends).alias("e"), F.col("block_number").alias("block"), "value", "tie").select(
        "channel", "e.node", "e.dir", "e.other", "block", "value", "tie"
    )


def accepted(raw: DataFrame) -> DataFrame:
    """Raw edges, whose values are text, with exact values; see ``rejected`` for the rest."""
    return raw.withColumn("value", amount(F.col("value"))).filter("value IS NOT NULL")


def rejected(raw: DataFrame) -> DataFrame:
    """Raw edges whose value is no number or too large for exact arithmetic."""
    return raw.filter(amount(F.col("value")).isNull())


def edges_of_kind(transfers: DataFrame, behaviour: str) -> DataFrame:
    """Edges of one behaviour; a null behaviour is none."""
    return transfers.filter(F.col("behaviour") == behaviour)


def lookup(vertices: DataFrame, ids: DataFrame, required: bool = False) -> DataFrame:
    """The vertices of ``ids(id)``, each id once, with ``found``; a missing one has nulls for its properties.

    With ``required`` a missing id is an error when the result is read.  Null ids are never found; of repeated
    vertices all come out.
    """
    have = vertices.withColumn("found", F.lit(True))
    rows = ids.select("id").distinct().join(have, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if required:
        missing = F.raise_error(F.concat(F.lit("no vertex "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("boolean")
        rows = rows.withColumn("found", F.when(F.col("found"), True).otherwise(missing))
    return rows


def vertices_without(vertices: DataFrame, prop: str = "node_id") -> DataFrame:
    """Vertices that lack a property."""
    return vertices.filter(F.col(prop).isNull() & F.col("id").isNotNull())


def adjacency(transfers: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Half-edges of the given ``nodes(id)``, zero values included; ``direction`` is out, in or both."""
    half = half_edges(transfers, keep_zero=True)
    if direction != "both":
        half = half.filter(F.col("dir") == {"out": "O", "in": "I"}[direction])
    return half.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")


def two_hop_sources(transfers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, source)``: distinct nodes two edges upstream."""
    edges = transfers.select("src", "dst").distinct()
    first = nodes.select("id").join(edges.toDF("mid", "id"), "id").select("id", "mid").distinct()
    return first.join(edges.toDF("source", "mid"), "mid").select("id", "source").distinct()
