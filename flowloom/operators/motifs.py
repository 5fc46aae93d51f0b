"""Motif operators: which accounts belong together, from the shape of their transfers.

Groups come out as ``(channel, members)`` with members distinct, sorted and comma-joined.  All nodes are anchors at
once; ``of_anchor`` picks the groups of some.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.rules import covers_outflow, joined, relays
from flowloom.operators.components import connected_components
from flowloom.operators.joins import split_join
from flowloom.operators.ledger import ORDER, SLICE, SLICE_BLOCKS, dealt, first_outflows, sliced
from flowloom.operators.ledger import ledger as make_ledger
from flowloom.operators.model import NATIVE, half_edges, with_channel
from flowloom.storage import materialize, release


def _groups(rows: DataFrame, members: Column) -> DataFrame:
    """Groups of two or more, each once."""
    return rows.select("channel", F.array_distinct(members).alias("m")).filter("size(m) >= 2").select("channel", joined(F.col("m")).alias("members")).distinct()


# --- co-deposit: several senders fund one outgoing transfer


def codeposit_groups(ledger: DataFrame, strict: bool = True) -> DataFrame:
    """Senders whose inflow covers an outgoing transfer; without ``strict`` also the node that they pay.

    The balance kept from earlier plays no part: with it the rule is only harder, and both forms are asked for.
    """
    hit = ledger.filter(covers_outflow(F.col("mx"), F.col("s_in"), F.col("out_value")))
    return _groups(hit, F.col("senders") if strict else F.concat("senders", F.array("node")))


def deposit_side_groups(ledger: DataFrame) -> DataFrame:
    """Senders and the node that they pay, where inflow and kept balance together cover the outgoing transfer."""
    hit = ledger.filter(covers_outflow(F.col("mx"), F.col("s_in") + F.col("bal_before"), F.col("out_value")))
    return _groups(hit, F.concat("senders", F.array("node")))


# --- relays: what comes in goes straight out again


def relay_pairs(half: DataFrame, rule: str = "ratio", slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``(channel, mid, src, dst, vin, vout)``: an incoming edge directly followed by an outgoing one of about the
    same value (``ratio``) or exactly the same (``equal``).

    Neighbours are found within time slices; the last edge of a slice is followed by the first of the node's next.  Both
    are read from one shuffle.
    """
    half = dealt(sliced(half, slice_blocks))
    step = F.struct("dir", "other", "value")
    rows = half.withColumn("n", F.lead(step).over(Window.partitionBy(*SLICE).orderBy(*ORDER)))
    first = half.groupBy(*SLICE).agg(F.min_by(step, F.struct(*ORDER)).alias("f"))
    then = first.select(*SLICE, F.lead("f").over(Window.partitionBy("channel", "node").orderBy("slice")).alias("f"))
    pairs = rows.filter("dir = 'I' AND (n IS NULL OR n.dir = 'O')").join(then, SLICE).withColumn("n", F.coalesce("n", "f")).filter("n.dir = 'O'")
    pairs = pairs.select("channel", F.col("node").alias("mid"), F.col("other").alias("src"), F.col("n.other").alias("dst"), F.col("value").alias("vin"), F.col("n.value").alias("vout"))
    return pairs.filter(relays(F.col("vin"), F.col("vout")) if rule == "ratio" else F.col("vin") == F.col("vout"))


def parallel_relay_groups(pairs: DataFrame, strict: bool = True, same_value: bool = False) -> DataFrame:
    """Two relaying nodes between the same source and target; without ``strict`` also the target.

    With ``same_value`` the relayed values must be equal too.  Relays are made distinct first, so the self-join is
    over nodes and not over transfers.
    """
    keys = ["channel", "src", "dst", *(["vin"] if same_value else [])]
    mids = pairs.select(*keys, "mid").distinct()
    both = mids.join(mids.withColumnRenamed("mid", "mid2"), keys).filter("mid < mid2")
    return _groups(both, F.array("mid", "mid2") if strict else F.array("mid", "mid2", "dst"))


def parallel_relay_links(pairs: DataFrame) -> DataFrame:
    """``(channel, a, b)``: links with the same components as ``parallel_relay_groups``, a star per source and
    target instead of all pairs.  Groups grow with the square of the nodes between a pair; this does not."""
    mids = pairs.select("channel", "src", "dst", "mid").distinct()
    low = mids.groupBy("channel", "src", "dst").agg(F.min("mid").alias("low"))
    return split_join(mids, low, ["channel", "src", "dst"]).filter("mid > low").select("channel", F.col("low").alias("a"), F.col("mid").alias("b")).distinct()


def relay_recipient_groups(pairs: DataFrame) -> DataFrame:
    """A relaying node and the node that it pays."""
    return _groups(pairs, F.array("mid", "dst"))


def airdrop_groups(half: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """Token channels only: parallel relays of one exact value, and relays with their recipients."""
    token = half.filter(F.col("channel") != NATIVE)
    ratio = relay_pairs(token, slice_blocks=slice_blocks)
    exact = ratio.filter("vin = vout")
    return parallel_relay_groups(exact, same_value=True).union(relay_recipient_groups(ratio)).distinct()


# --- deposit reuse: a sender whose deposit address forwards to an exchange


def deposit_reuse_groups(
    transfers: DataFrame, exchanges: DataFrame, miners: DataFrame, max_blocks: int = 3200, max_excess: int = 10**16, slice_blocks: int = SLICE_BLOCKS
) -> DataFrame:
    """Sender and deposit address, as groups of ``deposit_reuse_pairs``."""
    hits = deposit_reuse_pairs(transfers, exchanges, miners, max_blocks, max_excess, slice_blocks)
    return _groups(hits, F.array("deposit", "sender"))


def deposit_reuse_pairs(
    transfers: DataFrame, exchanges: DataFrame, miners: DataFrame, max_blocks: int = 3200, max_excess: int = 10**16, slice_blocks: int = SLICE_BLOCKS
) -> DataFrame:
    """``(channel, deposit, sender)``, repeats included: the deposit address, no exchange itself, pays an exchange fewer than
    ``max_blocks`` blocks before the sender's transfer or at any time after it, and at most ``max_excess`` less;
    the sender is neither exchange nor miner.  ``exchanges`` and ``miners`` have ``address``.

    That such a payment exists is a maximum over the node's payments from some block on, so no edges are paired:
    within a time slice it is a running maximum, and over the later slices it comes from one summary row per slice.
    Zero values count in token channels only.
    """
    ex, mi = (d.select(F.col("address").alias("a")).filter("a IS NOT NULL").distinct() for d in (exchanges, miners))
    half = half_edges(transfers, keep_zero=True).filter("channel <> '' OR value <> 0")
    half = half.join(ex.withColumnRenamed("a", "node"), "node", "left_anti")
    half = half.join(ex.withColumn("is_ex", F.lit(True)).withColumnRenamed("a", "other"), "other", "left")
    half = half.filter("(dir = 'O' AND is_ex) OR (dir = 'I' AND is_ex IS NULL AND node <> other)")
    since = F.when(F.col("dir") == "O", F.col("block")).otherwise(F.col("block") - (max_blocks - 1))
    half = half.withColumn("at", since).withColumn("slice", F.floor(F.col("at") / slice_blocks))
    payment = F.when(F.col("dir") == "O", F.col("value"))
    here = Window.partitionBy(*SLICE).orderBy((-F.col("at")).alias("back")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("channel", "node").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = half.groupBy(*SLICE).agg(F.max(payment).alias("top")).withColumn("later", F.max("top").over(before)).drop("top")
    rows = half.withColumn("paid", F.max(payment).over(here)).filter("dir = 'I'").join(later, SLICE)
    hits = rows.filter(F.col("value") - F.greatest("paid", "later") <= max_excess)
    hits = hits.join(mi.withColumnRenamed("a", "other"), "other", "left_anti")
    return hits.select("channel", F.col("node").alias("deposit"), F.col("other").alias("sender"))


# --- across motifs


def union_groups(*groups: DataFrame) -> DataFrame:
    """Groups of several motifs, each once per channel."""
    return reduce(DataFrame.union, groups).distinct()


def loose_union(half: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """The union of ``codeposit_groups`` and ``parallel_relay_groups`` without ``strict``, ``deposit_side_groups`` and
    ``relay_recipient_groups``.

    Balances are never negative and only make the rule harder, so every deposit-side group is also a co-deposit group
    with the node that is paid, and the ledger is not replayed for it.  The motifs are found one after the other, and
    the shuffle files of one are gone before the next.
    """
    paid = materialize(codeposit_groups(first_outflows(half, slice_blocks), strict=False), "union-codeposit")
    release(half.sparkSession)
    pairs = materialize(relay_pairs(half, slice_blocks=slice_blocks).select("channel", "src", "dst", "mid").distinct(), "union-relays")
    release(half.sparkSession)
    return union_groups(paid, parallel_relay_groups(pairs, strict=False), relay_recipient_groups(pairs))


def of_anchor(groups: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(anchor, channel, members)``: the groups that have an anchor as a member; ``anchors`` has ``id``."""
    rows = groups.withColumn("anchor", F.explode(F.split("members", ",")))
    return rows.join(anchors.select(F.col("id").alias("anchor")).distinct(), "anchor", "left_semi").select("anchor", "channel", "members")


def anchored_groups(half: DataFrame, anchors: DataFrame, strict: bool = True, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``(anchor, channel, members)``: co-deposit and parallel relay groups by the part that an anchor has in them.

    An anchor is a sender of the co-deposit and a relaying node.  Without ``strict`` it may also be the node that is
    paid, as in ``deposit_side_groups``, and a relay's target, as in ``relay_recipient_groups``; groups of which it
    is a member in another part are not its own.  ``anchors`` has ``id``.

    Only the ledgers and relays that an anchor can have a part in are computed: those of nodes that it pays, that pay
    it, or that share a source with its own relays.
    """
    ids = anchors.select(F.col("id").alias("anchor")).filter("anchor IS NOT NULL").distinct()
    ends = half.join(ids, half["node"] == ids["anchor"]).select("anchor", "channel", "dir", "other").distinct()
    paid = ends.filter("dir = 'O'").select("channel", F.col("other").alias("node"), "anchor")
    pays = ends.filter("dir = 'I'").select("channel", F.col("other").alias("node"), "anchor")
    here = half.join(ids, half["node"] == ids["anchor"], "left_semi")

    def of(nodes: DataFrame) -> DataFrame:
        return half.join(nodes.select("channel", "node").distinct(), ["channel", "node"], "left_semi")

    def groups(rows: DataFrame, members: Column) -> DataFrame:
        found = rows.select("anchor", "channel", F.array_distinct(members).alias("m")).filter("size(m) >= 2")
        return found.select("anchor", "channel", joined(F.col("m")).alias("members"))

    hit = make_ledger(of(paid), slice_blocks).join(paid, ["channel", "node"]).filter(F.array_contains("senders", F.col("anchor")))
    hit = hit.filter(covers_outflow(F.col("mx"), F.col("s_in"), F.col("out_value")))
    found = [groups(hit, F.col("senders") if strict else F.concat("senders", F.array("node")))]

    own = relay_pairs(here, slice_blocks=slice_blocks).select("channel", "src", "dst", F.col("mid").alias("anchor")).distinct()
    sources = own.select("channel", F.col("src").alias("node")).distinct()
    reached = of(sources).filter("dir = 'O'").select("channel", F.col("other").alias("node"))
    mids = relay_pairs(of(reached), slice_blocks=slice_blocks).select("channel", "src", "dst", "mid").distinct()
    both = own.join(mids, ["channel", "src", "dst"]).filter("mid <> anchor")
    found.append(groups(both, F.array("anchor", "mid") if strict else F.array("anchor", "mid", "dst")))
    if not strict:
        side = make_ledger(here, slice_blocks).filter(covers_outflow(F.col("mx"), F.col("s_in") + F.col("bal_before"), F.col("out_value")))
        found.append(groups(side.withColumn("anchor", F.col("node")), F.concat("senders", F.array("node"))))
        to = relay_pairs(of(pays), slice_blocks=slice_blocks).join(ids, F.col("dst") == F.col("anchor"))
        found.append(groups(to, F.array("mid", "dst")))
    return reduce(DataFrame.union, found).distinct()


def anchor_deposit_reuse(
    transfers: DataFrame, anchors: DataFrame, exchanges: DataFrame, miners: DataFrame, max_blocks: int = 3200, max_excess: int = 10**16, slice_blocks: int = SLICE_BLOCKS
) -> DataFrame:
    """``(anchor, channel, members)``: the ``deposit_reuse_groups`` of every deposit address that an anchor pays.

    The sender may be any node, the anchor among them.  Only edges at these deposit addresses are read on; zero
    values pay nothing in the native channel.  ``anchors`` has ``id``; an anchor without groups has no rows.
    """
    ids = anchors.select(F.col("id").alias("anchor")).filter("anchor IS NOT NULL").distinct()
    edges = with_channel(transfers).filter("channel <> '' OR value <> 0")
    paid = edges.join(ids, edges["src"] == ids["anchor"]).select("anchor", "channel", F.col("dst").alias("deposit")).distinct()
    nodes = paid.select(F.col("deposit").alias("_d")).distinct()
    from_, to = (nodes.select(F.col("_d").alias(f"_{end}"), F.lit(True).alias(f"_at_{end}")) for end in ("src", "dst"))
    near = transfers.join(from_, F.col("src") == F.col("_src"), "left").join(to, F.col("dst") == F.col("_dst"), "left")
    near = near.filter("_at_src OR _at_dst").select(*transfers.columns)
    groups = deposit_reuse_pairs(near, exchanges, miners, max_blocks, max_excess, slice_blocks)
    own = groups.join(paid, ["channel", "deposit"])
    return own.select("anchor", "channel", joined(F.array("deposit", "sender")).alias("members")).distinct()


def group_clusters(groups: DataFrame) -> DataFrame:
    """``(member, component)``: members of overlapping groups belong together; a component is its smallest member.

    A group links its members to its smallest one, so nothing is shuffled by group.
    """
    rows = groups.select(F.split("members", ",").alias("all")).select(F.explode("all").alias("m"), F.array_min("all").alias("c"))
    return _clusters(rows)


def _clusters(links: DataFrame) -> DataFrame:
    """Components of links ``(m, c)``; a node linked to itself alone is its own."""
    links = links.distinct()
    linked = connected_components(links, "m", "c")
    members = links.select(F.col("m").alias("node")).union(links.select("c")).distinct()
    return members.join(linked, "node", "left").select(F.col("node").alias("member"), F.coalesce("component", "node").alias("component"))


def motif_clusters(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(member, component)``: the clusters of co-deposit and parallel relay groups, as ``group_clusters`` of their
    union has them, from stars instead of groups: no pairs of relaying nodes are made.

    ``ledger`` may be ``first_outflows``.  Each motif's links are written, and its shuffle files gone before the next.
    """
    spark = pairs.sparkSession
    hit = ledger.filter(covers_outflow(F.col("mx"), F.col("s_in"), F.col("out_value"))).filter("size(senders) >= 2")
    senders = hit.select(F.explode("senders").alias("m"), F.array_min("senders").alias("c"))
    senders = materialize(senders.distinct(), "clusters-codeposit")
    release(spark)
    relayed = materialize(parallel_relay_links(pairs).select(F.col("b").alias("m"), F.col("a").alias("c")), "clusters-relays")
    release(spark)
    return _clusters(senders.union(relayed))


def anchor_component(groups: DataFrame) -> DataFrame:
    """``(anchor, member)``: what an anchor's own groups ``(anchor, channel, members)`` connect to it.

    Members are linked within the groups of one anchor only; an anchor that is in none of them has no rows.
    """
    at = lambda member: F.struct(F.col("anchor"), member.alias("member"))
    rows = groups.select("anchor", F.split("members", ",").alias("all"))
    rows = rows.select("anchor", F.explode("all").alias("m"), F.array_min("all").alias("c"))
    clusters = _clusters(rows.select(at(F.col("m")).alias("m"), at(F.col("c")).alias("c")))
    own = clusters.filter("member.anchor = member.member").select(F.col("component"), F.col("member.anchor").alias("anchor"))
    return own.join(clusters, "component").select("anchor", F.col("member.member").alias("member"))
