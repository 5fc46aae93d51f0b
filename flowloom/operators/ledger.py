"""Ledger replay: inflow windows and clamped balances.

The inflow of an outgoing edge is what came in from the previous outgoing edge's block (inclusive) up to its own
(exclusive).  So an incoming edge belongs to the first outgoing block strictly after its own, and the first outgoing
edge of that block owns it.  The clamped balance max(0, before + inflow - out) has a closed form: the running sum
minus its running minimum below zero.

Hub accounts have far more edges than one task should sort.  So time is cut into slices of ``slice_blocks`` blocks:
windows run over (channel, node, slice), and what a slice needs from the others (the first outgoing block later on,
the running sum and its minimum so far) comes from one summary row per slice.  Sums and minima combine across
slices exactly, so results do not depend on the slicing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("block", "tie", "dir")
#: About a week of blocks at 12 seconds each.
SLICE_BLOCKS = 50_000
SLICE = ["channel", "node", "slice"]
_EXACT = "decimal(38,0)"


def sliced(half: DataFrame, slice_blocks: int) -> DataFrame:
    """Half-edges with the number of their time slice."""
    return half.withColumn("slice", F.floor(F.col("block") / slice_blocks))


def dealt(half: DataFrame) -> DataFrame:
    """Sliced half-edges in one shuffle by slice, which all that need the same columns can read.

    Rows without a slice fit nowhere.  They go here, as else Spark drops them on some sides of a join only, and what
    is shuffled is no longer the same.
    """
    return half.filter("channel IS NOT NULL AND node IS NOT NULL AND slice IS NOT NULL").repartition(*SLICE)


def _inflows(half: DataFrame) -> DataFrame:
    """``(channel, node, block, s, mx, senders)``: what is due at each outgoing block.

    The senders of a window are its result, one array; sums and maxima are aggregated before the shuffle.
    """
    out_block = F.when(F.col("dir") == "O", F.col("block"))
    per_slice = half.groupBy(*SLICE).agg(F.min(out_block).alias("first_out"))
    before = Window.partitionBy("channel", "node").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = per_slice.withColumn("later", F.min("first_out").over(before)).drop("first_out")
    # Descending order with a frame that ends before the row is incremental; a frame to the end is not.
    after = Window.partitionBy(*SLICE).orderBy((-F.col("block")).alias("back")).rangeBetween(Window.unboundedPreceding, -1)
    rows = half.withColumn("here", F.min(out_block).over(after)).filter("dir = 'I'").join(later, SLICE)
    rows = rows.withColumn("due", F.coalesce("here", "later")).filter("due IS NOT NULL")
    return rows.groupBy("channel", "node", F.col("due").alias("block")).agg(F.sum("value").alias("s"), F.max("value").alias("mx"), F.array_sort(F.collect_set("other")).alias("senders"))


def first_outflows(half: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``(channel, node, block, s_in, mx, senders, out_value)``: the rows of ``ledger`` whose window is not empty, without
    balances.

    The half-edges are shuffled once, by slice: an inflow that is due in its own slice is aggregated where it lies, and
    what is left of a slice goes on as one row to the first outgoing block later on.
    """
    out, into = F.col("dir") == "O", F.col("dir") == "I"
    rows = sliced(half, slice_blocks).select(*SLICE, "dir", "block", "value", F.when(into, F.col("other")).alias("sender"), F.when(out, F.col("tie")).alias("tie"))
    after = Window.partitionBy(*SLICE).orderBy((-F.col("block")).alias("back")).rangeBetween(Window.unboundedPreceding, -1)
    out_block = F.when(out, F.col("block"))
    rows = dealt(rows).withColumn("due", F.coalesce(out_block, F.min(out_block).over(after)))
    inflow = F.when(into, F.col("value"))
    dues = rows.groupBy(*SLICE, "due").agg(
        F.sum(inflow).alias("s"), F.max(inflow).alias("mx"), F.collect_set("sender").alias("senders"), F.min_by(F.when(out, F.col("value")), "tie").alias("out_value")
    )
    left = F.when(F.col("due").isNull(), F.struct("s", "mx", "senders"))
    before = Window.partitionBy("channel", "node").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = dues.groupBy(*SLICE).agg(F.min(F.when(F.col("out_value").isNotNull(), F.col("due"))).alias("first_out"), F.first(left, ignorenulls=True).alias("left"))
    later = per_slice.withColumn("later", F.min("first_out").over(before)).filter("left IS NOT NULL AND later IS NOT NULL")
    carried = later.groupBy("channel", "node", "later").agg(F.sum("left.s").alias("s0"), F.max("left.mx").alias("mx0"), F.flatten(F.collect_list("left.senders")).alias("senders0"))
    carried = carried.withColumn("slice", F.floor(F.col("later") / slice_blocks))
    # As two comparisons the block is no join key, so the rows stay where they are.
    here, there = dues.filter("due IS NOT NULL").alias("h"), carried.alias("c")
    met = F.expr("h.channel = c.channel AND h.node = c.node AND h.slice = c.slice AND h.due >= c.later AND h.due <= c.later")
    none, senders = F.array().cast("array<string>"), F.col("h.senders")
    return here.join(there, met, "left").filter("h.s IS NOT NULL OR c.s0 IS NOT NULL").select(
        "h.channel",
        "h.node",
        F.col("h.due").alias("block"),
        (F.coalesce("h.s", F.lit(0)) + F.coalesce("c.s0", F.lit(0))).cast(_EXACT).alias("s_in"),
        F.greatest("h.mx", "c.mx0").alias("mx"),
        F.array_sort(F.array_union(senders, F.coalesce("c.senders0", none))).alias("senders"),
        "h.out_value",
    )


def ledger(half: DataFrame, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``(channel, node, block, out_rn, s_in, mx, senders, out_value, bal_before, bal)`` per outgoing edge.

    ``s_in`` is 0 and ``mx`` and ``senders`` are null where the window is empty; ``senders`` are distinct and
    sorted.
    """
    half = sliced(half, slice_blocks)
    in_block = Window.partitionBy(*SLICE, "block").orderBy("tie")
    outs = half.filter("dir = 'O'").withColumn("owns", F.row_number().over(in_block) == 1)
    rows = outs.join(_inflows(half), ["channel", "node", "block"], "left").select(
        *SLICE,
        "block",
        "tie",
        F.coalesce(F.when(F.col("owns"), F.col("s")), F.lit(0)).cast(_EXACT).alias("s_in"),
        F.when(F.col("owns"), F.col("mx")).alias("mx"),
        F.when(F.col("owns"), F.col("senders")).alias("senders"),
        F.col("value").alias("out_value"),
    )
    in_order = Window.partitionBy(*SLICE).orderBy("block", "tie")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.sum((F.col("s_in") - F.col("out_value")).cast(_EXACT)).over(so_far).cast(_EXACT))
    rows = rows.withColumn("low", F.min("run").over(so_far)).withColumn("n", F.row_number().over(in_order))
    rows = rows.withColumn("run0", F.lag("run").over(in_order)).withColumn("low0", F.lag("low").over(in_order))
    per_slice = rows.groupBy(*SLICE).agg(F.max_by("run", "n").alias("total"), F.min("run").alias("least"), F.max("n").alias("rows"))
    earlier = Window.partitionBy("channel", "node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(_EXACT)
    carry = per_slice.withColumn("base", F.coalesce(F.sum("total").over(earlier), zero).cast(_EXACT)).withColumn("n0", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    floor = F.min((F.col("base") + F.col("least")).cast(_EXACT)).over(earlier)
    carry = carry.withColumn("floor", F.least(zero, F.coalesce(floor, zero))).select(*SLICE, "base", "n0", "floor")

    def balance(run: str, low: str):
        run_, low_ = (F.coalesce(F.col("base") + F.col(c), F.col("base")) for c in (run, low))
        return (run_ - F.least(F.col("floor"), low_)).cast(_EXACT)

    before = F.when(F.col("run0").isNull(), F.col("base") - F.col("floor")).otherwise(balance("run0", "low0")).cast(_EXACT)
    return rows.join(carry, SLICE).select(
        "channel", "node", "block", (F.col("n") + F.col("n0")).alias("out_rn"), "s_in", "mx", "senders", "out_value", before.alias("bal_before"), balance("run", "low").alias("bal")
    )
