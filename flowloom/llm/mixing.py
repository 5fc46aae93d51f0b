"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words.  A document's expected copies are target over source size; the whole
part is certain and the fractional part is rounded dependently: two documents with fractional shares meet, words
move at random from one to the other until one share is 0 or 1, and the other meets the next document.  A source's
expected words stay constant throughout, so what it ends with differs from its target by at most half of one
document, the last one left with a fractional share.

Distribution: a source's documents are dealt by a hash of their id to groups of about ``group_rows``, so a source
that holds a third of all rows has as many groups as it needs.  A group is read as a sorted stream with one open
document at a time.  The one document it leaves open goes to the next level, where ``fan_in`` groups meet, up to
one group per source.  Only ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.columns import bound_batches
from flowloom.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    """Words of a text as maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(rank, source, n, source_size, target)`` by water filling.

    Sources in code point order (null last) take ``weights`` in turn and divide ``share`` of all words by weight.
    No target exceeds ``cap`` times its source's size; the excess goes to the others by weight.  In order of
    size/weight the capped sources come first, so one running sum finds the level at which the rest stand.
    Without words, all targets are 0.  The windows run over one row per source.
    """
    if min(weights) <= 0 or not 0 <= share <= cap:
        raise ValueError("weights must be positive and share between 0 and cap")
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", order).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    full = F.col("source_size") * F.lit(float(cap))
    by_level = Window.orderBy(full / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level).withColumn("open", F.when(full > F.col("w") * F.col("level"), F.struct(full / F.col("w"), "rank", "level")))
    stand = F.min("open").over(everything)["level"]
    target = F.when(F.col("open").isNull(), full).otherwise(F.least(full, F.col("w") * stand))
    return per.select("rank", "source", "n", "source_size", target.alias("target"))


def _meet(a: list, b: list, draw: float) -> None:
    """Move words between two documents ``[key, size, words]`` until one of them has none or all of its own."""
    up, down = min(a[1] - a[2], b[2]), min(a[2], b[1] - b[2])
    move = up if draw * (up + down) < down else -down
    a[2] += move
    b[2] -= move
    for x in (a, b):
        if x[2] < 1e-9 * x[1]:
            x[2] = 0.0
        elif x[1] - x[2] < 1e-9 * x[1]:
            x[2] = float(x[1])


def _rounds(seed: str, last: bool):
    """A stream over rows sorted by group: every row comes out with its extra copy decided, or open (null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, rng = None, None, random.Random()
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            out = []

            def settle(row: list, extra: int | None, of: tuple) -> None:
                out.append((of[0], of[1], row[0], row[1], row[2], extra))  # noqa: B023

            for rank, g, key, size, words in zip(*cols, strict=True):
                if (rank, g) != group:
                    if held:
                        settle(held, int(2 * held[2] >= held[1]) if last else None, group)
                    held, group = None, (rank, g)
                    rng = random.Random(f"{seed}/{rank}/{g}")
                row = [key, size, words]
                if 0 < row[2] < row[1]:
                    if held is None:
                        held = row
                        continue
                    _meet(held, row, rng.random())
                    for x in (held, row):
                        if not 0 < x[2] < x[1]:
                            settle(x, int(x[2] > 0), group)
                    held = next((x for x in (held, row) if 0 < x[2] < x[1]), None)
                else:
                    settle(row, int(row[2] > 0), group)
            if out:
                yield _rows(out, batch.schema)
        if held:
            schema = batch.schema
            yield _rows([(*group, *held, int(2 * held[2] >= held[1]) if last else None)], schema)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    fields = [schema.field(i) for i in range(5)] + [pa.field("extra", pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    group_rows: int = 512,
    fan_in: int = 256,
) -> DataFrame:
    """Copies of every document: ``(doc_id, source, size, source_size, target, copies, taken)``, one row per row.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are ignored.  Null text has size 0, null
    sources are one source, null ids are documents like others, and a repeated row is a document of its own.
    A document without words gets the whole part of its source's ratio.  An empty table gives no rows.  The same
    rows give the same result however they are partitioned.  ``taken`` is copies times size, and at most
    ``ceil(cap)`` times the size.
    """
    bound_batches(docs.sparkSession)
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "mix-sized")
    targets = materialize(source_targets(sized, weights, share, cap).coalesce(1), "mix-targets")
    groups = math.ceil((targets.agg(F.max("n")).first()[0] or 1) / group_rows)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        "rank",
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n") / group_rows)).alias("grp"),
        "doc_id",
        "size",
        (F.col("size") * F.col("part")).alias("words"),
    )
    schema = f"rank int, grp long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, words double, extra int"
    done, level = [], 0
    while True:
        last = groups <= 1
        dealt = rows.repartition("rank", "grp").sortWithinPartitions("rank", "grp", F.desc("size"), "doc_id", "words")
        out = dealt.mapInArrow(_rounds(f"{seed}/{level}", last), schema)
        out = out if last else materialize(out, "mix-level")
        done.append(out.filter("extra IS NOT NULL"))
        if last:
            break
        rows = out.filter("extra IS NULL").select("rank", F.floor(F.col("grp") / fan_in).alias("grp"), "doc_id", "size", "words")
        groups, level = math.ceil(groups / fan_in), level + 1
    settled = done[0]
    for x in done[1:]:
        settled = settled.union(x)
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return settled.select("rank", "doc_id", "size", "extra").join(plan.select("rank", "source", "source_size", "target", "whole"), "rank").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
