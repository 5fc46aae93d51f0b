"""Near-duplicates by SimHash and MinHash, every link decided by the exact Jaccard similarity of sets of word shingles.

Texts whose SimHash fingerprints are within ``TAU`` bits come from the generalised pigeonhole principle, by the
fingerprints and the operator of ``simhash``.  64 bits miss most copies that differ in more than a few words, so texts
also come from MinHash, and neither stands in for the other: of ``BANDS * ROWS`` hash functions each band joins ``ROWS`` minima
into one value, and texts with a value in common meet in its bucket.  Sets of similarity s share a band with chance
1 - (1 - s^ROWS)^BANDS whatever their size: 0.99993 at 0.8.  Every link is decided by the distinct shingles of both
texts, as 64-bit hashes.

One text of a bucket is compared with all others, which joins groups of copies at a cost of their size.  While this
joins many, it is repeated with another text for the buckets that hold more than one component.  The texts of those
that are left are compared by an exact set-similarity join: shingles are ordered by
about how many of these texts have them, rarest first, and sets as similar as asked for share a shingle among the first
n - ceil(2s / (1 + s) n) + 1 of the smaller and the first n - ceil(s n) + 1 of the larger one, at places that leave
enough shingles behind them.  A long passage that many texts have in common is frequent and so in no prefix: texts
that share it and little else never meet here, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.columns import bound_batches, map_batches, share, utf8
from flowloom.llm.simhash import _label, _shingles, fingerprint, near_links
from flowloom.operators.components import connected_components
from flowloom.operators.joins import split_join
from flowloom.storage import materialize, release

BANDS, ROWS = 24, 5
#: Bits by which fingerprints of texts that are compared differ at most.
TAU = 3
#: Another text of each bucket is compared with all others while that links a text in so many that are undecided.
JOINED_SHARE = 8
#: Cells in which shingles are counted for their order.
CELLS = 1 << 18
#: Bits of the filter that spares most texts that meet no other a second pass.
FILTER_BITS = 1 << 24
_BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, _shingles(words, width)), np.uint64))


def bands(hashes: np.ndarray, factors: np.ndarray, chunk: int = 1024) -> list[int]:
    """A value for each band, of the minima of its hash functions."""
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(hashes), chunk):
        least = np.minimum(least, (hashes[at : at + chunk, None] * factors).min(axis=0))
    return [xxhash.xxh3_64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def band_values(docs: DataFrame, width: int = 5) -> DataFrame:
    """``(doc_id, k0, k1, size, fp, b0..)``: a 128-bit key of the text's words, the size of its shingle set, its SimHash
    fingerprint, its bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    factors = np.random.default_rng(1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["k0", "k1", "size", "fp", *_BAND_COLUMNS]

    def numbers(text: bytes) -> list[int]:
        words = text.lower().split()
        key, hashes = xxhash.xxh3_128_intdigest(b" ".join(words)), shingle_set(words, width)
        return [key >> 64, key & (1 << 64) - 1, len(hashes), fingerprint(text), *bands(hashes, factors)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = np.array([numbers(t) for t in utf8(batch.column(1))], np.uint64).view(np.int64).T
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["doc_id", *names])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))


def simhash_pairs(unique: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, label_a, label_b)``: of ``unique(row, size, fp)`` the texts whose fingerprints link, of fitting size.

    Texts of one fingerprint meet the first of them, and linked fingerprints by their first texts.
    """
    rows = unique.filter("size > 0").select("fp", "row", "size")
    first = materialize(rows.groupBy("fp").agg(F.min(F.struct("row", "size")).alias("c"), F.count(F.lit(1)).alias("n")).select("fp", F.col("c.row").alias("a"), F.col("c.size").alias("size_a"), "n"), "jaccard-fp")
    same = split_join(rows, first.filter("n > 1").select("fp", "a", "size_a"), ["fp"]).filter("row <> a").select("a", "size_a", F.col("row").alias("b"), F.col("size").alias("size_b"))
    left, right = (first.select(F.col("fp").alias(f"fp_{end}"), F.col("a").alias(end), F.col("size_a").alias(f"size_{end}")) for end in "ab")
    links = near_links(first.select("fp"), TAU).distinct().toDF("fp_a", "fp_b")
    linked = links.join(left, "fp_a").join(right, "fp_b").select("a", "size_a", "b", "size_b")
    alike = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    return same.union(linked).filter(alike).select("a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b"))


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(row, hashes)`` of the texts in ``wanted (k0, k1, row)``, by a second pass over the texts."""
    slot = F.col("k0").bitwiseAND(FILTER_BITS - 1)
    marks = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(k0 & 63 AS INT)))").alias("bits"))
    found, words = marks.toArrow(), np.zeros(FILTER_BITS // 64, np.int64)  # as many rows as the filter has words at most
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    filled = share(docs.sparkSession, words.view(np.uint64))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        marked, keys, sets = filled(), [], []
        for text in utf8(batch.column(0)):
            key = xxhash.xxh3_128_intdigest(b" ".join(split := text.lower().split()))
            at = (key >> 64) % FILTER_BITS
            if int(marked[at >> 6]) >> (at & 63) & 1:
                keys.append([key >> 64, key & (1 << 64) - 1])
                sets.append(shingle_set(split, width))
        if not keys:
            return None
        columns = np.array(keys, np.uint64).view(np.int64).T
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), hashes], ["k0", "k1", "hashes"])

    made = map_batches(docs.select("text"), run, "k0 long, k1 long, hashes array<long>")
    return made.dropDuplicates(["k0", "k1"]).join(wanted, ["k0", "k1"]).select("row", "hashes")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b, ...)`` whose sets have the similarity.

    Most pairs have much less, so they are first compared by hashes of half the bytes; collisions of these can only
    make sets look more alike, but for the sizes, which count whole hashes.  Pairs are written first, so that their
    size is known: where they are few, Spark takes them to the sets instead of shuffling all sets.
    """
    pairs = materialize(pairs, "jaccard-pairs")
    least = F.lit(similarity)
    half = sets.select("row", F.size("hashes").alias("size"), F.transform("hashes", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("short"))
    for hashes, last in ((half, False), (sets.withColumnRenamed("hashes", "short").withColumn("size", F.size("short")), True)):
        left, right = (hashes.select(F.col("row").alias(end), F.col("size").alias(f"size_{end}"), F.col("short").alias(f"short_{end}")) for end in "ab")
        right = right.join(pairs.select("b").distinct(), "b", "left_semi")
        both = pairs.join(left, "a").join(right, "b")
        common = F.col("size_a") + F.col("size_b") - F.size(F.array_union("short_a", "short_b")) if not last else F.size(F.array_intersect("short_a", "short_b"))
        both = both.select(*pairs.columns, (F.col("size_a") + F.col("size_b")).alias("sum"), common.alias("shared"))
        pairs = materialize(both.filter(F.col("shared") / (F.col("sum") - F.col("shared")) >= least).select(*pairs.columns), "jaccard-links" if last else "jaccard-close")
    return pairs


def prefix_pairs(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b, label_a, label_b)``: pairs of ``rows(row, label)`` of different labels that may be similar, among them
    all that are.

    Rows of the label that is the most frequent one with a shingle are only compared with those of others, so a group
    of any size that is known to belong together is never paired with itself.
    """
    t = similarity
    texts = materialize(rows.join(sets, "row").select("row", "label", "hashes"), "jaccard-texts")
    listed = materialize(_prefixes(texts, t), "jaccard-prefixes")
    labels = listed.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = labels.groupBy("h").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    listed = split_join(listed, mixed.select("h", "top"), ["h"])
    small = listed.filter(F.col("pos") <= F.col("size") - F.ceil(2 * t / (1 + t) * F.col("size") - 1e-9))
    sides = ((small.filter("label <> top"), listed), (small.filter("label = top"), listed.filter("label <> top")))
    found = []
    for x, y in sides:
        left = x.select(*(F.col(c).alias(f"{c}_a") for c in ("row", "label", "size", "pos")), "h")
        right = y.select(*(F.col(c).alias(f"{c}_b") for c in ("row", "label", "size", "pos")), "h")
        met = split_join(left, right, ["h"]).filter("label_a <> label_b AND (size_a < size_b OR (size_a = size_b AND row_a < row_b))")
        need = F.ceil(t / (1 + t) * (F.col("size_a") + F.col("size_b")) - 1e-9)
        met = met.filter((F.col("size_a") >= t * F.col("size_b") - 1e-9) & (F.least(F.expr("size_a - pos_a"), F.expr("size_b - pos_b")) >= need))
        found.append(met.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "label_a", "label_b"))
    return found[0].union(found[1]).distinct()


def _frequencies(texts: DataFrame) -> np.ndarray:
    """About how many of the ``texts(hashes)`` have a shingle, by the low bits of its hash: shingles that share a cell
    are counted together.  An order of shingles by it is as good as by exact counts for all that many texts have, and
    any order that all texts share is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & CELLS - 1, minlength=CELLS)
        if total.any():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["cell", "n"])

    counted, cells = texts.select("hashes").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow(), np.zeros(CELLS, np.int64)
    cells[counted["cell"].to_numpy()] = counted["n"].to_numpy()  # as many rows as there are cells at most
    return cells


def _prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """``(row, label, size, pos, h)``: of the shingles of each of ``texts(row, label, hashes)``, the rarest first, those
    of which it must share one with any set of its size or less that is similar."""
    counts = share(texts.sparkSession, _frequencies(texts))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(2)
        sizes = np.diff(column.offsets.to_numpy())
        hashes, text = column.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((hashes, counts()[hashes & CELLS - 1], text))
        pos = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = pos <= (sizes - np.ceil(similarity * sizes - 1e-9))[text]
        of = text[keep]
        numbers = (batch.column(0).to_numpy()[of], batch.column(1).to_numpy()[of], sizes[of].astype(np.int32), pos[keep].astype(np.int32), hashes[order][keep])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["row", "label", "size", "pos", "h"])

    return map_batches(texts.select("row", "label", "hashes"), run, "row long, label long, size int, pos int, h long")


def _components(unique: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """``(node, component)`` of the rows of ``unique`` that meet another."""
    rows = unique.filter("size > 0").select("row", F.col("size").cast("int").alias("size"), F.explode(F.array(*_BAND_COLUMNS)).alias("val"))
    shared = rows.groupBy("val").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("val")
    met = materialize(split_join(rows, shared, ["val"]), "jaccard-buckets")
    near = materialize(simhash_pairs(unique, similarity), "jaccard-simhash")
    ends = met.select("row").union(near.select("a")).union(near.select("b")).distinct()
    wanted = materialize(unique.select("k0", "k1", "row").join(ends, "row", "left_semi"), "jaccard-wanted")
    sets = materialize(_sets_of(docs, wanted, width), "jaccard-sets")
    release(docs.sparkSession)
    undecided, labels, turn = met.select("val", "row", "size", F.col("row").alias("label")), wanted.select("row", F.col("row").alias("label")), 0
    while True:
        here = F.struct("row", "label", "size")
        centre = undecided.groupBy("val").agg(F.min_by(here, F.xxhash64("row", F.lit(turn))).alias("c")).select("val", F.col("c.row").alias("a"), F.col("c.label").alias("label_a"), F.col("c.size").alias("size_a"))
        alike = F.least("size", "size_a") >= similarity * F.greatest("size", "size_a") - 1e-9
        pairs = split_join(undecided, centre, ["val"]).filter("label <> label_a").filter(alike).select("a", F.col("row").alias("b"), "label_a", F.col("label").alias("label_b"))
        pairs = (pairs if turn else near.union(pairs)).distinct()
        links = _verified(pairs, sets, similarity)
        labels = _relabelled(labels, links)
        labelled = undecided.drop("label").join(labels, "row")
        several = labelled.groupBy("val").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("val")
        undecided, turn = materialize(split_join(labelled, several, ["val"]).select("val", "row", "size", "label"), "jaccard-open"), turn + 1
        release(docs.sparkSession)
        if links.count() * JOINED_SHARE < undecided.select("row").distinct().count() or not undecided.head(1):
            break
    left = prefix_pairs(undecided.select("row", "label").distinct(), sets, similarity)
    return _relabelled(labels, _verified(left, sets, similarity)).toDF("node", "component")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(row, label)`` after the links ``(label_a, label_b)``."""
    joined = connected_components(links, "label_a", "label_b").toDF("label", "low")
    return materialize(labels.join(joined, "label", "left").select("row", F.coalesce("low", "label").alias("label")), "jaccard-labels")


def jaccard_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``(doc_id, key, component_id, group)``: groups of documents whose sets of ``width``-word shingles are similar.

    ``group`` names a group and tells groups apart whose smallest id is the same.
    Texts with equal words (in lower case) are one.  Others link if the Jaccard similarity of their sets of distinct
    shingles is ``similarity`` or more; a text of up to ``width`` words is one shingle.  No pair below it links, and
    one at 0.8 meets with a chance of 0.99993, one above it with a higher one.  Columns, null and empty texts, null ids
    and repeated rows are treated as by ``simhash_groups``.
    """
    bound_batches(docs.sparkSession)
    key = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("k0", "k1")]).alias("key")
    made = materialize(band_values(docs, width).withColumn("row", F.monotonically_increasing_id()), "jaccard-bands")
    unique = made.groupBy("k0", "k1", "size", "fp", *_BAND_COLUMNS).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    unique = materialize(unique, "jaccard-unique")
    names = unique.select("row", key, "rep", "n")
    linked = _components(unique, docs, similarity, width).join(names.select("row", "key"), F.col("node") == F.col("row")).select(F.col("key").alias("node"), "component")
    return _label(made.select("doc_id", key), names.drop("row"), linked, "key")
