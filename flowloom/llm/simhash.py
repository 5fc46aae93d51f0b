"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Fingerprints within ``tau`` bits are found without comparing all pairs.  The 64 bits are divided into partitions
of correlated bits, and partition i gets a threshold t_i of -1 or more such that the sum of (t_i + 1) is tau + 1.
Two fingerprints within tau bits are then within t_i in some partition i.  How many partitions, and which
thresholds, is decided by dynamic programming over estimated costs: rows probed and candidate pairs verified,
estimated from bit statistics of all fingerprints.

A fingerprint probes partition i with its bits there and with every value that has up to t_i of its set bits
cleared: two values within t_i meet where both have cleared what the other lacks.  Fingerprints that meet in a
bucket are verified on all 64 bits.  A bucket yields a spanning forest of its links rather than all its pairs: an
absorbed fingerprint is never compared again within the bucket.  A bucket of more than ``cap`` fingerprints is not
held in memory: its rows are divided again by the pigeonhole principle over the bits that it has not used yet.

The fingerprints are distinct, so those that agree on all bits used so far differ in others, and every division
separates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.columns import bound_batches, map_batches, utf8, wide_batches
from flowloom.operators.components import connected_components
from flowloom.operators.joins import fresh
from flowloom.storage import materialize

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: Seconds that a probe row and a verified pair are taken to cost; only their ratio matters.
ROW_COST, PAIR_COST = 2e-6, 2e-8


def _majority(shingles: Iterator[bytes], seed: int) -> bytes:
    """The bits set in over half of the digests."""
    offsets = np.arange(8, dtype=np.int64) * 256
    counts, n = np.zeros((8, 8)), 0
    while some := list(islice(shingles, 1 << 15)):
        n += len(some)
        rows = np.frombuffer(b"".join(map(xxhash.xxh64_digest, some, repeat(seed))), np.uint8).reshape(-1, 8)
        counts += np.bincount((rows + offsets).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return np.packbits(2 * counts.ravel() > n).tobytes()


def _shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    """Word shingles, or the whole sequence where it is shorter."""
    if len(words) <= width:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text; a bit is set if it is set in over half of the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    return int.from_bytes(_majority(_shingles(words, width), seed), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long; null and empty texts have fingerprint 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


# --- statistics and plan


def bit_statistics(unique: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how often both are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            x = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += x.T @ x
            n += batch.num_rows
        if n:
            cells = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = unique.select("fp").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for r in rows:  # a row for each pair of bits at most
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def agreement(n: int, both: np.ndarray) -> np.ndarray:
    """The chance that two random fingerprints agree on bits j and k; on the diagonal, that they agree on bit j."""
    p11 = both / max(n, 1)
    p1 = np.diag(p11)
    p10, p01 = p1[:, None] - p11, p1[None, :] - p11
    joint = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
    np.fill_diagonal(joint, p1**2 + (1 - p1) ** 2)
    return joint


def group_bits(joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` partitions of about equal size, each in an order in which neighbours are most correlated."""
    p = np.diag(joint)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        rest = sorted(left)
        group = [max(rest, key=lambda b: corr[b, rest].sum())]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (corr[b, group[-1]], corr[b, group].sum(), -b)))
        left -= set(group)
        groups.append(group)
    return groups


def candidate_share(joint: np.ndarray, bits: list[int], threshold: int) -> float:
    """The estimated share of pairs within ``threshold`` on these bits, by a Markov chain of agreements."""
    agree = [joint[bits[0], bits[0]], 1 - joint[bits[0], bits[0]]]
    state = {(1, 0): agree[0], (0, 1): agree[1]}
    for a, b in zip(bits, bits[1:], strict=False):
        pa_, pb, pab = joint[a, a], joint[b, b], joint[a, b]
        given = {1: pab / max(pa_, 1e-12), 0: (pb - pab) / max(1 - pa_, 1e-12)}
        then: dict[tuple[int, int], float] = {}
        for (was, off), chance in state.items():
            up = min(max(given[was], 0.0), 1.0)
            for now, p in ((1, up), (0, 1 - up)):
                if off + 1 - now <= threshold:
                    then[now, off + 1 - now] = then.get((now, off + 1 - now), 0.0) + chance * p
        state = then
    return sum(p for (_, off), p in state.items() if off <= threshold)


def allocate(n: int, joint: np.ndarray, tau: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """Partitions with thresholds of 0 or more, by dynamic programming over the budget tau + 1 for each number of
    partitions; partitions with threshold -1 are left out."""
    best = (float("inf"), [])
    for parts in range(1, most_parts + 1):
        groups = group_bits(joint, parts)
        table: list[tuple[float, list]] = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
        for bits in groups:
            rows, costs = 0.0, [0.0]
            ones, choose = sum(0.5 for _ in bits), 1.0
            for t in range(min(tau + 1, len(bits))):
                rows += choose
                choose *= max(ones - t, 0) / (t + 1)
                costs.append(n * rows * ROW_COST + n * n / 2 * candidate_share(joint, bits, t) * PAIR_COST)
            table = [
                min(((table[b - s][0] + c, table[b - s][1] + [(bits, s - 1)] * (s > 0)) for s, c in enumerate(costs) if s <= b), key=lambda x: x[0])
                for b in range(tau + 2)
            ]
        best = min(best, table[tau + 1], key=lambda x: x[0])
    return best[1]


# --- probing and verifying


def spanning_links(fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(a, b)`` of a spanning forest of the links within ``tau`` bits."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = np.bitwise_count(fps[rest] ^ fps[at]) <= tau
            if hit.any():
                found = rest[hit]
                left += [at] * len(found)
                right += found.tolist()
                front += found.tolist()
                rest = rest[~hit]
    return np.array(left, np.int64), np.array(right, np.int64)


def _link(tau: int, cap: int, dividable: frozenset[str], small: int = 16):
    """Over rows ``(path, val, fp)`` sorted by bucket: links, and all rows of buckets over the cap.

    Rows out are ``(path, val, a, b)``: ``a`` is the fingerprint of a row passed on, and with a null path both are the
    ends of a link.  A path that has too few unused bits for another division is never passed on; its buckets hold
    fingerprints that agree on nearly all bits and so are few.
    """
    names = ["path", "val", "a", "b"]

    def links(paths: np.ndarray, vals: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        starts = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]) | (vals[1:] != vals[:-1])))
        sizes = np.diff(np.append(starts, len(fps)))
        bucket = np.repeat(np.arange(len(starts)), sizes)
        of = sizes[bucket]
        left, right = [], []
        few = np.flatnonzero((of > 1) & (of <= small))
        for step in range(1, min(small, len(few))):
            a, b = few[:-step], few[step:]
            same = bucket[a] == bucket[b]
            a, b = a[same], b[same]
            hit = np.bitwise_count(fps[a] ^ fps[b]) <= tau
            left.append(a[hit])
            right.append(b[hit])
        for k in np.flatnonzero(sizes > small):
            a, b = spanning_links(fps[starts[k] : starts[k] + sizes[k]], tau)
            left.append(a + starts[k])
            right.append(b + starts[k])
        if left and (n := sum(map(len, left))):
            ends = (pa.array(fps[np.concatenate(x)].view(np.int64)) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), *ends], names)

    def over(path: str, val: int, fps: np.ndarray) -> pa.RecordBatch:
        n = len(fps)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, val)), pa.array(fps.view(np.int64)), pa.nulls(n, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(zero_copy_only=False).astype(object), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            paths, vals, fps = now
            if hot is not None:  # the bucket that is being passed on
                n = int(np.argmin(np.append((paths == hot[0]) & (vals == hot[1]), False)))
                if n:
                    yield over(*hot, fps[:n])
                paths, vals, fps = paths[n:], vals[n:], fps[n:]
                held = None
                if not len(fps):
                    continue
                hot = None
            last = len(fps) - int(np.argmin(np.append(((paths == paths[-1]) & (vals == vals[-1]))[::-1], False)))
            if last:
                yield from links(paths[:last], vals[:last], fps[:last])
            held = (paths[last:], vals[last:], fps[last:])
            if len(held[2]) > cap and held[0][0] in dividable:
                hot = (held[0][0], int(held[1][0]))
                yield over(*hot, held[2])
                held = None
        if held is not None and len(held[2]):
            yield from links(*held)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probe(df: DataFrame, blocks: list[tuple[str, list[int], int]], base=None) -> DataFrame:
    """Rows ``(path, val, fp)`` for every block ``(path, bits, threshold)``; ``base`` is the bucket that is divided."""

    def cleared(values, bits: list[int]):
        """The values, and each with one more of the bits cleared."""
        masks = F.array(*[F.lit(_signed(~(1 << b) & ((1 << 64) - 1))) for b in bits])
        return F.array_distinct(F.concat(values, F.flatten(F.transform(values, lambda x: F.transform(masks, lambda m: x.bitwiseAND(m))))))

    def keys(path: str, values):
        return F.transform(values, lambda x: F.struct(F.lit(path).alias("path"), (x if base is None else F.xxhash64(base, x)).alias("val")))

    rows = []
    for path, bits, threshold in blocks:
        values = F.array(F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))))
        for _ in range(threshold):
            values = cleared(values, bits)
        rows.append(keys(path, values))
    return df.select(F.explode(F.concat(*rows)).alias("k"), "fp").select("k.path", "k.val", "fp")


def near_links(unique: DataFrame, tau: int = 3, cap: int = 8192) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints, enough to connect all that are within ``tau`` bits in a row.

    A bucket over the cap is divided over the bits that its path has not used: tau + 1 parts of these, of which two
    fingerprints within tau bits agree on one.  Rows passed on are distinct fingerprints of one bucket, so each
    division spreads them over up to 2^bits buckets of its parts.
    """
    n, both = bit_statistics(unique)
    schema = "path string, val long, a long, b long"
    if n < 2:
        return unique.sparkSession.createDataFrame([], schema).select("a", "b")
    blocks = [(str(i), bits, t) for i, (bits, t) in enumerate(allocate(n, agreement(n, both), tau))]
    used = {path: set(bits) for path, bits, _ in blocks}
    rows, found = _probe(unique, blocks), []
    while True:
        dividable = frozenset(path for path, bits in used.items() if BITS - len(bits) > tau)
        dealt = rows.repartition("path", "val").sortWithinPartitions("path", "val", "fp")
        with wide_batches(unique.sparkSession):
            out = materialize(dealt.mapInArrow(_link(tau, cap, dividable), schema), "simhash-links")
        found.append(out.filter("path IS NULL").select("a", "b"))
        hot = out.filter("path IS NOT NULL").select("path", "val", F.col("a").alias("fp"))
        paths = [r["path"] for r in hot.select("path").distinct().collect()]  # as many as partitions used so far
        if not paths:
            break
        pieces, then = [], {}
        for path in sorted(paths):
            rest = [b for b in range(BITS) if b not in used[path]]
            again = [(f"{path}.{i}", rest[i :: tau + 1], 0) for i in range(tau + 1)]
            then |= {p: used[path] | set(bits) for p, bits, _ in again}
            pieces.append(_probe(hot.filter(F.col("path") == path), again, F.col("val")))
        used, rows = then, reduce(DataFrame.union, pieces)
    return reduce(DataFrame.union, found)


def _label(rows: DataFrame, unique: DataFrame, linked: DataFrame, key: str, hot_share: int = 1000) -> DataFrame:
    """``rows`` with the ``component_id`` of their key, and a name of their ``group``.

    Keys with more than one row in ``hot_share`` are fewer than that by count, so they are joined by broadcast, and
    a key that holds a third of all rows is no task of its own.
    """
    touched = linked.join(unique, linked["node"] == unique[key]).select(key, "component", "rep")
    label = touched.groupBy("component").agg(F.min("rep").alias("low"))
    moved = touched.join(label, "component").select(key, "low", "component")
    labelled = unique.join(moved, key, "left").select(key, "n", F.coalesce("low", "rep").alias("component_id"), F.coalesce(F.col("component").cast("string"), F.col(key).cast("string")).alias("group"))
    labelled = materialize(labelled, "simhash-labels")
    limit = (unique.agg(F.sum("n")).first()[0] or 0) / hot_share
    hot = labelled.filter(F.col("n") > limit).select(F.col(key).alias("_key"), "component_id", "group", F.lit(True).alias("_hot"))
    seen = rows.join(F.broadcast(hot), rows[key] == hot["_key"], "left").drop("_key")
    columns = [*rows.columns, "component_id", "group"]
    common = seen.filter("_hot").select(columns)
    rest = seen.filter("_hot IS NULL").select(rows.columns).join(labelled.filter(F.col("n") <= limit).select(key, "component_id", "group"), key)
    return common.union(rest.select(columns))


def simhash_groups(docs: DataFrame, width: int = 3, tau: int = 3, seed: int = 42, cap: int = 8192) -> DataFrame:
    """``(doc_id, fp, component_id, group)``: groups of documents whose fingerprints link at ``tau`` or fewer bits;
    ``group`` names a group.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Texts without words, null among them, have
    fingerprint 0 and link like any other.  Every row gets a row: repeated rows share fingerprint and group.
    ``component_id`` is the smallest id in the group; a null id is never the smallest, and a group of null ids
    alone has null.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    fps = materialize(fingerprints(docs, width, seed), "simhash-fp")
    unique = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-unique")
    linked = connected_components(near_links(unique.select("fp"), tau, cap), "a", "b")
    return _label(fps, unique, linked, "fp")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group, all columns: one with the group's smallest id.

    ``groups`` has ``(doc_id, key, component_id, group)`` of every row of ``docs``, with keys of texts as
    ``text_key`` makes them.  Where an id stands on several rows, the row is told by its text: of the group's texts
    with that id the one with the smallest key, and of its rows the first by all columns.  In groups without any id
    one row stays in the same way; an empty table gives none.  Only rows whose id is null or repeated are hashed again.
    Rows are dropped by the ids that go, which are fewer than those that stay, so that Spark can take them to the texts
    rather than shuffle the texts.
    """
    ids = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("low"))
    ids = materialize(ids.filter("n > 1 OR NOT low"), "keep-ids")
    kept = docs.filter("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").select(docs.columns)
    several = ids.filter("n > 1 AND low").select("doc_id")
    unsure = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).join(several, "doc_id", "left_semi").union(groups.filter("doc_id IS NULL AND component_id IS NULL"))
    if not unsure.head(1):
        return kept
    name = fresh("key", docs)
    chosen = unsure.groupBy("group", "doc_id").agg(F.min("key").alias(name)).select(F.col("doc_id").alias("_id"), name).distinct()
    place, schema = docs.columns.index("text"), T.StructType([*docs.schema, T.StructField(name, T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [text_key(t) for t in utf8(batch.column(place))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], [*batch.schema.names, name])

    candidates = docs.join(several, "doc_id", "left_semi").select(docs.columns).union(docs.filter("doc_id IS NULL"))
    keyed = map_batches(candidates, run, schema)
    same = keyed["doc_id"].eqNullSafe(chosen["_id"]) & (keyed[name] == chosen[name])
    rows = keyed.join(chosen, same, "left_semi")
    one = rows.groupBy("doc_id", name).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row"))
    return kept.union(one.select("row.*"))


def text_key(text: bytes) -> str:
    """128 bits of a text's words in lower case, in hexadecimal digits."""
    return xxhash.xxh3_128_hexdigest(b" ".join(text.lower().split())).upper()


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
