"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the test items as posting lists in blocks.  A weight in it is the BM25 weight of a term in an item
divided by the item's own score as a query, so an item scores 1 against its own text and one threshold fits all.
Every training text is cut into passages that overlap by half and are long enough to hold any item whole.  A
passage is a query of distinct terms:

* the items are divided into RANGES ranges of consecutive items, and a table has each term's largest weight in each
  range.  The sum of the passage's rows of this table bounds every item's score; where no range reaches the
  threshold, which holds for nearly all passages, no posting list is looked up;
* otherwise block-max WAND walks the posting lists in item order: terms are added up in order of their next item
  until their bounds reach the threshold, the item reached is the pivot, and where the bounds of the blocks around
  the pivot stay below, the walk skips past the shortest of these blocks;
* all items at or above the threshold are retrieved, without a cap, and verified: the word n-grams of the item's
  question and of its answer must each be in the passage to the ``overlap`` share.  An item without an answer is cut
  in half for that, and it is also enough that its whole text is there to the share of the score's threshold, so a
  long excerpt from one end counts.

Only test items are held in memory.  Beyond MOST_INDEX_BYTES they are indexed in blocks of items.  The number of
items, their mean and largest length and the document frequencies are those of all items in every block, so scores,
passages and results do not depend on the blocks.  One pass over the corpus queries up to BLOCKS_A_PASS blocks.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowloom.llm.columns import bound_batches, share
from flowloom.storage import materialize

#: Text of the test items in one index, which is sent to every task.
MOST_INDEX_BYTES = 8 << 20
#: Blocks that a task holds at once: the corpus is read once for so many.
BLOCKS_A_PASS = 16
#: Ranges of items, and bytes, of the table of largest weights.
RANGES, MOST_TABLE_BYTES = 64, 64 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Word n-grams; shorter sequences are one n-gram."""
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else ({tuple(words)} if words else set())


class Statistics(NamedTuple):
    """Of all test items: how many have words, their mean and largest number of words, and the document frequencies
    of the terms of a block."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[list[str]]) -> Statistics:
        texts = [t for t in texts if t]
        return cls(len(texts), sum(map(len, texts)) / max(len(texts), 1), max(map(len, texts), default=1), Counter(t for words in texts for t in set(words)))


class Postings:
    """One term's items in order with their weights, and the largest weight of each block of them."""

    __slots__ = ("block", "items", "tops", "weights")

    def __init__(self, entries: list[tuple[int, float]], block: int):
        self.items = array("i", [i for i, _ in entries])
        self.weights = array("d", [w for _, w in entries])
        self.tops = array("d", [max(self.weights[i : i + block]) for i in range(0, len(entries), block)])
        self.block = block


class Index:
    """BM25 posting lists of test items ``(item, question, answer)``; texts without words are left out.

    ``statistics`` are those of all items where these are one block of them.
    """

    def __init__(
        self, items: list[tuple[object, str, str | None]], statistics: Statistics | None = None, k1: float = 1.2, b: float = 0.75, gram: int = 5, block: int = 16
    ):
        self.gram, self.ids, self.parts, self.whole, texts = gram, [], [], [], []
        for item, question, answer in items:
            q, a = words_of(question or ""), words_of(answer or "")
            if not q + a:
                continue
            texts.append(q + a)
            self.ids.append(item)
            self.whole.append(None if a else ngrams(q, gram))
            if not a:
                q, a = q[: (len(q) + 1) // 2], q[(len(q) + 1) // 2 :]
            # n-grams that straddle the two parts belong to the answer, which then starts gram - 1 words early
            self.parts.append((ngrams(q, gram), ngrams(q[max(0, len(q) - gram + 1) :] + a, gram)))
        n, mean, self.longest, df = statistics or Statistics.of(texts)
        entries: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, words in enumerate(texts):
            tf = Counter(words)
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / mean)) for t, f in tf.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                entries[t].append((i, w / own))
        self.number = {t: j for j, t in enumerate(entries)}
        self.postings = [Postings(e, block) for e in entries.values()]
        self.tops = [max(p.weights) for p in self.postings]
        here = max(len(texts), 1)
        ranges = max(1, min(RANGES, here, MOST_TABLE_BYTES // (8 * max(len(entries), 1))))
        self.table = np.zeros((len(entries), ranges))
        for t, p in enumerate(self.postings):
            np.maximum.at(self.table[t], np.array(p.items, np.int64) * ranges // here, np.array(p.weights))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at or above the threshold for a query of distinct terms, by block-max WAND."""
        lists = [(self.postings[t], self.tops[t]) for t in terms]
        at = [0] * len(lists)
        order, found = list(range(len(lists))), []
        least = threshold - 1e-9
        while True:
            order = [j for j in order if at[j] < len(lists[j][0].items)]
            order.sort(key=lambda j: lists[j][0].items[at[j]])
            bound, pivot = 0.0, None
            for k, j in enumerate(order):
                bound += lists[j][1]
                if bound >= least:
                    pivot = lists[j][0].items[at[j]]
                    break
            if pivot is None:
                return found
            while k + 1 < len(order) and lists[order[k + 1]][0].items[at[order[k + 1]]] == pivot:
                k += 1
            shallow, end = 0.0, math.inf
            for j in order[: k + 1]:
                p = lists[j][0]
                blk = at[j] // p.block
                while (blk + 1) * p.block <= len(p.items) and p.items[(blk + 1) * p.block - 1] < pivot:
                    blk += 1
                if blk < len(p.tops):
                    shallow += p.tops[blk]
                    end = min(end, p.items[min((blk + 1) * p.block, len(p.items)) - 1])
            if shallow < least:  # no item up to the end of the nearest block can reach the threshold
                to = end + 1
                if k + 1 < len(order):
                    to = min(to, lists[order[k + 1]][0].items[at[order[k + 1]]])
                to = max(to, pivot + 1)
                for j in order[: k + 1]:
                    at[j] = _skip(lists[j][0].items, at[j], to)
            elif lists[order[0]][0].items[at[order[0]]] == pivot:
                score = math.fsum(lists[j][0].weights[at[j]] for j in order[: k + 1])  # whatever the order of terms
                for j in order[: k + 1]:
                    at[j] += 1
                if score >= least:
                    found.append((pivot, score))
            else:
                for j in order[: k + 1]:
                    at[j] = _skip(lists[j][0].items, at[j], pivot)

    def leaks(self, words: list[str], threshold: float, overlap: float) -> list[tuple[object, float, float, float, int]]:
        """``(item, score, question share, answer share, first word of the best passage)`` of every verified item."""
        if not words or not self.postings:
            return []
        terms = list(map(self.number.get, words))
        size, step = 2 * self.longest, self.longest
        best: dict[int, tuple] = {}
        for at in range(0, max(len(words) - self.longest, 1), step):
            query = set(terms[at : at + size])
            query.discard(None)
            if not query or self.table[list(query)].sum(axis=0).max() < threshold - 1e-6:
                continue
            grams = None
            for i, score in self.search(sorted(query), threshold):
                grams = grams if grams is not None else self._grams(words[at : at + size])
                q, a = (len(p & grams) / len(p) if p else 1.0 for p in self.parts[i])
                whole = self.whole[i]
                held = min(q, a) >= overlap - 1e-9 or whole is not None and len(whole & grams) / len(whole) >= threshold - 1e-9
                if held and (i not in best or (q + a, score) > (best[i][1] + best[i][2], best[i][0])):
                    best[i] = (score, q, a, at)
        return [(self.ids[i], *found) for i, found in sorted(best.items())]

    def _grams(self, words: list[str]) -> set[tuple[str, ...]]:
        """N-grams of a passage, and its shorter sequences where the index has items that short."""
        found = ngrams(words, self.gram)
        for n in {len(g) for p in self.parts for part in p for g in part if len(g) < self.gram}:
            found |= ngrams(words, n)
        return found


def _skip(items: list[int], at: int, to: int) -> int:
    """The first place from ``at`` on with an item of at least ``to``, by galloping."""
    step = 1
    while at + step < len(items) and items[at + step] < to:
        step *= 2
    low, high = at + step // 2, min(at + step, len(items))
    while low < high:
        mid = (low + high) // 2
        if items[mid] < to:
            low = mid + 1
        else:
            high = mid
    return low


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, gram: int = 5, index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, at_word)`` for every verified pair.

    ``docs`` needs ``doc_id`` and ``text``; ``benchmark`` needs ``item_id`` and ``text`` and may have ``answer``;
    other columns are ignored.  Without an answer the two overlaps are those of the text's halves, and it is also
    enough that ``threshold`` of all its n-grams are there.  Null or wordless texts and items leak nothing; a repeated row gives its pairs
    again, a repeated item too.  Empty tables give no rows.  Words are compared in lower case without punctuation.
    """
    bound_batches(docs.sparkSession)
    id_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, at_word long"
    item = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = [docs.select("doc_id", "text").mapInArrow(_finder(some, threshold, overlap, item), schema) for some in _passes(benchmark, gram, index_bytes)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _leaks(blocks: list, text: str | None, threshold: float, overlap: float) -> Iterator[tuple]:
    words = words_of(text) if text else []
    for shared in blocks:
        yield from shared().leaks(words, threshold, overlap)


def _finder(blocks: list, threshold: float, overlap: float, item: pa.DataType):
    names = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "at_word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(key, *leak) for key, text in texts for leak in _leaks(blocks, text, threshold, overlap)]
            if rows:
                types = (batch.schema.field(0).type, item, pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _passes(benchmark: DataFrame, gram: int, index_bytes: int) -> Iterator[list]:
    """Broadcast indexes of blocks that together hold all test items, as many as one pass queries."""
    spark, answer = benchmark.sparkSession, F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select("item_id", F.col("text").alias("question"), answer.alias("answer")).filter("question IS NOT NULL OR answer IS NOT NULL")
    total = items.agg(F.sum(F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    blocks = math.ceil(total / index_bytes)
    if not blocks:
        return
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "question"), F.lit(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, t, n) for b, q, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for t, n in _terms(words_of(q or "") + words_of(a or ""))]
            if rows:
                types = (pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "term", "words"])

    terms = materialize(items.select("block", "question", "answer").mapInArrow(run, "block long, term string, words long"), "bm25-terms")
    sizes = terms.filter("term IS NULL").agg(F.count(F.lit(1)), F.sum("words"), F.max("words")).first()
    if not sizes[0]:
        return
    df = terms.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for first in range(0, blocks, BLOCKS_A_PASS):
        held = []
        for block in range(first, min(first + BLOCKS_A_PASS, blocks)):
            here = F.col("block") == block
            known = df.join(terms.filter(here).select("term").distinct(), "term", "left_semi").collect()  # terms of index_bytes of text
            statistics = Statistics(sizes[0], sizes[1] / sizes[0], sizes[2], {r["term"]: r["df"] for r in known})
            mine = items.filter(here).sort("item_id", "question", "answer").collect()
            held.append(share(spark, Index([(r["item_id"], r["question"], r["answer"]) for r in mine], statistics, gram=gram)))
        yield held


def _terms(words: list[str]) -> Iterator[tuple[str | None, int]]:
    """An item's distinct terms, and its number of words with a null term; nothing without words."""
    if words:
        yield None, len(words)
        yield from ((t, 0) for t in set(words))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, gram: int = 5, index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_leaks`` finds nothing.

    Rows with null or empty text stay, and so do repeated rows; an empty table gives none.  The decision is made where
    the text is read, so nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    place, schema = docs.columns.index("text"), docs.schema

    def keeper(blocks: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(_leaks(blocks, text, threshold, overlap), None) is None for text in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for some in _passes(benchmark, gram, index_bytes):
        docs = docs.mapInArrow(keeper(some), schema)
    return docs
