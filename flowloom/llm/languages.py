"""Language identification as multilingual mixture inference.

A document is a mixture of languages.  Each language has a distribution over byte n-grams (hashed to a fixed number
of cells, smoothed); expectation-maximisation finds the proportions under which the document's n-grams are most
likely.  Which languages are in the mixture is a choice by penalised likelihood: starting from the best single
language, the language that helps most is added as long as the log-likelihood grows by more than the penalty of one
more proportion; where none is, pairs of others are tried.  Then single languages are dropped or exchanged while that
helps.

The likelihood is concave in the proportions.  So at any proportions, the logarithm of the largest gradient component
(the mean over n-grams of a language's probability by the mixture's) times the number of n-grams bounds how much more
any mixture of the languages can reach.  It proves that expectation-maximisation has converged, and that languages
with a component below the penalty need not be tried; most documents are settled by it at the first language.

Training counts n-grams of all labelled rows in one distributed aggregation; the model is languages x cells and is
bounded by MOST_LANGUAGES, beyond which training fails: such a model would have to be cut by cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.columns import bound_batches, map_batches, share, utf8

#: Cells of the hashed n-grams; more languages than this would make the model too large to send to every task.
CELLS, MOST_LANGUAGES = 1 << 15, 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A to Z in lower case; other ASCII that is no letter stands for a word boundary.
_FOLD = bytes(32 if (c := _LOWER[i]) < 128 and not 97 <= c <= 122 else c for i in range(256))
#: Log-likelihood by which an exchange of languages must help: that of converged mixtures is known this closely.
CLOSE = 2e-3
#: Bytes of a text counted at once.
_CHUNK = 1 << 20


def _letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(text: bytes) -> np.ndarray:
    """How often each cell's byte 3-grams occur, over letters with runs of everything else as one blank."""
    clean = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    total = np.zeros(CELLS, np.int64)
    for at in range(0, max(len(clean) - 2, 1), _CHUNK):
        b = np.frombuffer(clean[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            code = b[:-2] * np.uint32(0x10000) + b[1:-1] * np.uint32(0x100) + b[2:]
            total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(17), minlength=CELLS)
    return total


class Model:
    """Log-probabilities of the cells in each language."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.names = names
        smooth = counts + smoothing
        self.prob = (smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if names else np.zeros((CELLS, 0))
        self.log = np.log(self.prob)

    def mixture(self, counts: np.ndarray, prob: np.ndarray, rounds: int = 5000, close: float = 1e-3) -> tuple[np.ndarray, float]:
        """Proportions of these languages by expectation-maximisation, and the log-likelihood, which is within
        ``close`` of the largest."""
        k = prob.shape[1]
        share, n = np.full(k, 1 / k), counts.sum()
        if k == 1:
            return share, float(counts @ np.log(prob[:, 0]))
        for _ in range(rounds):
            mixed = prob @ share
            gradient = counts / mixed @ prob / n
            if n * math.log(gradient.max()) <= close:
                break
            share = share * gradient
            share /= share.sum()
        return share, float(counts @ np.log(prob @ share))

    def most_gain(self, counts: np.ndarray, prob: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """For each language of ``prob``, a bound of how much a mixture of ``mixed`` and it can gain."""
        gradient = counts / mixed @ prob / counts.sum()
        return counts.sum() * np.log(np.maximum(gradient, 1.0))

    def _chosen(self, counts: np.ndarray, prob: np.ndarray, alone: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray, float]:
        """The languages, their proportions and the log-likelihood."""
        chosen, share = [int(np.argmax(alone))], np.ones(1)
        best, cost = float(alone[chosen[0]]), penalty + 0.5 * math.log(counts.sum())
        every = range(prob.shape[1])

        def with_one(base: list[int], share: np.ndarray, likely: float, least: float) -> tuple[list[int], np.ndarray, float] | None:
            """``base`` and the language that helps most, where that reaches more than ``least``."""
            gain, top = self.most_gain(counts, prob, prob[:, base] @ share), None
            for j in sorted((j for j in every if j not in base), key=lambda j: -gain[j]):
                if likely + gain[j] <= least:
                    break
                tried = self.mixture(counts, prob[:, [*base, j]])
                if tried[1] > least:
                    top, least = ([*base, j], *tried), tried[1]
            return top

        while more := with_one(chosen, share, best, best + cost):
            chosen, share, best = more
        if len(chosen) == 1 and self.most_gain(counts, prob, prob[:, chosen[0]]).max() > cost and self.mixture(counts, prob)[1] - best > cost:
            for i in every:  # no second language helps the best one enough, but two others may be better
                if more := with_one([i], np.ones(1), float(alone[i]), max(best, float(alone[chosen[0]]) + cost)):
                    chosen, share, best = more
            while len(chosen) > 1 and (more := with_one(chosen, share, best, best + cost)):
                chosen, share, best = more
        moved = len(chosen) > 1
        while moved:
            moved = False
            for i in chosen:
                rest = [j for j in chosen if j != i]
                fewer = self.mixture(counts, prob[:, rest])
                if fewer[1] >= best - cost:
                    chosen, share, best, moved = rest, *fewer, len(rest) > 1
                    break
                if other := with_one(rest, *fewer, best + CLOSE):
                    chosen, share, best = other
                    moved = True
                    break
        return chosen, share, best

    def languages(self, text: bytes, penalty: float = 6.0) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first."""
        return self.explained(text, penalty)[0]

    def explained(self, text: bytes, penalty: float = 6.0, least: float = 1 / 3) -> tuple[list[tuple[str, float]], bool]:
        """The chosen languages, and whether they explain ``least`` of the text if the rest may be noise.

        Noise has all cells equally often.  The likelihood of so much language and the rest noise is concave in the
        share, so the best share is ``least`` or more where it does not fall there.
        """
        counts = ngram_counts(text)
        cells = np.flatnonzero(counts)
        if not len(cells) or not self.names:
            return [], False
        c, prob = counts[cells].astype(np.float64), self.prob[cells]
        chosen, share, _ = self._chosen(c, prob, c @ self.log[cells], penalty)
        found = sorted(((self.names[j], float(s)) for j, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))
        ratio = prob[:, chosen] @ share * CELLS
        return found, bool(c @ ((ratio - 1) / (least * ratio + 1 - least)) >= 0)


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model from all rows with text and label; rows without either teach nothing, repeated rows teach again, and a
    table without any gives a model without languages."""
    bound_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if name not in total and len(total) >= MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                total[name] = total.get(name, 0) + ngram_counts(data)
        for name, counts in total.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["lang", "cell", "n"])

    counted = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    per = counted.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    names, counts = [], []
    for r in per.sort("lang").toLocalIterator():  # a row per language
        if len(names) >= MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        names.append(r["lang"])
        line = np.zeros(CELLS)
        for cell, n in r["cells"]:
            line[cell] = n
        counts.append(line)
    return Model(names, np.array(counts).reshape(len(names), CELLS))


def identify(docs: DataFrame, model: Model, penalty: float = 6.0) -> DataFrame:
    """``(doc_id, lang_pred, score, mixture)`` of every row.

    ``lang_pred`` is the language with the largest proportion and ``score`` that proportion; ``mixture`` has all
    chosen languages.  Texts that are null or have no letter, and all texts under a model without languages, are
    ``und`` with score 0.  Only the text matters; ``doc_id`` is passed on, other columns are ignored.  Repeated
    rows are judged alike; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    entry = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    shared = share(docs.sparkSession, model)  # MOST_LANGUAGES x CELLS numbers at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text, data in zip(batch.column(1).to_pylist(), utf8(batch.column(1)), strict=True):
            found.append(shared().languages(data, penalty) if _letters(text) else [])
        best = [m[0] if m else ("und", 0.0) for m in found]
        mixture = pa.array([[{"lang": k, "share": v} for k, v in m] for m in found], entry)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), mixture], ["doc_id", "lang_pred", "score", "mixture"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")


def keep_identified(docs: DataFrame, model: Model, min_share: float = 1 / 3, penalty: float = 6.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``min_share`` of the mixture.

    Rows that ``identify`` calls ``und`` go, and so do mixtures of so many languages that none has that share, and
    texts of which less than that share is language at all and the rest noise: languages that were not learned,
    strings of random letters.  Repeated rows are judged alike; an empty table gives none, and so does a model without languages.  The
    decision is made where the text is read, so nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    shared, place = share(docs.sparkSession, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(place).to_pylist():
                found, enough = shared().explained(text.encode(), penalty, min_share) if _letters(text) else ([], False)
                keep.append(enough and found[0][1] >= min_share)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a document belongs to the held-out fold, by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
