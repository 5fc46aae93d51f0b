import math
import random
from collections import Counter

import pytest

from flowloom.llm import decontaminate as dc
from flowloom.llm.queries import QUERIES


def slow_scores(items, query, k1=1.2, b=0.75):
    """BM25 of every item for a query of distinct terms, over its own score."""
    texts = {i: dc.words_of(t) for i, t in items}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(t for w in texts.values() for t in set(w))
    out = {}
    for i, words in texts.items():
        tf = Counter(words)
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / mean)) for t, f in tf.items()}
        out[i] = sum(w[t] for t in query if t in w) / sum(w.values())
    return out


def slow_leaks(items, text, threshold=0.6, overlap=0.5, gram=5):
    """All passages against all items."""
    words = dc.words_of(text)
    longest = max(len(dc.words_of(t)) for _, t in items)
    found = set()
    for at in range(0, max(len(words) - longest, 1), longest):
        passage = words[at : at + 2 * longest]
        grams = {tuple(passage[i : i + n]) for n in range(1, gram + 1) for i in range(len(passage) - n + 1)}
        for i, score in slow_scores(items, set(passage)).items():
            w = dc.words_of(dict(items)[i])
            half = (len(w) + 1) // 2
            whole, *parts = dc.ngrams(w, gram), dc.ngrams(w[:half], gram), dc.ngrams(w[max(0, half - gram + 1) :], gram)
            both = all(not p or len(p & grams) / len(p) >= overlap - 1e-9 for p in parts)
            if score >= threshold - 1e-9 and (both or len(whole & grams) / len(whole) >= threshold - 1e-9):
                found.add(i)
    return found


@pytest.mark.parametrize("block", [1, 2, 16])
@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.6, 0.95])
def test_wand_finds_what_a_full_scan_finds(block, threshold):
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for i in range(150)]
    index = dc.Index([(i, t, None) for i, t in items], block=block)
    for _ in range(60):
        query = set(rng.choices(vocabulary, weights, k=rng.randint(1, 40)))
        got = {index.ids[i]: s for i, s in index.search(sorted(index.number[t] for t in query if t in index.number), threshold)}
        want = {i: s for i, s in slow_scores(items, query).items() if s >= threshold - 1e-9}
        assert got == pytest.approx(want)


def test_whole_table(spark, sf, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op6_benchmark_leaks"](spark, sf).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(pairs) == len(got) > 0
    plain = {i: " ".join(dc.words_of(t)) for i, t in items}
    docs = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for d, text in docs.items():
        flat = " ".join(dc.words_of(text))
        assert {i for i, t in plain.items() if t in flat} <= {i for e, i in pairs if e == d}
    for d in [*sorted(docs)[::40], *{d for d, _ in pairs}]:
        if len(docs[d]) < 20000:
            assert slow_leaks(items, docs[d]) == {i for e, i in pairs if e == d}


def test_edge_rows(spark, docs_of):
    items = "item_id long, text string, score double"
    bench = [(1, "What is the tallest tree in the wide forest? It is the old oak.", 0.0), (2, None, 0.0), (3, " ", 0.0), (4, "Short one", 0.0), (4, "Short one", 0.0)]
    benchmark = spark.createDataFrame(bench, items)
    leak = "so: what IS the tallest tree, in the wide forest -- it is the old oak"
    rows = [(1, None), (2, ""), (3, leak), (3, leak), (None, "x " * 50000 + leak), (5, "what is the tallest tree in the wide forest? nobody knows"), (6, "the old oak is a tree in the forest"), (7, "a Short, one!")]
    got = dc.find_leaks(docs_of(rows), benchmark).select("doc_id", "item_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, 1), (3, 1), (None, 1), (7, 4), (7, 4)]))
    again = dc.find_leaks(docs_of(rows), benchmark, index_bytes=20).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    assert dc.find_leaks(docs_of([]), benchmark).collect() == [] == dc.find_leaks(docs_of(rows), benchmark.limit(0)).collect()


def test_question_and_answer_columns(spark, docs_of):
    bench = spark.createDataFrame([(1, "which red fox jumped over the lazy brown dog yesterday", "a very small quick fox")], "item_id long, text string, answer string")
    question, both = "which red fox jumped over the lazy brown dog yesterday", "which red fox jumped over the lazy brown dog yesterday a very small quick fox"
    got = dc.find_leaks(docs_of([(1, question), (2, both)]), bench).collect()
    assert [(r["doc_id"], r["question_overlap"], r["answer_overlap"]) for r in got] == [(2, 1.0, 1.0)]


def test_a_changed_word_does_not_hide_a_leak(spark, docs_of):
    words = [f"word{i}" for i in range(36)]
    bench = spark.createDataFrame([(1, " ".join(words))] + [(i, f"other{i} item{i} text{i}") for i in range(2, 30)], "item_id long, text string")
    edited = [w if i not in (8, 27) else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(edited)), (2, " ".join(words[:18])), (3, " ".join(words[18:])), (4, " ".join(words[::-1]))]
    assert [r["doc_id"] for r in dc.find_leaks(docs_of(rows), bench).collect()] == [1]


def test_blocks_of_items_change_nothing(spark, docs_of):
    """500 items in one index and in many, in one pass and in several: the same pairs with the same scores."""
    rng = random.Random(4)
    vocabulary, weights = [f"w{i}" for i in range(800)], [1 / (i + 1) for i in range(800)]
    bench = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(5, 60)))) for i in range(500)]
    items = spark.createDataFrame(bench, "item_id int, text string")
    docs = docs_of([(i, " ".join(rng.choices(vocabulary, weights, k=200)) + " " + bench[i][1] + " w1 w2") for i in range(150)])
    found = lambda **kw: sorted(map(tuple, dc.find_leaks(docs, items, 0.5, 0.3, **kw).collect()))
    one = found()
    assert {i for i in range(150)} <= {r[0] for r in one}
    for size in (2000, 8000):
        other = found(index_bytes=size)
        assert [r[:2] for r in other] == [r[:2] for r in one] and [r[2:] for r in other] == [pytest.approx(r[2:]) for r in one]
    assert sorted(r["doc_id"] for r in dc.drop_leaked(docs, items, 0.9, 0.9, index_bytes=2000).collect()) == sorted(r["doc_id"] for r in dc.drop_leaked(docs, items, 0.9, 0.9).collect())


def test_an_excerpt_of_an_item_without_answer_counts(spark, docs_of):
    words = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))] + [(i, f"other{i} item{i} text{i}") for i in range(2, 30)], "item_id short, text string")
    got = dc.find_leaks(docs_of([(1, " ".join(words[:28])), (2, " ".join(words[12:])), (3, " ".join(words[:20]))]), bench)
    assert got.schema["item_id"].dataType.simpleString() == "smallint"
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 1), (2, 1)]
