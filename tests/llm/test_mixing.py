import re
from collections import defaultdict

import pytest

from flowloom.llm import mixing
from flowloom.llm.queries import QUERIES


def loop_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The reshare rule as a loop: share by weight, cut at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        over, add = 0.0, left / total
        for s in sorted(open_, key=names.index):
            target[s] += add * w[s]
            if target[s] >= cap * sizes[s]:
                over += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_ = open_ - {s}
        left = over
    return target


def check(rows, docs):
    size = defaultdict(int)
    for d, text, source in docs:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = loop_targets(size)
    taken, largest = defaultdict(int), defaultdict(int)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d is None, d or 0) for d, _, _ in docs)
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_whole_table(spark, sf, documents):
    rows = QUERIES["op1_mix_sources"](spark, sf).collect()
    check(rows, [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()])
    again = QUERIES["op1_mix_sources"](spark, sf).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_partitioning_does_not_matter(documents):
    a = mixing.mix(documents.repartition(7), group_rows=16, fan_in=2).collect()
    b = mixing.mix(documents.repartition(2), group_rows=16, fan_in=2).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    check(a, [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()])


def test_edge_rows(docs_of):
    rows = [(1, None, None, "b"), (2, "", None, "b"), (3, "one two  three", None, None), (3, "one two  three", None, None), (None, "w " * 50, None, "\U0001f600"), (5, "x " * 9000, None, "￿"), (6, "a b", None, "b"), (7, None, None, "empty")]
    out = mixing.mix(docs_of(rows), group_rows=2, fan_in=2).collect()
    check(out, [(r[0], r[1], r[3]) for r in rows])


def test_empty_table(docs_of):
    assert mixing.mix(docs_of([])).collect() == []


def test_shares_keep_their_expectation(docs_of):
    docs = docs_of([(i, "w " * (i % 7 + 1), None, f"s{i % 2}") for i in range(60)])
    ratio = mixing.mix(docs).selectExpr("doc_id", "target / source_size AS r").collect()
    total = defaultdict(float)
    for seed in range(12):
        for r in mixing.mix(docs, seed=str(seed)).collect():
            total[r["doc_id"]] += r["copies"] / 12
    assert abs(sum(total[r["doc_id"]] - r["r"] for r in ratio)) < 3
