import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash
from flowloom.llm.queries import QUERIES


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, tau=3):
    """Smallest id reachable, over all pairs."""
    arr, low, todo = np.array(fps, np.uint64), {}, set(range(len(fps)))
    while todo:
        front = [todo.pop()]
        group = set(front)
        while front:
            i = front.pop()
            near = set(np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= tau).tolist()) - group
            group |= near
            front += near
        todo -= group
        least = min((ids[i] for i in group if ids[i] is not None), default=None)
        low |= dict.fromkeys(group, least)
    return [low[i] for i in range(len(fps))]


def same(rows, docs):
    fps = [slow_fingerprint(t) for _, t in docs]
    want = Counter(zip([d for d, _ in docs], [f"{f:016x}" for f in fps], slow_components([d for d, _ in docs], fps), strict=True))
    assert Counter(map(tuple, rows)) == want


def test_whole_table(spark, sf, documents):
    rows = QUERIES["op2_simhash_neardup"](spark, sf).collect()
    same(rows, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_edge_rows(docs_of):
    rows = [(4, None), (9, ""), (2, " \t\n"), (5, "A b"), (6, "a B"), (7, "Ä b C D"), (8, "ä b c d"), (None, "a b"), (5, "A b"), (11, "w x y\x1fz " * 9000)]
    out = simhash.simhash_groups(docs_of(rows)).select("doc_id", simhash.hex_fingerprint(), "component_id").collect()
    same(out, rows)
    assert simhash.simhash_groups(docs_of([])).collect() == []
    assert [r["component_id"] for r in simhash.simhash_groups(docs_of([(None, "q w e")])).collect()] == [None]


def test_a_key_of_most_rows_joins_by_broadcast(docs_of):
    docs = [(i, "same words here") for i in range(3000)] + [(5000 + i, f"other words {i} here and there") for i in range(50)]
    same(simhash.simhash_groups(docs_of(docs)).select("doc_id", simhash.hex_fingerprint(), "component_id").collect(), docs)


@pytest.mark.parametrize("cap", [4, 64, 8192])
@pytest.mark.parametrize("tau", [1, 3, 5])
def test_dense_clusters_keep_every_link(spark, cap, tau):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 9), replace=False)) for c in centres for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(np.int64(r["a"]).view(np.uint64), np.int64(r["b"]).view(np.uint64)) for r in simhash.near_links(df, tau, cap).collect()]
    assert all(int(a ^ b).bit_count() <= tau for a, b in links)
    low = {f: f for f in fps}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        x, y = sorted((root(int(a)), root(int(b))))
        low[y] = x
    assert [root(f) for f in fps] == slow_components(fps, fps, tau)


def test_thresholds_follow_the_statistics():
    uniform = simhash.agreement(4, np.full((64, 64), 1.0) + np.eye(64))
    for n in (1000, 10**6, 10**9):
        parts = simhash.allocate(n, uniform, 3)
        assert sum(t + 1 for _, t in parts) == 4
        assert len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)
    assert any(t > 0 for _, t in simhash.allocate(10**9, uniform, 3))
    stuck = uniform.copy()  # bits that never differ are useless as keys
    stuck[:16, :16] = 1.0
    assert not any(set(bits) <= set(range(16)) for bits, t in simhash.allocate(10**6, stuck, 3) if t == 0)


def test_rows_passed_on_are_separated(spark, monkeypatch):
    """Far over the cap in one bucket: each division passes on at most tau + 1 rows for one, and few rounds are left."""
    rng, written, write = np.random.default_rng(3), [], simhash.materialize
    fps = np.unique(rng.integers(0, 1 << 20, 6000, dtype=np.uint64) << np.uint64(20))
    monkeypatch.setattr(simhash, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    assert simhash.near_links(df, 3, 32).count() > 0
    passed = [t.filter("path IS NOT NULL").count() for t in written]
    assert passed[0] > 0 and passed[-1] == 0 and all(b <= 4 * a for a, b in zip(passed, passed[1:], strict=False)) and len(passed) < 8
