import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from flowloom.llm import jaccard, simhash
from pyspark.sql import functions as F


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_groups(docs, similarity=0.8, width=5):
    """Smallest id reachable, by the similarity of all pairs of rows that share a shingle."""
    rows = [words_of(t) for _, t in docs]
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)} for w in rows]
    low, held = list(range(len(docs))), defaultdict(list)

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x]).items():
            if rows[i] == rows[j] or rows[i] and rows[j] and n / (len(s) + len(sets[j]) - n) >= similarity:
                a, b = sorted((root(i), root(j)))
                low[b] = a
        for x in s:
            held[x].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(docs))]


def same(rows, docs):
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter(zip([d for d, _ in docs], slow_groups(docs), strict=True))


def test_whole_table(documents):
    same(jaccard.jaccard_groups(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_a_repeated_line_is_no_link(spark, sf, docs_of):
    rng = np.random.default_rng(4)
    vocabulary, docs = [f"w{i}" for i in range(5000)], []
    for line, times, own in ((11, 20, 60), (15, 30, 150), (30, 30, 150)):
        common = " ".join(rng.choice(vocabulary, line)) + "\n"
        docs += [(len(docs) + i, common * times + " ".join(rng.choice(vocabulary, own))) for i in range(20)]
    kept = corpus_pipeline.near_duplicates(spark, docs_of(docs), sf).collect()
    assert sorted(r["doc_id"] for r in kept) == [d for d, _ in docs]
    same(jaccard.jaccard_groups(docs_of(docs)).collect(), docs)


def test_edge_rows(docs_of):
    docs = [(1, None), (2, ""), (None, " "), (5, "A b"), (6, "a  B"), (None, "q r s"), (None, "Q r s"), (7, "long " * 40000), (8, "ä B"), (8, "ä B"), (9, "long " * 5)]
    same(jaccard.jaccard_groups(docs_of(docs)).collect(), docs)
    assert jaccard.jaccard_groups(docs_of([])).collect() == []


def test_buckets_of_several_components(docs_of):
    """Texts of one long passage and two kinds of end: all meet, and only those with the same end are similar."""
    rng = np.random.default_rng(5)
    words, docs = [f"w{i}" for i in range(3000)], []
    base = rng.choice(words, 150).tolist()
    for g in range(12):
        end = rng.choice(words, 40).tolist()
        for k in range(6):
            own = list(end)
            own[6 * k] = "x"
            docs.append((100 * g + k, " ".join(base + own)))
    same(jaccard.jaccard_groups(docs_of(docs)).collect(), docs)
    assert len(set(slow_groups(docs))) > 1


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_prefix_join_loses_no_pair(spark, similarity):
    rng = np.random.default_rng(6)
    bases, sets = [rng.integers(0, 400, 60) for _ in range(4)], {}
    for row in range(160):
        base = bases[row % 4][: rng.integers(1, 60)]
        sets[row] = sorted({*base.tolist(), *rng.integers(0, 400, rng.integers(0, 12)).tolist()})
    labels = {row: row // 3 if row % 5 else 0 for row in sets}
    rows = spark.createDataFrame(list(labels.items()), "row long, label long")
    table = spark.createDataFrame(list(sets.items()), "row long, hashes array<long>")
    met = {tuple(sorted((r["a"], r["b"]))) for r in jaccard.prefix_pairs(rows, table, similarity).collect()}
    close = lambda a, b: len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= similarity
    pairs = {(a, b) for a in sets for b in sets if a < b and labels[a] != labels[b]}
    want = {p for p in pairs if close(*p)}
    assert want <= met <= pairs and want and len(met) < len(pairs)


def test_a_shared_passage_makes_no_pairs(spark):
    """A group of copies and many texts of which most is one passage: hardly a pair is left to compare."""
    own = lambda i, n: list(range(1000 * (i + 1), 1000 * (i + 1) + n))
    sets = {i: list(range(300)) + own(i, 120) for i in range(80)} | {i: list(range(300)) + own(0, 119) + [999_000 + i] for i in range(100, 160)}
    labels = {i: 100 if i >= 100 else i for i in sets}
    rows = spark.createDataFrame(list(labels.items()), "row long, label long")
    met = jaccard.prefix_pairs(rows, spark.createDataFrame(list(sets.items()), "row long, hashes array<long>"), 0.8).collect()
    assert {(r["label_a"], r["label_b"]) for r in met} <= {(0, 100), (100, 0)} and len(met) <= 60


def test_recall_by_true_similarity(docs_of):
    """Pairs of texts edited to every similarity from 0.8 up, long and short: all are found."""
    rng = np.random.default_rng(8)
    words, docs = [f"w{i}" for i in range(20000)], []
    for i in range(400):
        n = int(rng.choice([8, 20, 100, 400]))
        text = rng.choice(words, n).tolist()
        edited = text[int(rng.integers(0, max(n // 10, 1) + 1)) :] + rng.choice(words, int(rng.integers(0, max(n // 10, 1) + 1))).tolist()
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited))]
    same(jaccard.jaccard_groups(docs_of(docs)).collect(), docs)


def edited_copies(n):
    """Long texts, each with a copy of which a word in the middle is another, and one of which a third is."""
    rng = np.random.default_rng(9)
    words, docs = [f"w{i}" for i in range(20000)], []
    for i in range(n):
        text = rng.choice(words, 900).tolist()
        docs += [(3 * i, " ".join(text)), (3 * i + 1, " ".join([*text[:450], "x", *text[451:]])), (3 * i + 2, " ".join(text[:600] + rng.choice(words, 300).tolist()))]
    return docs


def test_simhash_finds_copies_without_minhash(spark, sf, docs_of, monkeypatch):
    """The stage with bands that no two texts share: what is left are the links of fingerprints, decided by the sets."""
    docs, made = edited_copies(30), jaccard.band_values
    apart = {f"b{i}": F.xxhash64("k0", "k1", F.lit(i)) for i in range(jaccard.BANDS)}
    monkeypatch.setattr(jaccard, "band_values", lambda *a: made(*a).withColumns(apart))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs_of(docs), sf).collect()}
    close = {d + 1 for d, t in docs[::3] if (simhash.fingerprint(t.encode()) ^ simhash.fingerprint(docs[d + 1][1].encode())).bit_count() <= jaccard.TAU}
    assert kept == {d for d, _ in docs} - close and len(close) >= 10


def test_links_of_fingerprints_are_decided_by_the_sets(docs_of):
    """One line repeated outweighs what else the texts have: equal fingerprints, sets that share next to nothing."""
    docs = [(i, "a b c d e f g " * 300 + f"own{i} " * 5 + " ".join(f"v{i}x{k}" for k in range(12))) for i in range(12)]
    assert len({simhash.fingerprint(t.encode()) for _, t in docs}) == 1
    unique = jaccard.band_values(docs_of(docs)).withColumn("row", F.col("doc_id"))
    assert {(r["a"], r["b"]) for r in jaccard.simhash_pairs(unique, 0.8).collect()} == {(0, i) for i in range(1, 12)}
    same(jaccard.jaccard_groups(docs_of(docs)).collect(), docs)
    assert len(set(slow_groups(docs))) == 12
