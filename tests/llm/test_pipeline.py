import corpus_pipeline
from flowloom.llm import decontaminate as dc
from flowloom.llm import jaccard, simhash

from .test_jaccard import slow_groups
from .test_mixing import check as check_mix


def test_each_stage_against_brute_force(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix"]
    stages, docs = dict(corpus_pipeline.STAGES), documents
    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == documents.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))} == ids

    docs = kept
    rows = docs.collect()
    low = set(slow_groups([(r["doc_id"], r["text"]) for r in rows]))
    docs = stages["near_duplicates"](spark, docs, sf)
    assert docs.columns == documents.columns
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(low) and len(low) < len(rows)

    rows = docs.collect()
    items = [" ".join(dc.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = stages["decontamination"](spark, docs, sf)
    assert docs.columns == documents.columns
    leaked = {r["doc_id"] for r in rows if any(t in " ".join(dc.words_of(r["text"])) for t in items)}
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in rows} - leaked and leaked

    rows = docs.collect()
    out = stages["source_mix"](spark, docs, sf).collect()
    check_mix(out, [(r["doc_id"], r["text"], r["source"]) for r in rows])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, out))


def test_stages_on_edge_rows(spark, sf, docs_of):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "the and of", "en", "a"), (3, "the and of", "en", "a"), (4, "the and of", None, "b"), (None, "the and of", "fr", None), (None, "la que de", "fr", None), (None, "la que de", "fr", None), (5, "long " * 30000, "en", "a")]
    for docs in (docs_of(rows), docs_of([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "source_mix":
                assert out.columns == docs.columns
            out.collect()
    kept = simhash.keep_one(docs_of(rows), jaccard.jaccard_groups(docs_of(rows))).collect()
    assert sorted(str((r["doc_id"], r["text"][:10] if r["text"] else r["text"])) for r in kept) == sorted(map(str, [(1, None), (3, "the and of"), (5, "long long "), (None, "la que de")]))


def test_repeated_ids_keep_a_row_of_each_group(docs_of):
    """One id on two texts, each of which has a copy under another id, and on a copy of a third text."""
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a B c d e f"), (3, "p q r s t u"), (0, "v w x y z"), (1, "v w x y z"), (1, "A b c d e f")]
    docs = docs_of([(d, t, None, None) for d, t in rows])
    kept = simhash.keep_one(docs, jaccard.jaccard_groups(docs)).collect()
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept) == [(0, "v w x y z"), (1, "a b c d e f"), (1, "p q r s t u")]
    assert [r["text"] for r in kept if r["text"].lower() == "a b c d e f"] == ["A b c d e f"]
