import math
import random
import re
import textwrap

import pytest

from flowloom.llm import licenses as li
from flowloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_tokens(words):
    return set(zip(words, words[1:], strict=False)) if len(words) != 1 else {(words[0],)}


def slow_templates(templates):
    """(tokens, label, words of a block, number of the family), from the texts alone."""
    rows = [(slow_tokens(w), label, len(w)) for w, label in ((slow_words(t), x) for t, x in templates.items()) if w]
    family = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if 2 * len(a[0] & b[0]) >= min(len(a[0]), len(b[0])):
                    family[i] = family[j] = min(family[i], family[j])
    size = {f: max(2 ** math.ceil(math.log2(2 * n)) for (_, _, n), g in zip(rows, family, strict=True) if g == f) for f in family}
    return [(t, label, size[f], f) for (t, label, _), f in zip(rows, family, strict=True)]


def slow_matches(words, templates, threshold=0.8):
    """Every block against every template; of alike templates in overlapping blocks the closest."""
    found = []
    for tokens, label, size, family in templates:
        for start in range(0, max(len(words) - size // 2, 1), size // 2):
            block = words[start : start + size]
            shared = len(tokens & slow_tokens(block)) if block else 0
            if shared >= max(1, math.ceil(threshold * len(tokens) - 1e-9)):
                found.append((label, shared / len(tokens), start, start + len(block), 2 * shared - len(tokens), family))
    keep = [m for m in found if not any(o[5] == m[5] and o[2] < m[3] and m[2] < o[3] and o[4] > m[4] for o in found)]
    return sorted(m[:4] for m in keep)


def slow(text, templates):
    """Base places by comparing at every word; labels by comparing every block with every template."""
    words = slow_words(text)
    places = [(i, label) for p, label in li.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base, found = {x for _, x in places}, slow_matches(words, templates)
    at = [p for p, _ in places]
    score = 1.0 if at else max((m[1] for m in found), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m[0] for m in found})), score


def labels_of(docs_of, texts):
    got = li.scan_licenses(docs_of(list(enumerate(texts)))).collect()
    return [set(r["labels"].split(",")) - {""} for r in sorted(got, key=lambda r: r["doc_id"])]


def test_whole_table(spark, sf, documents):
    templates = slow_templates(li.TEMPLATES)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_license_scan"](spark, sf).collect()}
    assert got == {r["doc_id"]: slow(r["text"], templates) for r in documents.collect()}
    assert any(v[4] for v in got.values()) and any(v[5] and not v[4] for v in got.values())


def test_edge_rows(docs_of):
    filler = "filler words here " * 300
    texts = [None, "", "\n\n", "MIT License mit license", "mit\nlicense", "the GNU General Public-License, Version 3", "mit licenseé", "license", "public license general", f"{filler}licensed under cc by nc {filler}", f"{filler}Licensed under\nCC BY NC", "x" * 100000, "all rights reserved " * 2000]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5])]
    templates = slow_templates(li.TEMPLATES)
    got = li.scan_licenses(docs_of(rows)).drop("matches").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *slow(t, templates))) for d, t in rows)
    assert li.scan_licenses(docs_of([])).collect() == []


@pytest.mark.parametrize("label", ["mit-text", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "apache-2.0", "gpl-2.0", "gpl-3.0", "agpl-3.0", "lgpl-2.1", "mpl-2.0", "unlicense"])
def test_wrapped_texts_are_labelled(docs_of, label):
    """At several widths, behind comment marks, with every twentieth word changed, in the middle of other text."""
    rng = random.Random(label)
    for text in [max((t for t, x in li.TEMPLATES.items() if x == label), key=len)]:
        words = text.split()
        edited = " ".join("changed" if i % 20 == 7 and len(words) > 60 else w for i, w in enumerate(words))
        noise = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=n))
        texts = ["\n".join(textwrap.wrap(text, w)) for w in (30, 60, 79)]
        texts += [" * " + "\n * ".join(textwrap.wrap(text, 70)), "\n".join(textwrap.wrap(edited, 72)), f"{noise(777)} {text} {noise(1234)}"]
        assert all(found - {"gpl", "apache", "mit"} == {label} for found in labels_of(docs_of, texts))


def test_order_of_words_counts(docs_of):
    shuffled = [t.split() for t in li.TEMPLATES]
    for words in shuffled:
        random.Random(1).shuffle(words)
    texts = ["all guests reserved rooms; the rights of way", "reserved rights all", *(" ".join(w) for w in shuffled if len(w) > 5)]
    assert all(found <= {"gpl", "apache", "mit"} for found in labels_of(docs_of, texts))


def test_two_licenses_in_one_text(docs_of):
    by = {x: t for t, x in li.TEMPLATES.items()}
    both = by["mit-text"] + "\n" + by["gpl-3.0"] + "\nall rights reserved"
    assert labels_of(docs_of, [both]) == [{"mit-text", "gpl-3.0", "all-rights-reserved", "gpl"}]


def test_filters_lose_nothing_and_leave_less_to_verify():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = {" ".join(rng.choices(vocabulary, k=rng.randint(1, 15))): f"t{i}" for i in range(30)}
    family = slow_templates(templates)
    for threshold in (0.3, 0.5, 0.8, 1.0):
        tokens = {x for t in li.prepared(templates, threshold) for x in t.tokens}
        index = li.Index(templates, threshold, {x: rng.randint(0, 9) for x in tokens})
        for _ in range(100):
            words = rng.choices(vocabulary, k=rng.choice([rng.randint(0, 8), rng.randint(0, 120)]))
            got = sorted((m.template.label, m.share, m.start, m.end) for m in index.match([w.encode() for w in words]))
            assert got == slow_matches(words, family, threshold)
        c = index.counts
        assert c["prefix"] >= c["length"] >= c["positional"] >= c["verified"] > 0
        if threshold == 0.8:
            assert c["prefix"] > c["length"] > c["positional"] > c["verified"]


def test_frequency_covers_the_corpus(docs_of):
    docs = docs_of([(1, "MIT license mit license x"), (2, "the mit\nlicense"), (3, None), (4, "license mit")])
    assert li.token_frequency(docs, {"mit license": "a", "license mit x": "b"}) == {(b"mit", b"license"): 2, (b"license", b"mit"): 2}
