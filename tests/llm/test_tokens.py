import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm import tokens
from flowloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(PATH)


def n(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_odd_texts(library, counter):
    for text in ["", " ", "don't I'LL we've 's ''s", "<|endoftext|>x<|startoftext|>", "<|endoftext", "²½ª123", "\x1c\x85\xa0\x00", "A\u0301 e\u0301", "ΑΣ Σς", "İI", "漢字かな", "🙂🙂!!", "ß ẞ ŉ Ǆ ǅ", "ɏɐ", "a" * 5000, "Ab1-2_c%%%", "\ufeffx"]:
        assert counter.count(text) == n(library, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), st.sampled_from("'sStTlLvVrReEmMdD 0<|>endoftx")), max_size=40))
def test_random_texts(library, counter, text):
    assert counter.count(text) == n(library, text)


def test_single_tokens_are_proven(library, counter):
    assert len(counter.single) > 30000
    for word in sorted(counter.single)[::97]:
        if counter.pattern.fullmatch(word):
            assert n(library, word) == 1


def test_memory_of_known_counts_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KNOWN", 3)
    small = tokens.Counter(PATH)
    text = " ".join(f"qzx{i}wv" for i in range(50))
    assert small.count(text) == n(library, text) and len(small.known) <= 3


def test_whole_table(spark, sf, documents, library):
    want = {r["doc_id"]: (len((r["text"] or "").encode()), n(library, r["text"] or "")) for r in documents.collect()}
    got = QUERIES["op5_token_counts"](spark, sf).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_edge_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "two words"), (3, "x"), (3, "x")]
    got = tokens.count_tokens(docs_of(rows), PATH, limit=1).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, 0, False), (2, 0, 0, False), (None, 9, 2, True), (3, 1, 1, False), (3, 1, 1, False)]))
    assert tokens.count_tokens(docs_of([]), PATH).collect() == []


TEXTS = [
    "It\u2019s \u201cquoted\u201d \u2013 and \u2014 dashed\u2026 I\u2019LL don't",
    "Съешь же ещё этих мягких французских булок", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία ΣΑΣ", "天地玄黃 宇宙洪荒。1２３",
    "🙂🙂 👩‍👩‍👧 ok", "e\u0301 A\u030a o\u0308\u0323 ﬁ ﷺ", "\u0130stanbul ǅ ŉ ſ", "a\u200bb\u00a0c\u3000d\u2028e", "<|endoftext|>\u2019<|startoftext|>x",
]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_beyond_latin(library, counter, text):
    for t in (text, f"plain words before {text}", text * 50, text.upper()):
        assert counter.count(t) == n(library, t), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'sSt <|>endoftx\u2019\u201c\u2013")), max_size=30))
def test_random_texts_of_all_characters(library, counter, text):
    assert counter.count(text) == n(library, text)


def test_the_shortcut_takes_most_pretokens_of_every_text():
    """One curly quote or dash in a text leaves the method as it is: the same pre-tokens are merged as without."""
    counter = tokens.Counter(PATH)
    words = "the people of the city have seen that there is more to this than it was said before "
    counter.count(words * 20)
    plain = (counter.seen, counter.merged)
    counter.seen = counter.merged = 0
    counter.count(words * 20 + "\u2013")
    assert counter.seen == plain[0] + 1 and counter.merged <= plain[1] + 1 and plain[1] == 0


def test_proof_is_made_once(monkeypatch, counter):
    monkeypatch.setattr(tokens.Counter, "_proven", lambda *_: pytest.fail("proven again"))
    assert tokens.Counter(PATH, counter.single).count("two words") == 2
