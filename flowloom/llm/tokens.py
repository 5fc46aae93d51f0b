"""Token counts of whole texts, with a shortcut for pre-tokens that are one token.

The counts are those of the ``tokenizers`` library for a BPE file whose pre-tokenizer splits texts into words, runs
of other symbols and single digits.  Before any text is read, every vocabulary string is encoded alone, once and on
the driver: those that come out as exactly themselves are proven to be one token wherever they are a whole pre-token.
In texts, pre-tokens among them count 1 by lookup, and only the others go through the merges, once per distinct
pre-token and worker as long as the bounded memory of known counts has room.

Texts below U+0180, where normalisation, lower case and letter classes are fixed and known, are split by a pattern of
our own; all others by the library's normaliser and pre-tokenizer.  Either way the shortcut decides what is merged.
Special strings inside texts count as one token each, as the library's default has it.
"""

from __future__ import annotations

import json
import re
import sys
import types
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.columns import map_batches, share

#: Characters of the own splitting; distinct pre-tokens whose count a worker remembers.
PLAIN, MOST_KNOWN = 0x180, 1 << 18
_BEYOND = re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]|\u0130")


def _class(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


def _pattern() -> re.Pattern:
    """The file's split pattern, with its classes written out for the characters below PLAIN."""
    letters, numbers, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


#: The library pattern that _pattern() stands for; another file would need another splitting.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Counter:
    """Counts tokens of one vocabulary file; ``proven`` are the strings that another counter has proven."""

    def __init__(self, path: str, proven: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        if model["type"] != "BPE" or not steps or steps[0].get("pattern", {}).get("Regex") != SPLIT:
            raise ValueError(f"{path}: another kind of tokenizer")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pattern, self.letters = _pattern(), byte_letters()
        self.bytes = {x: i for i, x in enumerate(self.letters)}
        self.table = str.maketrans({i: x for i, x in enumerate(self.letters)})
        self.single = proven if proven is not None else self._proven(model["vocab"])
        self.known: dict[str, int] = {}
        #: Pre-tokens so far, and those of them that are no single token.
        self.seen = self.merged = 0

    def _merged(self, word: str) -> int:
        return len(self.library.model.tokenize(word.encode().decode("latin-1").translate(self.table)))

    def _pretokens(self, text: str) -> list[str]:
        """Pre-tokens of any text, by the library; it writes each byte as a printable character."""
        byte = self.bytes
        norm = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(byte[c] for c in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def _proven(self, vocab: dict[str, int]) -> frozenset[str]:
        """Vocabulary strings that, alone as a pre-token, are encoded as their own single token."""
        byte, found = self.bytes, []
        for piece, number in vocab.items():
            if self.end and not piece.endswith(self.end):
                continue
            try:
                word = bytes(byte[c] for c in piece.removesuffix(self.end)).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and [t.id for t in self.library.model.tokenize(piece.removesuffix(self.end))] == [number]:
                found.append(word)
        return frozenset(found)

    def _count(self, text: str) -> int:
        words = self._pretokens(text) if _BEYOND.search(text) else self.pattern.findall(text.lower())
        single, known = self.single, self.known
        rest = [w for w in words if w not in single]
        self.seen, self.merged = self.seen + len(words), self.merged + len(rest)
        total = len(words) - len(rest)
        for w in rest:
            n = known.get(w)
            if n is None:
                if len(known) >= MOST_KNOWN:
                    known.clear()
                n = known[w] = self._merged(w)
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text, without added begin and end."""
        if self.special.search(text):
            return sum(map(self._count, self.special.split(text))) + len(self.special.findall(text))
        return self._count(text)


def _shared(path: str, make: Callable[[str], Counter]) -> Counter:
    """One counter per file and worker process, kept across tasks."""
    home = sys.modules.setdefault("_flowloom_counters", types.ModuleType("_flowloom_counters"))
    if path not in home.__dict__:
        home.__dict__[path] = make(path)
    return home.__dict__[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row.

    ``vocabulary`` is the path of the tokenizer file, readable at the same place on every executor.  ``docs`` needs
    ``doc_id`` and ``text``; other columns are ignored.  Null text counts as empty: 0 bytes, 0 tokens.  Repeated
    rows and null ids are counted like others; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    proven = share(docs.sparkSession, Counter(vocabulary).single)  # strings of the vocabulary at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _shared(vocabulary, lambda path: Counter(path, proven()))
        texts = batch.column(1)
        n = np.array([counter.count(t or "") for t in texts.to_pylist()], np.int64)
        n_bytes = [len(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
