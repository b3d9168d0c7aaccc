"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte (or per end-of-word byte); the adjacent pair of the lowest rank is
popped from a heap and merged in a doubly linked list until none is left. The count is the initial symbols
less the merges; no identifier is made. Text is normalised and cut into words by the tokenizer's own rules.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words kept with their counts in each worker, twice at most; words longer than LONG are not kept.
CACHE, LONG = 150_000, 64
LIMIT = 2048


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rule by which a word-end tokenizer cuts words, and the same for texts of ASCII and of characters up to U+024F,
#: which have their composed form already, and neither NUL nor white space that only one of the two regular expressions knows.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")
_BEYOND = re.compile(r"[\x00\x1c-\x1f\u0250-\U0010ffff]")
#: Marks words that are in the byte alphabet already.
_BYTES = "\x00"


def byte_alphabet() -> dict[int, str]:
    """The printable character of each byte: itself where Latin-1 prints it, else one beyond U+0100, in order."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printed))
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}


_ALPHABET = byte_alphabet()


def in_bytes(word: str) -> str:
    if word.startswith(_BYTES):
        return word[1:]
    return word if word.isascii() and word.isalnum() else "".join(map(_ALPHABET.__getitem__, word.encode()))


class Vocabulary:
    """Ranks and rules of a byte-pair tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only byte-level BPE with or without word ends is read")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        steps = spec.get("pre_tokenizer") or {}
        #: Whether words are cut by the rules that _ASCII and _LATIN state for texts of those characters.
        self.plain = [s.get("pattern", {}).get("Regex") for s in steps.get("pretokenizers", [])] == [_RULE, None] and (spec.get("normalizer") or {}).get("normalizers", [])[-1:] == [{"type": "Lowercase"}]

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, in the byte alphabet where they are not in Latin letters."""
        if self.plain and not _BEYOND.search(text):
            return (_ASCII if text.isascii() else _LATIN).findall(text.lower())
        lib = self.library
        norm = lib.normalizer.normalize_str(text) if lib.normalizer else text
        return [_BYTES + w for w, _ in lib.pre_tokenizer.pre_tokenize_str(norm)]

    def merged(self, word: str) -> list[str]:
        """The symbols of a word after all merges."""
        word = in_bytes(word)
        symbols = [*word[:-1], word[-1] + self.end] if word else []
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, alive = self.ranks, [True] * n
        heap = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j < 0 or symbols[k] != a or symbols[j] != b:
                continue
            symbols[k], alive[j] = a + b, False
            after[k] = nxt = after[j]
            if nxt >= 0:
                before[nxt] = k
                if (r := ranks.get((symbols[k], symbols[nxt]))) is not None:
                    heapq.heappush(heap, (r, k, symbols[k], symbols[nxt]))
            if (p := before[k]) >= 0 and (r := ranks.get((symbols[p], symbols[k]))) is not None:
                heapq.heappush(heap, (r, p, symbols[p], symbols[k]))
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]


class Kept(dict):
    """value(word) of words, in two bounded generations: when the young one is full, it becomes the old one."""

    def __init__(self, value):
        super().__init__()
        self.value, self.old = value, {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.value(word)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


@cache
def counter(path: str) -> tuple[Vocabulary, Kept]:
    """A tokenizer and its words' token counts, once in each worker."""
    vocabulary = Vocabulary(path)
    return vocabulary, Kept(lambda word: len(vocabulary.merged(word)))


def count_tokens(vocabulary: Vocabulary, kept: Kept, text: str) -> int:
    """Tokens of a whole text as the library has them by default: special strings inside are one token each."""
    special = vocabulary.special
    parts = special.split(text) if special and special.search(text) else [text]
    return len(parts) - 1 + sum(sum(map(kept.__getitem__, vocabulary.words(part))) for part in parts)


def token_counts(docs: DataFrame, path: str, keep: list[str], text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The columns keep of docs with n_bytes, n_tokens and over_limit of its whole texts.

    Null and empty texts have 0 tokens; a text of any length, with or without spaces, is counted whole;
    repeated rows are counted each; clashing columns of docs are left out unless kept.
    """
    schema = docs.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_bytes long", "n_tokens long", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kept = counter(path)
        for batch in common.batches(batches):
            texts = batch.column(batch.num_columns - 1)
            n = [count_tokens(vocabulary, kept, t) for t in texts.to_pylist()]
            size = pa.array([len(t) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*keep, common.text_or_empty(text).alias(common.unused(docs, "__text")[0])).mapInArrow(run, out)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), ["doc_id"])
