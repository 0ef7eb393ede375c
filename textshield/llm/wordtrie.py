"""BPE encoding by a trie of words, and decoding.

In a BPE vocabulary in which every token encodes to itself, a prefix's encoding
is that of a shorter prefix and one last token: the token t for which the
shorter prefix's last token and t, merged as a pair, stay as they are.  So a
prefix needs to remember its last token alone.

Different words go into a trie; a depth-first walk carries the tokens that
could end here (all suffixes of the path that are tokens) and settles the last
token of each node once, however many words share the prefix.  The end-of-word
mark belongs to a word's last symbol, so that symbol is settled on its own
branch.  A word's ids are read back along the last tokens.

The rules for normalising and cutting texts are those of the tokenizer's file:
NFC, white space to one space, lower case letter by letter, a word pattern.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokenise import _SPACE, BEYOND_LATIN, LATIN_END, byte_symbols, char_class, newer_unicode

#: Distinct words (twice) and pairs that a worker remembers at most.
CACHE_WORDS, CACHE_PAIRS = 120_000, 600_000


class TrieTokenizer:
    """Encodes and decodes as the tokenizers library does with this file."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [c["type"] for c in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or spec["decoder"] is not None or not model["end_of_word_suffix"]:
            raise ValueError("a tokenizer file of another shape")
        self._end = model["end_of_word_suffix"]
        self._ids: dict[str, int] = model["vocab"]
        self._names = {i: t for t, i in self._ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        whole = Tokenizer.from_str(tokenizer_json)
        cut = spec["pre_tokenizer"]["pretokenizers"][0]
        self._normal, self._cut = whole.normalizer, Split(Regex(cut["pattern"]["Regex"]), "removed", invert=True)
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")
        # Fixed value: the file's word pattern, with its classes spelled out and
        # letters first, which is faster and as no other branch begins with one
        # the same.  It passes over white space, which so needs no replacing.
        self._latin_re, self._word_re = (re.compile(f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{letter}{number}]+") for end in (LATIN_END, sys.maxunicode + 1) for letter, number in [(char_class("L", end), char_class("N", end))])
        self._rank = {(a, b): r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self._symbols = byte_symbols()
        # tokens by their symbols, the end mark being part of the last one
        self._tokens = {t for t in self._ids if self._stands(t)}
        self._longest = max(len(self._split(t)) for t in self._tokens)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str | int, tuple[int, ...]] = {}
        self._ids_text: dict[str | int, str] = {}
        self._names_text: dict[str | int, str] = {}
        self._old: tuple[dict, dict, dict] = ({}, {}, {})

    def _split(self, token: str) -> list[str]:
        if token.endswith(self._end) and len(token) > len(self._end):
            body = token[: -len(self._end)]
            return [*body[:-1], body[-1] + self._end]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Merge pairs, least rank first and leftmost among equals, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self._rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 60:
                break
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _stands(self, token: str) -> bool:
        """Whether merging the token's symbols gives the token."""
        return len(symbols := self._split(token)) == 1 or self._merge(symbols) == [token]

    def _holds(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side stay two."""
        got = self._pairs.get((left, right))
        if got is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            got = self._pairs[left, right] = self._merge(self._split(left) + self._split(right)) == [left, right]
        return got

    def _last(self, path: list[str], lasts: list[str | None], final: str) -> str | None:
        """The last token of ``path`` and ``final``; lasts[n]: that of the first n symbols."""
        tail, tokens, n = final, self._tokens, len(path)
        for back in range(min(n, self._longest - 1) + 1):
            if back:
                tail = path[n - back] + tail
            if tail in tokens:
                before = n - back
                if not before or self._holds(lasts[before], tail):
                    return tail
        return None

    def encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Insert the words into a trie and walk it depth first."""
        root: dict = {}
        for word in words:
            node = root
            for b in word.encode("utf-8", "replace"):
                node = node.setdefault(b, {})
            node[-1] = word
        found: dict[str, tuple[int, ...]] = {}
        path: list[str] = []
        lasts: list[str | None] = [None]
        stack = [(iter(root.items()), root)]
        symbols, ids, end = self._symbols, self._ids, self._end
        while stack:
            step = next(stack[-1][0], None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                    lasts.pop()
                continue
            b, node = step
            if b == -1:
                continue
            symbol = symbols[b]
            if -1 in node:
                at, token, out = len(path), self._last(path, lasts, symbol + end), []
                size = 1 if token is None else len(token) - len(end)
                while token is not None:
                    out.append(ids[token])
                    at = at + 1 - size if len(out) == 1 else at - size
                    token = lasts[at]
                    size = len(token) if token else 0
                found[node[-1]] = tuple(reversed(out))
            if len(node) > (-1 in node):
                lasts.append(self._last(path, lasts, symbol))
                path.append(symbol)
                stack.append((iter(node.items()), node))
        return found

    def words(self, text: str) -> list[str | int]:
        """The words of a text, normalised; special tokens as their ids."""
        out: list[str | int] = []
        for i, part in enumerate(self._special_re.split(text) if self._special_re.search(text) else [text]):
            if i % 2:
                out.append(self._special[part])
                continue
            beyond = BEYOND_LATIN.search(part)
            if beyond and newer_unicode(part):
                out += [w for w, _ in self._cut.pre_tokenize_str(self._normal.normalize_str(part))]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # capital sigma by hand: lower() would look at its neighbours
            part = part.replace("Σ", "σ").lower()
            out += (self._word_re if BEYOND_LATIN.search(part) else self._latin_re).findall(part)
        return out

    def _learn(self, cut: list[list[str | int]]) -> None:
        """Encode the words that aren't remembered yet."""
        known, ids_text, names_text = self._words, self._ids_text, self._names_text
        new = {w for words in cut for w in words if w not in known}
        if len(known) + len(new) > CACHE_WORDS:
            # two generations: words in use come back from the old one
            self._old = (known, ids_text, names_text)
            self._words, self._ids_text, self._names_text = known, ids_text, names_text = {}, {}, {}
            new = {w for words in cut for w in words}
        for w in [w for w in new if w in self._old[0]]:
            known[w], ids_text[w], names_text[w] = (o[w] for o in self._old)
        new = [w for w in new if w not in known]
        known.update(self.encode_words({w for w in new if isinstance(w, str)}))
        known.update((w, (w,)) for w in new if isinstance(w, int))
        names = self._names
        for w in new:
            ids = known[w]
            ids_text[w] = " ".join(map(str, ids))
            names_text[w] = " ".join([names[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self.words(t) for t in texts]
        self._learn(cut)
        known = self._words
        return [[i for w in words for i in known[w]] for words in cut]

    def written_batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """Each text's ids in decimal and its decoded text, from its words' own."""
        cut = [self.words(t) for t in texts]
        self._learn(cut)
        ids, names = self._ids_text.__getitem__, self._names_text.__getitem__
        return [(" ".join(map(ids, words)), " ".join(map(names, words))) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by spaces: the file has no decoder."""
        names = self._names
        return " ".join([names[i] for i in ids])


@functools.lru_cache(2)
def trie_tokenizer(tokenizer_json: str) -> TrieTokenizer:
    """One for each worker process."""
    return TrieTokenizer(tokenizer_json)


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, decoded) of every row.

    A null text counts as empty and gives no ids; repeated rows come back as
    often as they occur; an empty table gives no rows; other columns are
    ignored.
    """

    def columns(tok: TrieTokenizer, texts: list[str]) -> list[pa.Array]:
        ids = tok.encode_batch(texts)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([tok.decode(x) for x in ids], pa.string())]

    return _coded(docs, tokenizer_json, id_col, text_col, "ids array<int>, decoded string", columns)


def encode_digests(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` gives."""

    def columns(tok: TrieTokenizer, texts: list[str]) -> list[pa.Array]:
        both = tok.written_batch(texts)
        sha = hashlib.sha256
        return [
            pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in both], pa.int64()),
            pa.array([sha(ids.encode()).hexdigest() for ids, _ in both]),
            pa.array([sha(text.encode()).hexdigest() for _, text in both]),
        ]

    return _coded(docs, tokenizer_json, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _coded(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, fields: str, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file: a few MB, whatever the table
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col))
    schema = f"id {source.schema['id'].dataType.simpleString()}, {fields}"
    names = ["id", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = trie_tokenizer(shared.value)
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(tok, part.column(1).to_pylist())], names=names)

    return source.mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer_json: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of an ids column; null ids give null."""
    shared = coded.sparkSession.sparkContext.broadcast(tokenizer_json)

    @F.pandas_udf("string")
    def run(ids):
        tok = trie_tokenizer(shared.value)
        return ids.map(lambda x: None if x is None else tok.decode(np.asarray(x).tolist()))

    return coded.withColumn(text_col, run(F.col(ids_col)))
