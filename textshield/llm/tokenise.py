"""Token ids by the tokenizers library, with its word cuts taken once per word.

A byte-level BPE tokenizer cuts a text into words and merges within each word,
so a word's ids don't depend on its neighbours.  Texts are cut here by the same
pattern, each different word is merged by the library's model once, and a text's
ids are its words' ids joined.  A tokenizer of another shape is used as it is.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from array import array

import numpy as np

#: Distinct words that a worker remembers at most, twice.
CACHE_WORDS = 300_000

# The characters of Unicode's White_Space property.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Texts of characters below this one are cut with small classes, which is faster.
LATIN_END = 0x250
BEYOND_LATIN = re.compile(f"[^\\x00-\\u{LATIN_END - 1:04x}]")


@functools.cache
def char_class(kinds: str, end: int = sys.maxunicode + 1) -> str:
    """A class body for ``re`` with the characters below ``end`` of these general categories (initials, or Cn)."""
    runs, start = [], None
    for c in range(end + 1):
        name = unicodedata.category(chr(c)) if c < end else ""
        inside = name != "" and (name == kinds if kinds == "Cn" else name[0] in kinds)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(runs)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]+")


@functools.cache
def _unassigned(end: int) -> re.Pattern:
    return re.compile(f"[{char_class('Cn', end)}]")


def newer_unicode(text: str) -> bool:
    """Whether a text has characters that Python's Unicode version doesn't know.

    The tokenizers library may know them, so it has to cut such texts itself.
    Classes of higher planes are slow, so only characters of these meet them.
    """
    if _unassigned(1 << 16).search(text):
        return True
    astral = "".join(_ASTRAL.findall(text))
    return bool(astral and _unassigned(sys.maxunicode + 1).search(astral))


@functools.cache
def word_pattern(end: int = sys.maxunicode + 1) -> re.Pattern:
    """Fixed value: the byte-level word pattern, with its classes spelled out.

    Letters come first, which is faster; no other branch begins with one.
    """
    letter, number = char_class("L", end), char_class("N", end)
    return re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


#: Signs that make a word of their own at a word's end.
_STOPS = frozenset(".,;:!?")


class _Odd(Exception):
    """A text whose white space isn't one blank or line feed at a time."""


class Remembered(dict):
    """What ``make`` gives for each key, made when first asked for.

    Two generations: when one is full it becomes the old one, out of which
    keys that are still in use come back.
    """

    def __init__(self, make, size: int):
        super().__init__()
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value


class WordTokenizer:
    """Encodes whole texts; ids come as little-endian bytes of ``dtype``.

    Where white space is one blank or line feed at a time, what stands between
    is cut into words for itself, so its ids are remembered too; other texts
    are cut as wholes.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._whole = Tokenizer.from_str(tokenizer_json)
        self._whole.no_truncation()
        self._whole.no_padding()
        cut = spec["pre_tokenizer"] or {}
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        self._by_word = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and plain
        self._special = {t["content"]: np.array([t["id"]], self.dtype).tobytes() for t in spec["added_tokens"]}
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        if self._by_word:
            self._model = self._whole.model
            self._symbols = dict(enumerate(byte_symbols()))
            self._small, self._large = word_pattern(LATIN_END).findall, word_pattern().findall
            self._edge = re.compile(f"[{_SPACE}]|.*[{_SPACE}]$", re.DOTALL).match
            self._words = Remembered(self._word, CACHE_WORDS // 4)
            self._after_blank = Remembered(lambda chunk: self._chunk(" ", chunk), CACHE_WORDS)
            self._at_start = Remembered(lambda chunk: self._chunk("", chunk), CACHE_WORDS // 4)

    def _word(self, word: str) -> bytes:
        symbols = word.encode().decode("iso-8859-1").translate(self._symbols)
        return array(self._code, [t.id for t in self._model.tokenize(symbols)]).tobytes()

    def _chunk(self, before: str, chunk: str) -> bytes:
        if chunk.isalpha():  # one word
            return self._word(before + chunk)
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            return (self._after_blank if before else self._at_start)[chunk[:-1]] + self._words[chunk[-1]]
        if not chunk or self._edge(chunk):
            raise _Odd
        return self._part(before + chunk)

    def _part(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        beyond = not text.isascii() and BEYOND_LATIN.search(text)
        if beyond and newer_unicode(text):
            return array(self._code, self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._words.__getitem__, (self._large if beyond else self._small)(text)))

    def encode(self, text: str) -> bytes:
        if self._special_re is not None and self._special_re.search(text):
            return b"".join([self._special[p] if i % 2 else self._part(p) for i, p in enumerate(self._special_re.split(text))])
        if not text:
            return b""
        start, after = self._at_start.__getitem__, self._after_blank.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(start(first) + b"".join(map(after, rest)))
        except _Odd:
            return self._part(text)
        return lines[0] if len(lines) == 1 else self._words["\n"].join(lines)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self._by_word:
            return [np.array(e.ids, self.dtype).tobytes() for e in self._whole.encode_batch(texts, add_special_tokens=False)]
        return list(map(self.encode, texts))


@functools.lru_cache(2)
def word_tokenizer(tokenizer_json: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(tokenizer_json)
