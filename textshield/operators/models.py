"""Taggers and rewriters that are Python models, called in batches on executors.

A model is what ``load()`` returns: for a tagger a function of a list of texts
that gives, for each, spans (start, end, category); for a rewriter one of a list
of prompts that gives texts.  It is loaded once in each Python worker and kept.
A batch that fails is tried text by text, so that one bad text costs itself
only: its result is null and its error told.  No row is lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPAN
from . import backends
from .masking import apply_spans

Model = Callable[[list[str]], list[Any]]
_KEPT: dict[str, Any] = {}


def kept(name: str, load: Callable[[], Model]) -> Model:
    """The worker's own model of that name, loaded at the first call."""
    if name not in _KEPT:
        _KEPT[name] = load()
    return _KEPT[name]


def _groups(texts: list[str], most_rows: int, most_chars: int) -> Iterator[list[int]]:
    """Indices in batches of so many texts and characters at most; a longer text is alone."""
    now, chars = [], 0
    for i, text in enumerate(texts):
        if now and (len(now) >= most_rows or chars + len(text) > most_chars):
            yield now
            now, chars = [], 0
        now.append(i)
        chars += len(text)
    if now:
        yield now


def _called(model: Model, texts: list[str]) -> list[tuple[Any, str | None]]:
    """(result, error) of each text."""
    try:
        out = model(texts)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} results for {len(texts)} texts")
        return [(x, None) for x in out]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
        return [one for t in texts for one in _called(model, [t])]


def model_column(text: Column, name: str, load: Callable[[], Model], result: str, most_rows: int = 64, most_chars: int = 100_000, cut: Callable[[str], list[tuple[int, str]]] | None = None) -> Column:
    """struct(result, error) of each text; null texts have neither.

    ``cut`` gives a text's windows (start, text); the spans found in windows are
    told in the whole text's places, each once, in order.
    """

    @F.pandas_udf(f"struct<result:{result},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = kept(name, load)
        for texts in batches:
            rows = [i for i, t in enumerate(texts) if t is not None]
            parts = [(i, at, part) for i in rows for at, part in (cut(texts.iloc[i]) if cut else [(0, texts.iloc[i])])]
            results: list[Any] = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            if cut:
                for i in rows:
                    results[i] = []
            for group in _groups([p[2] for p in parts], most_rows, most_chars):
                for (i, at, part), (out, error) in zip((parts[g] for g in group), _called(model, [parts[g][2] for g in group]), strict=True):
                    if error is not None:
                        results[i], errors[i] = None, errors[i] or error
                    elif not cut:
                        results[i] = out
                    elif results[i] is not None:
                        results[i] += [(int(a) + at, int(b) + at, str(cat), part[a:b]) for a, b, cat in out]
            if cut:
                results = [r if r is None else [dict(zip(("st", "en", "cat", "val"), s, strict=True)) for s in sorted(set(r))] for r in results]
            yield pd.DataFrame({"result": pd.Series(results, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(text)


def word_windows(text: str, most: int = 510, overlap: int = 50) -> list[tuple[int, str]]:
    """Runs of at most ``most`` words that share ``overlap`` words with the next: (start, text)."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    starts = range(0, max(len(words) - overlap, 1), most - overlap) if words else ()
    return [(words[k][0], text[words[k][0] : words[min(k + most, len(words)) - 1][1]]) for k in starts]


def tag_documents(df: DataFrame, name: str, load: Callable[[], Model], text_col: str = "text", most: int = 510, overlap: int = 50, **batches: int) -> DataFrame:
    """Adds ``spans`` and ``tag_error``: a model's spans, found window by window."""
    found = model_column(F.col(text_col), name, load, f"array<{SPAN}>", cut=lambda t: word_windows(t, most, overlap), **batches)
    return df.withColumn("_tagged", found).withColumn("spans", F.col("_tagged.result")).withColumn("tag_error", F.col("_tagged.error")).drop("_tagged")


def mask_names(df: DataFrame, name: str, load: Callable[[], Model], state_col: str = "_m", **options: int) -> DataFrame:
    """``backends.mask_names`` with a model; a row whose tagging failed keeps its text and has ``tag_error``."""
    tagged = tag_documents(df.withColumn("_text", F.col(f"{state_col}.text")), name, load, "_text", **options)
    masked = tagged.withColumn(state_col, apply_spans(F.col(state_col), lambda t: backends.filtered(F.col("spans"), t), None, "ner_"))
    return masked.drop("_text", "spans")


def rewriter(name: str, load: Callable[[], Model], prompt: Callable[[Column], Column] | None = None, **batches: int) -> backends.Rewriter:
    """A rewriter for ``backends.rewrite`` and ``proofread``; where it fails, the masked text is kept."""

    def rewrite(df: DataFrame, masked_col: str) -> Column:
        text = F.col(masked_col)
        return model_column(text if prompt is None else prompt(text), name, load, "string", **batches)["result"]

    return rewrite
