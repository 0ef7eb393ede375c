"""What can be plugged in: a tagger of names, and a rewriter of masked text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.spans import SPAN, find_spans, let
from .masking import apply_spans, token_list
from .tokens import preserved_strict

# Gazetteer of the default tagger.
ORGS = r"\b(?:[A-Z][\w&]+\s+){1,8}(?:Inc|Ltd|Corp|Bank|University|Group)\b"
PLACES = ["Jakarta", "Bandung", "Surabaya", "Bangkok", "Kuala Lumpur", "Singapore", "Indonesia", "Malaysia", "Thailand"]


class NerBackend(Protocol):
    def spans(self, text: Column) -> Column: ...


class Gazetteer:
    """Places by list, organisations by their last word."""

    def spans(self, text: Column) -> Column:
        places = find_spans(text, rf"\b(?:{'|'.join(PLACES)})\b", "LOC")
        return F.concat(F.when(text.rlike("[A-Z]"), find_spans(text, ORGS, "ORG")), places)


def filtered(spans: Column, text: Column) -> Column:
    """Spans of four characters or more with a letter, not within a word."""
    edge = lambda at: ~F.substring(text, at, F.lit(1)).rlike(r"(?U)\w")
    return F.filter(spans, lambda s: (s["en"] - s["st"] >= 4) & s["val"].rlike("[A-Za-z]") & ((s["st"] == 0) | edge(s["st"])) & edge(s["en"] + 1))


def mask_names(df: DataFrame, backend: NerBackend | None = None, state_col: str = "_m") -> DataFrame:
    """One more layer on a masking state; indices count on, from 0."""
    backend = backend or Gazetteer()
    return df.withColumn(state_col, apply_spans(F.col(state_col), lambda t: filtered(backend.spans(t), t), None, "ner_"))


def spans_by_chunk(text: Column, backend: NerBackend, most: int = 510, overlap: int = 50) -> Column:
    """A tagger's spans, found window by window and told in the whole text's places; each once."""

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(most - overlap))

        def tagged(first: Column) -> Column:
            at = F.get(words, first)["st"]
            end = F.get(words, F.least(first + most, F.size(words)) - 1)["en"]
            own = let(F.substring(text, at + 1, end - at), backend.spans)
            return F.transform(own, lambda s: F.struct((s["st"] + at).cast("int").alias("st"), (s["en"] + at).cast("int").alias("en"), s["cat"].alias("cat"), s["val"].alias("val")))

        return F.when(F.size(words) > 0, F.array_distinct(F.flatten(F.transform(starts, tagged)))).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(find_spans(text, r"\S+", "WORD"), windows)


class Chunked:
    """A tagger that sees windows of words only, as models with a bounded input need."""

    def __init__(self, backend: NerBackend, most: int = 510, overlap: int = 50):
        self._backend, self._most, self._overlap = backend, most, overlap

    def spans(self, text: Column) -> Column:
        return spans_by_chunk(text, self._backend, self._most, self._overlap)


def mask_by_tenant(df: DataFrame, english: NerBackend, by_tenant: dict[str, NerBackend], tenant_col: str = "tenant", state_col: str = "_m") -> DataFrame:
    """The English tagger's layer, then that of the row's tenant on what it left; indices count on."""
    out = mask_names(df, english, state_col)
    for tenant, backend in by_tenant.items():
        own = apply_spans(F.col(state_col), lambda t, b=backend: filtered(b.spans(t), t), None, "ner_")
        out = out.withColumn(state_col, F.when(F.lower(F.trim(tenant_col)) == tenant, own).otherwise(F.col(state_col)))
    return out


def template_name(check: Column, fmt: Column) -> Column:
    """employment, reference or address check, else general; plain or markup."""
    kind = F.replace(F.lower(F.coalesce(check, F.lit(""))), F.lit("_"), F.lit("-"))
    stem = F.when(kind.isin("employment-check", "reference-check", "address-check"), F.replace(kind, F.lit("-"), F.lit("_"))).otherwise("general")
    return F.concat(stem, F.when(fmt.isin("html", "markdown"), "_markup").otherwise("_plain"))


def normal_format(fmt: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(fmt, F.lit(""))))
    return F.when(low.isin("md", "markdown"), "markdown").when(low == "html", "html").otherwise("plain")


def render_prompt(template: Column, text: Column, locale: Column) -> Column:
    """The token contract before the template if it lacks it, then the fields."""
    contract = "Keep every token such as [EMAIL_0] exactly as it is.\n\n"
    with_contract = F.when(template.contains(contract.strip()), template).otherwise(F.concat(F.lit(contract), template))
    names = F.create_map(*(F.lit(x) for kv in {"en": "English", "id": "Indonesian", "ms": "Malay"}.items() for x in kv))
    out = F.replace(with_contract, F.lit("{{LOCALE_CODE}}"), F.coalesce(locale, F.lit("id")))
    out = F.replace(out, F.lit("{{LOCALE_LANG_NAME}}"), F.coalesce(F.try_element_at(names, locale), F.lit("Indonesian")))
    out = F.replace(out, F.lit("{{token_list}}"), F.array_join(token_list(text), ", "))
    return F.replace(out, F.lit("{{text}}"), text)


Rewriter = Callable[[DataFrame, str], Column]


def identity(df: DataFrame, masked_col: str) -> Column:
    return F.col(masked_col)


def rewrite(df: DataFrame, cfg: Config | None = None, rewriter: Rewriter = identity, masked_col: str = "masked") -> DataFrame:
    """Adds message_02 and token_ok: the rewriter's text if it kept all tokens in order, else the masked text.

    Only the masked column goes to the rewriter.
    """
    out = df.withColumn("_new", rewriter(df, masked_col))
    ok = F.coalesce(preserved_strict(F.col(masked_col), F.col("_new")), F.lit(False))
    return out.withColumn("token_ok", ok).withColumn("message_02", F.when(F.col("token_ok"), F.col("_new")).otherwise(F.col(masked_col))).drop("_new")


def json_reply(text: Column) -> Column:
    """A reply's JSON object, or that within its outermost braces, else empty."""
    whole = F.from_json(F.when(text.rlike(r"^\s*\{"), text), "map<string,string>")
    inner = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), "map<string,string>")
    return F.coalesce(whole, inner, F.create_map().cast("map<string,string>"))

