"""Layered masking: personal data becomes numbered tokens, and back.

State: struct(text, tokens) with tokens an array of struct(layer, token, cat,
val).  Layers run in order on the text the last one left; each leaves existing
tokens alone and counts on from them.  A row stays in its task throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbering, tables
from ..functions.spans import SPAN, TOKEN, find_spans, greedy, let, pieces, replace_matches, splice

TOKENS = "array<struct<layer:string,token:string,cat:string,val:string>>"
# a domain name has at most 127 labels; an unbounded group would recurse in Java
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}"
_CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d.])"
_PHONE = r"\(?\+\d{1,3}\)?[\s.-]?(?:\(?\d{1,4}\)?[\s.-]?){1,5}\d{2,4}"
_DIGITS = r"\+?\d[\d\-\s]{4,19}\d"


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"\D", ""))


def token_spans(text: Column) -> Column:
    return find_spans(text, TOKEN, "TOKEN")


def pii_spans(text: Column) -> Column:
    """Layer 1: e-mail addresses, and card numbers whose check digit is right."""
    cards = F.filter(F.when(text.rlike("[0-9]{4}"), find_spans(text, _CARD, "CREDIT_CARD")), lambda s: F.call_function("luhn_check", F.regexp_replace(s["val"], r"\D", "")))
    return _all(F.when(text.contains("@"), find_spans(text, _EMAIL, "EMAIL")), cards)


def phone_spans(text: Column, region: Column | None = None) -> Column:
    """Layer 2, numbers with a calling code in use; brackets around it belong to it.

    Where the code's plan is known the number has to be a possible one of it.
    With ``region``, numbers as dialled there count too.
    """
    codes = F.split(F.lit(" ".join(tables.calling_codes())), " ")
    planned = F.lit("^(?:" + "|".join(numbering.planned_codes()) + ")")

    def known(s: Column) -> Column:
        def judged(d: Column) -> Column:
            listed = F.exists(F.array(*(F.left(d, F.lit(n)) for n in (1, 2, 3))), lambda c: F.array_contains(codes, c))
            plain = F.length(d).between(7, 15) & listed
            return F.when(F.regexp_like(d, planned), F.coalesce(numbering.lookup(d)["possible"], F.lit(False))).otherwise(plain)

        return let(F.regexp_replace(s["val"], r"\D", ""), judged)

    found = F.filter(F.when(text.contains("+"), find_spans(text, _PHONE, "PHONE_NUMBER")), known)
    if region is None:
        return found
    dialled = F.when(text.rlike("[0-9]"), find_spans(text, r"(?<![\d+])\d(?:[ .()-]{0,2}\d){5,13}(?!\d)", "PHONE_NUMBER"))
    own = F.filter(dialled, lambda s: F.coalesce(numbering.lookup(numbering.international(s["val"], region))["possible"], F.lit(False)))
    return _all(found, own)


def digit_spans(text: Column) -> Column:
    """Layer 2, what looks like a number to call: 7 to 13 digits with a plus, 6 to 13 without."""
    least = lambda s: F.when(s["val"].startswith("+"), 7).otherwise(6)
    return F.filter(F.when(text.rlike("[0-9]"), find_spans(text, _DIGITS, "PHONE_NUMBER")), lambda s: _digits(s["val"]).between(least(s), 13))


def pattern_spans(text: Column, extra: bool = True) -> Column:
    """Layer 3: the pattern table, cheap tests first."""
    found: list[tuple[int, Column]] = []
    by_cat: dict[str, list[tuple[int, Column]]] = {}
    for at, (pattern, cat) in enumerate([*tables.PATTERNS, *(tables.EXTRA_PATTERNS if extra else [])]):
        by_cat.setdefault(cat, []).append((at, find_spans(text, f"(?iu){pattern}", cat)))
    # a category's cheap test stands before all its patterns
    for cat, spans in by_cat.items():
        every = _all(*(s for _, s in spans))
        needed = tables.NEEDED.get(cat)
        first = min(at for at, _ in spans)
        # a date has digits, which few texts have
        wanted = text.rlike("(?U)\\d") & text.rlike(needed) if cat == "DATE" else text.rlike(needed) if needed else None
        found.append((first, every if wanted is None else F.when(wanted, every)))
    return _all(*(s for _, s in sorted(found, key=lambda x: x[0])))


def _all(*arrays: Column) -> Column:
    return F.concat(*(F.coalesce(a, F.array().cast(f"array<{SPAN}>")) for a in arrays))


def empty_state(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast(TOKENS).alias("tokens"))


def apply_spans(state: Column, spans, layer: str | None, prefix: str = "", first: int = 0) -> Column:
    """One layer: choose, number, replace.  ``spans``: a function of the text."""

    def body(s: Column) -> Column:
        def chosen(text: Column) -> Column:
            return let(token_spans(text), lambda old: greedy(F.coalesce(spans(text), F.array().cast(f"array<{SPAN}>")), old))

        def replace(took: Column) -> Column:
            # by category, then place, so that an index is the distance from the category's first
            def number(ordered: Column) -> Column:
                cats = F.transform(ordered, lambda x: x["cat"])
                known = F.transform(F.array_distinct(cats), lambda c: F.struct(c.alias("cat"), (F.size(F.filter(s["tokens"], lambda t: t["cat"] == c)) - F.array_position(cats, c).cast("int") + 1 + first).alias("base")))

                def named(bases: Column) -> Column:
                    def one(x: Column, k: Column) -> Column:
                        index = F.get(F.filter(bases, lambda b: b["cat"] == x["cat"]), F.lit(0))["base"] + k
                        name = F.lit(layer) if layer else F.concat(F.lit(prefix), x["cat"])
                        return F.struct(x["i"].alias("i"), F.struct(name.alias("layer"), F.concat(F.lit("["), x["cat"], F.lit("_"), index.cast("string"), F.lit("]")).alias("token"), x["cat"].alias("cat"), x["val"].alias("val")).alias("t"))

                    return F.transform(F.array_sort(F.transform(ordered, one)), lambda y: y["t"])

                return let(known, named)

            ordered = F.array_sort(F.transform(took, lambda x, i: F.struct(x["cat"].alias("cat"), i.alias("i"), x["val"].alias("val"))))
            new = F.when(F.size(took) > 0, let(ordered, number)).otherwise(F.array().cast(TOKENS))
            return let(new, lambda n: F.struct(splice(s["text"], took, F.transform(n, lambda t: t["token"])).alias("text"), F.concat(s["tokens"], n).alias("tokens")))

        return let(chosen(s["text"]), replace)

    return let(state, body)


def mask_layers(df: DataFrame, text: Column, extra: bool = True, state_col: str = "_m") -> DataFrame:
    """Adds the state after all layers, each a projection of its own.  Null text: null text and no tokens."""
    out = df.withColumn(state_col, empty_state(text))
    steps = [(pii_spans, None, "pii_"), (phone_spans, "phones_lib", ""), (digit_spans, "phones_lib", ""), (lambda t: pattern_spans(t, extra), None, "regex_")]
    for spans, layer, prefix in steps:
        out = out.withColumn(state_col, apply_spans(F.col(state_col), spans, layer, prefix))
    return out


def layers(tokens: Column) -> Column:
    """Layers in order of application: struct(type, map)."""
    names = F.array_distinct(F.transform(tokens, lambda t: t["layer"]))
    return F.transform(names, lambda n: F.struct(n.alias("type"), F.map_from_entries(F.transform(F.filter(tokens, lambda t: t["layer"] == n), lambda t: F.struct(t["token"], t["val"]))).alias("map")))


def flat_map(tokens: Column) -> Column:
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(t["token"], t["val"])))


def mask_documents(df: DataFrame, text_col: str = "text", extra: bool = True) -> DataFrame:
    """Adds masked, tokens, layers, layered_maps and the layers' order."""
    out = mask_layers(df, F.col(text_col), extra)
    out = out.withColumn("masked", F.col("_m.text")).withColumn("tokens", F.col("_m.tokens")).drop("_m")
    return out.withColumn("layers", layers(F.col("tokens"))).withColumn("layered_maps", flat_map(F.col("tokens"))).withColumn("order", F.transform("layers", lambda x: x["type"]))


def token_list(text: Column) -> Column:
    """Different tokens of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1))


def unmask(text: Column, mapping: Column) -> Column:
    """Each token that the map has is replaced, in one pass; others stay."""
    return F.array_join(F.transform(pieces(text, TOKEN), lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(mapping, p), p)).otherwise(p)), "")


def unmask_literal(text: Column, mapping: Column) -> Column:
    """Literal replacement, the longest token first."""
    entries = F.array_sort(F.transform(F.map_entries(mapping), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["k"], e["v"]))


def unmask_layers(text: Column, layer_array: Column) -> Column:
    """``unmask_literal`` for each layer, the last one first."""
    return F.aggregate(F.reverse(layer_array), text, lambda acc, layer: unmask_literal(acc, layer["map"]))


def flatten_maps(maps: Column) -> Column:
    """Union of an array of maps; the last one wins.  Null: an empty map."""
    entries = F.flatten(F.transform(F.coalesce(maps, F.array().cast("array<map<string,string>>")), lambda m: F.map_entries(m)))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])))


def mask_legacy(text: Column, kind: str, start: int = 1) -> Column:
    """The older {{EMAIL_n}} and {{PHONE_n}} masks, counted from ``start``: struct(text, map, next)."""
    spans = find_spans(text, _EMAIL if kind == "EMAIL" else _PHONE, kind)
    return let(spans, lambda s: let(F.transform(s, lambda x, i: F.concat(F.lit("{{" + kind + "_"), (i + start).cast("string"), F.lit("}}"))), lambda n: F.struct(splice(text, s, n).alias("text"), F.map_from_arrays(n, F.transform(s, lambda x: x["val"])).alias("map"), (F.size(s) + start).alias("next"))))


def normalise_phones(text: Column, region: Column, e164: bool = True) -> Column:
    """Numbers with a calling code, and those of the region that begin with 0, in one form.

    E.164 is a plus and digits; the national form has 0 for the region's own
    code and leaves numbers of other regions as E.164.  What is no possible
    number stays.
    """
    code = F.try_element_at(F.create_map(*(F.lit(x) for kv in tables.REGION_CODE.items() for x in kv)), region)
    codes = F.split(F.lit(" ".join(tables.calling_codes())), " ")

    def one(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\D", "")
        full = F.when(p.contains("+"), digits).when(digits.startswith("0") & code.isNotNull(), F.concat(code, F.substring(digits, F.lit(2), F.length(digits))))
        known = F.exists(F.array(*(F.left(full, F.lit(n)) for n in (1, 2, 3))), lambda c: F.array_contains(codes, c))
        own = F.concat(F.lit("0"), F.substring(full, F.length(code) + 1, F.length(full)))
        shown = F.concat(F.lit("+"), full) if e164 else F.when(full.startswith(code), own).otherwise(F.concat(F.lit("+"), full))
        return F.when(F.length(full).between(7, 15) & known, shown).otherwise(p)

    return replace_matches(text, rf"{_PHONE}|(?<![\d+])0\d(?:[ .-]?\d){{6,12}}(?!\d)", one)


def region_of(locale: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in tables.REGION.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(locale))), F.lit("ID"))
