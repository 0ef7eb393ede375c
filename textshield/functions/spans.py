"""Spans in text as arrays of structs, without Python on the executors.

A span is ``struct<st:int,en:int,cat:string,val:string>``, code points, end
exclusive.  Matches and their places are found by marking them with a character
that texts don't hold, splitting there and adding up lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
SPAN = "struct<st:int,en:int,cat:string,val:string>"
#: The one token shape: a category and a number in brackets.
TOKEN = r"\[[A-Z][A-Z_]*_\d+\]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at matches: every second piece, from index 1, is a match.

    Classes are Unicode's; marks in the text itself are dropped.
    """
    clean = F.replace(text, F.lit(MARK), F.lit(""))
    return F.split(F.regexp_replace(clean, f"(?U)({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


#: Items that a fold takes at a time.
RUN = 1024
#: Characters of the blocks that ``splice`` cuts texts into.
BLOCK = 1024


def let_sql(value: Column, name: str, body: str) -> Column:
    """``let`` with the body in SQL, where ``name`` is the value.

    Each part of an expression that Python puts together is a call into the JVM;
    SQL text is one, and these bodies occur for every pattern.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def fold_sql(items: str, state: str, step: str, emit: str) -> str:
    """SQL of the integers that ``emit`` gives along the items; nulls are left out.

    In ``step``, the state for the next item, and in ``emit`` the item is ``x``
    and the state ``a.s``.  ``items`` is a name.  Spark copies what an aggregate
    has gathered at each of its steps.  So the items are taken in runs: the
    numbers of a run are noted in a short string, and put with the rest once for
    each run; the time grows with the items, not with their square.
    """
    one = f"(a, x) -> named_struct('s', {step}, 'noted', concat(a.noted, coalesce(concat(cast({emit} AS STRING), ','), '')))"
    own = f"aggregate(slice({items}, k * {RUN} + 1, {RUN}), named_struct('s', acc.s, 'noted', ''), {one})"
    run = f"(acc, k) -> get(transform(array({own}), r -> named_struct('s', r.s, 'noted', concat(acc.noted, r.noted))), 0)"
    noted = f"aggregate(sequence(0, size({items}) DIV {RUN}), named_struct('s', {state}, 'noted', ''), {run}, acc -> acc.noted)"
    return f"transform(filter(split({noted}, ','), n -> n != ''), n -> cast(n AS INT))"


#: Starts of matches among pieces: the state is twice the place, and in the last bit whether the next piece is a match.
_STARTS = fold_sql("parts", "0", "(a.s + length(x) * 2) ^ 1", "CASE WHEN a.s & 1 = 1 THEN shiftright(a.s, 1) END")


def find_spans(text: Column, pattern: str, cat: str) -> Column:
    """All matches of a pattern, left to right, as spans.  Null text: null."""
    span = f"(st, p) -> named_struct('st', st, 'en', st + length(p), 'cat', '{cat}', 'val', p)"
    found = let_sql(pieces(text, pattern), "parts", f"zip_with({_STARTS}, filter(parts, (p, i) -> i % 2 = 1), {span})")
    none = F.when(text.isNotNull(), F.array().cast(f"array<{SPAN}>"))
    return F.when(text.rlike(f"(?U){pattern}"), found).otherwise(none)


def overlaps(span: Column, others: Column) -> Column:
    """Whether a span shares a place with any of the others."""
    return F.exists(others, lambda o: (span["st"] < o["en"]) & (o["st"] < span["en"]))


_LISTED = "array_sort(transform(spans, (s, i) -> named_struct('st', s.st, 'neg', -s.en, 'i', i)))"
_TAKEN = fold_sql("listed", "0", "CASE WHEN x.st >= a.s THEN -x.neg ELSE a.s END", "CASE WHEN x.st >= a.s THEN x.i END")
_CHOSEN = f"get(transform(array({_LISTED}), listed -> transform({_TAKEN}, i -> get(spans, i))), 0)"

# Both kinds in order of start; old ones come first among equal starts and have -1 as their place in the list.
_BOTH = "array_sort(concat(transform(v.spans, (s, i) -> named_struct('st', s.st, 'i', i, 'en', s.en)), transform(v.old, s -> named_struct('st', s.st, 'i', -1, 'en', s.en))))"
_BEFORE = fold_sql("both", "0", "CASE WHEN x.i < 0 THEN x.en ELSE a.s END", "CASE WHEN x.i >= 0 AND x.st >= a.s THEN x.i END")
_AFTER = fold_sql("back", str(2**31 - 1), "CASE WHEN x.i < 0 THEN x.st ELSE a.s END", "CASE WHEN x.i >= 0 AND x.en <= a.s THEN x.i END")
_CLEAR = f"""CASE WHEN size(v.old) > 0 AND size(v.spans) > 0 THEN get(transform(array({_BOTH}), both ->
  transform(array_sort(array_intersect({_BEFORE}, get(transform(array(reverse(both)), back -> {_AFTER}), 0))), i -> get(v.spans, i))), 0) ELSE v.spans END"""


def greedy(spans: Column, old: Column | None = None) -> Column:
    """Spans in order of start, then the longest, then as listed, each if it starts at or after the end of the last taken.

    Those that share a place with one of ``old`` (disjoint spans) count as not
    there.  That takes two passes over both kinds: forward, no old span may
    reach beyond the start; backward, none may start before the end.
    """
    if old is not None:
        spans = let_sql(F.struct(spans.alias("spans"), old.alias("old")), "v", _CLEAR)
    return let_sql(spans, "spans", _CHOSEN)


# Between two places a and b, from a block of the text on.
_BETWEEN = f"""CASE WHEN {{b}} > {{a}} THEN substring(array_join(slice(blocks, {{a}} DIV {BLOCK} + 1, ({{b}} - 1) DIV {BLOCK} - {{a}} DIV {BLOCK} + 1), ''), {{a}} % {BLOCK} + 1, {{b}} - {{a}}) ELSE '' END"""
_END = "CASE WHEN i = 0 THEN 0 ELSE get(v.spans, i - 1).en END"
_SPLICED = f"""CASE WHEN size(v.spans) > 0 THEN get(transform(array(regexp_extract_all(v.text, '(?s)(.{{1,{BLOCK}}})', 1)), blocks -> concat(
  array_join(transform(v.spans, (s, i) -> concat({_BETWEEN.format(a=f"({_END})", b="s.st")}, get(v.new, i))), ''),
  substring(v.text, element_at(v.spans, -1).en + 1, length(v.text)))), 0) ELSE v.text END"""


def splice(text: Column, spans: Column, replacements: Column) -> Column:
    """The text with each (ordered, disjoint) span replaced by the string at its index.

    A place far into a text is found by counting from the text's start, so the
    text is cut into blocks first and places are counted from a block's start.
    """
    return let_sql(F.struct(text.alias("text"), spans.alias("spans"), replacements.alias("new")), "v", _SPLICED)


def replace_matches(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``new(match)``; the text is evaluated once."""
    changed = F.array_join(F.transform(pieces(text, pattern), lambda p, i: F.when(i % 2 == 1, new(p)).otherwise(p)), "")
    return F.when(text.rlike(f"(?U){pattern}"), changed).otherwise(text)


_CHANGED = fold_sql("v.parts", "0", "a.s + length(x.old)", "CASE WHEN x.new != x.old THEN a.s END")
CHANGE = "struct<`from`:string,`to`:string,st:int,en:int,via:string>"


def replace_logged(s: Column, pattern: str, new: Callable[[Column], Column], via: str) -> Column:
    """As ``replace_matches`` on a column struct(text, changes), logging what changed and where.

    The column is referred to twice, so a chain of these stays a chain of
    projections, each small enough to analyse.
    """

    parts = F.transform(pieces(s["text"], pattern), lambda p, i: F.struct(p.alias("old"), F.when(i % 2 == 1, F.coalesce(new(p), p)).otherwise(p).alias("new")))
    change = f"(st, x) -> named_struct('from', x.old, 'to', x.new, 'st', st, 'en', st + length(x.old), 'via', '{via}')"
    changes = f"concat(v.changes, zip_with({_CHANGED}, filter(v.parts, x -> x.new != x.old), {change}))"
    body = f"named_struct('text', array_join(transform(v.parts, x -> x.new), ''), 'changes', {changes})"
    return F.when(s["text"].rlike(f"(?U){pattern}"), let_sql(F.struct(parts.alias("parts"), s["changes"].alias("changes")), "v", body)).otherwise(s)


def logged(text: Column) -> Column:
    """The state that ``replace_logged`` starts from."""
    return F.struct(text.alias("text"), F.array().cast(f"array<{CHANGE}>").alias("changes"))
