"""What a session can call by name in SQL once ``register(spark)`` has run.

Scalar functions are SQL functions: Catalyst puts their bodies into the query,
so they cost what the same expressions cost in the DataFrame API.  Two table
functions run in Python over Arrow: ``pii_spans(text, categories)`` gives the
spans of the pattern table in one text, ``disjoint_spans(TABLE(...), key)`` the
greedy choice among spans that are rows already.

    SELECT d.doc_id, s.* FROM documents d, LATERAL pii_spans(d.text, 'EMAIL,NIK') s
    SELECT * FROM disjoint_spans(TABLE(SELECT doc_id, st, en FROM found), 'doc_id')
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from . import tables
from .spans import MARK, TOKEN

SPAN_TYPE = T.StructType([T.StructField("st", T.IntegerType()), T.StructField("en", T.IntegerType()), T.StructField("cat", T.StringType()), T.StructField("val", T.StringType())])


def _constant(arg: AnalyzeArgument | None, name: str, default: Any = None) -> Any:
    """The value of an argument that has to be known before the query runs."""
    if arg is None:
        return default
    if arg.isTable or not arg.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return arg.value


@dataclass
class Patterns(AnalyzeResult):
    """What ``analyze`` found: the chosen patterns (source, category), in order."""

    chosen: list[tuple[str, str]] = field(default_factory=list)


class PiiSpans:
    """Spans of one text: candidates of every chosen pattern, then the greedy choice.

    Rows are (st, en, cat, val) by start; code points, end exclusive.  Of
    candidates that overlap the first stays, then the longest, then the one
    whose pattern is listed first.  Null and empty texts give no rows.
    ``categories``: a constant, comma-separated; null means all.
    """

    def __init__(self, analysed: Patterns):
        import regex

        self.rules = [(regex.compile(f"(?iu){pattern}"), cat) for pattern, cat in analysed.chosen]
        self.needed = {cat: regex.compile(pattern.replace("(?iuU)", "(?iu)")) for cat, pattern in tables.NEEDED.items()}

    @staticmethod
    def analyze(text: AnalyzeArgument, categories: AnalyzeArgument | None = None) -> Patterns:
        if text.isTable or not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("pii_spans wants a string")
        every = [*tables.PATTERNS, *tables.EXTRA_PATTERNS]
        asked = _constant(categories, "categories")
        wanted = None if asked is None else {x.strip().upper() for x in asked.split(",") if x.strip()}
        unknown = (wanted or set()) - {cat for _, cat in every}
        if unknown:
            raise ValueError(f"no such categories: {', '.join(sorted(unknown))}")
        return Patterns(SPAN_TYPE, chosen=[r for r in every if wanted is None or r[1] in wanted])

    def eval(self, text: str | None, categories: str | None = None) -> Iterator[tuple]:
        text = (text or "").replace(MARK, "")
        possible = {cat: bool(pattern.search(text)) for cat, pattern in self.needed.items()}
        found = []
        for at, (pattern, cat) in enumerate(self.rules):
            if possible.get(cat, True):
                found += [(m.start(), -m.end(), at, cat) for m in pattern.finditer(text)]
        end = 0
        for st, minus_en, _, cat in sorted(found):
            if st >= end:
                end = -minus_en
                yield st, end, cat, text[st:end]


@dataclass
class Keyed(AnalyzeResult):
    """Where start and end stand in a row."""

    at: tuple[int, int] = (0, 0)


class DisjointSpans:
    """The greedy choice among spans that are rows: by start, then the longest.

    A table argument with integer columns ``st`` and ``en``, and the name of the
    column that says which text they are of; its other columns come through.
    Rows arrive partitioned by that column and in order, and one number is all
    that is kept of a text, so it may have any number of spans.  Rows with a
    null start or end are left out; those with a null key are one text's.
    """

    def __init__(self, analysed: Keyed):
        self.at = analysed.at
        self.end: int | None = None

    @staticmethod
    def analyze(spans: AnalyzeArgument, key: AnalyzeArgument) -> Keyed:
        name = _constant(key, "key")
        if not spans.isTable:
            raise ValueError("disjoint_spans wants a table")
        names = spans.dataType.fieldNames()
        missing = [x for x in ("st", "en", name) if x not in names]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        others = [n for n in names if n not in ("st", "en", name)]
        # ties go by the other columns, as far as they can be ordered
        ordered = [n for n in others if not isinstance(spans.dataType[n].dataType, (T.MapType, T.VariantType))]
        return Keyed(
            spans.dataType,
            partitionBy=[PartitioningColumn(name)],
            orderBy=[OrderingColumn("st"), OrderingColumn("en", ascending=False), *map(OrderingColumn, ordered)],
            select=[SelectedColumn(n) for n in names],
            at=(names.index("st"), names.index("en")),
        )

    def eval(self, row: Row, key: str) -> Iterator[tuple]:
        st, en = row[self.at[0]], row[self.at[1]]
        if st is not None and en is not None and (self.end is None or st >= self.end):
            self.end = en
            yield tuple(row)


def _quoted(pattern: str) -> str:
    """A pattern as SQL text."""
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scalar_functions() -> dict[str, str]:
    """SQL of each scalar function, by name: parameters, type and body."""
    from ..operators import guards

    months = ", ".join(f"'{m}'" for m in tables.MONTHS_ID)
    token = _quoted(f"({TOKEN})")
    codes = ", ".join(f"'{c}'" for c in tables.calling_codes())
    pieces = f"split(regexp_replace(text, {token}, '\\u0001$1\\u0001'), '\\u0001', -1)"
    return {
        # tokens of masked texts
        "pii_tokens": f"(text STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(text, {token}, 1))",
        "unmask_text": f"(text STRING, tokens MAP<STRING, STRING>) RETURNS STRING RETURN array_join(transform({pieces}, (p, i) -> CASE WHEN i % 2 = 1 THEN coalesce(try_element_at(tokens, p), p) ELSE p END), '')",
        # guards
        "token_estimate": "(text STRING) RETURNS INT RETURN greatest(1, cast(floor(length(coalesce(text, '')) / 4) AS INT))",
        "symbol_only": r"(text STRING) RETURNS BOOLEAN RETURN NOT rlike(coalesce(text, ''), r'\p{L}')",
        "has_markup": f"(text STRING) RETURNS BOOLEAN RETURN coalesce(rlike(text, {_quoted(guards._HTML)}) OR rlike(text, {_quoted(guards._XSS)}), false)",
        "has_statement": f"(text STRING) RETURNS BOOLEAN RETURN coalesce(rlike(text, {_quoted(guards._SQL)}), false)",
        "strip_markup": f"(text STRING) RETURNS STRING RETURN replace(replace(regexp_replace(text, {_quoted(guards._HTML)}, ''), '&', '&amp;'), '<', '&lt;')",
        # times and numbers
        "local_iso": "(ts TIMESTAMP) RETURNS STRING RETURN concat(date_format(ts + INTERVAL 7 HOURS, \"yyyy-MM-dd'T'HH:mm:ss\"), '+07:00')",
        "local_long": f"(ts TIMESTAMP) RETURNS STRING RETURN concat(date_format(ts + INTERVAL 7 HOURS, 'dd'), ' ', get(array({months}), month(ts + INTERVAL 7 HOURS) - 1), ' ', date_format(ts + INTERVAL 7 HOURS, 'yyyy HH:mm:ss'), ' WIB')",
        "calling_code": f"(digits STRING) RETURNS STRING RETURN get(filter(array(left(digits, 1), left(digits, 2), left(digits, 3)), c -> array_contains(array({codes}), c)), 0)",
        "document_key": "(a STRING, b STRING DEFAULT NULL) RETURNS STRING RETURN sha2(concat_ws('|', coalesce(a, ''), b), 256)",
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register everything under ``prefix`` + its name; the names.  Registering again replaces."""
    names = []
    for name, rest in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{rest}")
        names.append(prefix + name)
    for name, cls in (("pii_spans", PiiSpans), ("disjoint_spans", DisjointSpans)):
        spark.udtf.register(prefix + name, udtf(cls))
        names.append(prefix + name)
    return names
