"""HTML: text and tables frozen to tokens, and put back.

The source is cut into markup and text by one pattern (comments, raw-text
elements whole, tags), so the pieces joined are the source again and markup
inside a script is no markup.  Tables are frozen first: each gets a number in
document order, nested ones too, and the outermost make room for their token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import fold_sql, let, let_sql, pieces
from .masking import unmask

_RAW = r"<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript)\s*>"
#: What opens or closes a table, and what may hold such a tag that is none.
_TABLE = rf"(?is){_RAW}|<table\b[^>]*>|</table\s*>"
_MARKUP = rf"(?is){_RAW}|<[^>]*>|\[TABLE_\d+\]"




def _numbered(kind: str, n: Column) -> Column:
    return F.concat(F.lit(f"[{kind}_"), F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")), F.lit("]"))


def _texts(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: (x["i"] % 2 == 0) & (F.regexp_replace(x["p"], r"(?U)\s+", "") != ""))


def text_nodes(html: Column) -> Column:
    """Text outside markup and raw-text elements that isn't blank, in order."""
    return F.transform(_texts(pieces(html, _MARKUP)), lambda x: x["p"])


_TAGS = "filter(transform(parts, (p, i) -> named_struct('tag', lower(left(p, 7)), 'i', i)), x -> x.i % 2 = 1 AND (x.tag = '</table' OR startswith(x.tag, '<table')))"
# A closing tag that closes nothing has level 0.
_LEVELS = fold_sql("tags", "0", "CASE WHEN x.tag != '</table' THEN a.s + 1 ELSE greatest(a.s - 1, 0) END", "CASE WHEN x.tag != '</table' THEN a.s + 1 ELSE a.s END")
_EVENTS = f"array_sort(zip_with({_LEVELS}, tags, (n, x) -> named_struct('level', n, 'i', x.i, 'opens', x.tag != '</table')))"
_NEXT = "get(events, k + 1)"
_PAIRS = f"transform(events, (e, k) -> CASE WHEN e.level > 0 AND e.opens AND NOT {_NEXT}.opens AND {_NEXT}.level = e.level THEN named_struct('i', e.i, 'j', {_NEXT}.i) END)"
_PLACES = f"get(transform(array({_TAGS}), tags -> get(transform(array({_EVENTS}), events -> array_sort(filter({_PAIRS}, x -> x IS NOT NULL))), 0)), 0)"


def table_places(parts: Column) -> Column:
    """array of struct(i, j) by i: the pieces that open and close a table, nested ones too.

    A closing tag belongs to the last open one; one without is no table's, and
    neither is an opening tag that nothing closes.  A tag's level is the number
    of tables open around it, its own included.  At one level opening and
    closing tags alternate, so in order of level and place each closing tag
    stands right behind its own.
    """
    return let_sql(parts, "parts", _PLACES)


# Tables that begin behind the end of all before them; numbers of the texts that aren't blank, 0 for the other pieces.
_OUTER = fold_sql("named", "named_struct('k', 0, 'end', -1)", "named_struct('k', a.s.k + 1, 'end', greatest(a.s.end, x.j))", "CASE WHEN x.i > a.s.end THEN a.s.k END")
_NUMBERS = fold_sql("marked", "0", "CASE WHEN x.text THEN a.s + 1 ELSE a.s END", "CASE WHEN x.text THEN a.s + 1 ELSE 0 END")


def freeze(html: Column) -> Column:
    """struct(skeleton, text_map, table_map, text_format).

    The table map has every table with its source; a table within another is
    part of the outer one's source, so only outermost tables have their token
    in the skeleton.
    """

    def with_texts(rest: Column, table_map: Column) -> Column:
        def body(parts: Column) -> Column:
            blank = lambda p: F.regexp_replace(p, r"(?U)\s+", "") == ""
            # every second piece is markup; the others that aren't blank are numbered, from 1
            marked = F.transform(parts, lambda p, i: F.struct(((i % 2 == 0) & ~blank(p)).alias("text"), p.alias("p")))

            def numbered(marked: Column) -> Column:
                numbers = let_sql(marked, "marked", _NUMBERS)
                return let(F.zip_with(numbers, marked, lambda n, x: F.struct(F.when(n > 0, _numbered("TEXT", n)).alias("name"), x["p"].alias("p"))), told)

            def told(named: Column) -> Column:
                texts = F.filter(named, lambda x: x["name"].isNotNull())
                return F.struct(
                    F.array_join(F.transform(named, lambda x: F.coalesce(x["name"], x["p"])), "").alias("skeleton"),
                    F.map_from_entries(texts).alias("text_map"),
                    table_map.alias("table_map"),
                    F.array_join(F.transform(texts, lambda x: x["p"]), "\n").alias("text_format"),
                )

            return let(marked, numbered)

        return let(pieces(rest, _MARKUP), body)

    def with_tables(parts: Column) -> Column:
        between = lambda a, b: F.array_join(F.slice(parts, a + 1, F.greatest(b - a, F.lit(0))), "")

        def body(places: Column) -> Column:
            return let(F.transform(places, lambda t, k: F.struct(t["i"].alias("i"), t["j"].alias("j"), _numbered("TABLE", k + 1).alias("name"))), placed)

        def placed(named: Column) -> Column:
            first = let_sql(named, "named", _OUTER)
            outer = F.transform(first, lambda k: F.get(named, k))

            def put(o: Column) -> Column:
                before = F.transform(o, lambda t, k: F.concat(between(F.when(k == 0, 0).otherwise(F.get(o, k - 1)["j"] + 1), t["i"]), t["name"]))
                rest = F.concat(F.array_join(before, ""), between(F.get(o, F.size(o) - 1)["j"] + 1, F.size(parts)))
                return F.struct(F.when(F.size(o) > 0, rest).otherwise(F.array_join(parts, "")).alias("rest"), F.map_from_entries(F.transform(named, lambda t: F.struct(t["name"], between(t["i"], t["j"] + 1)))).alias("map"))

            return let(outer, put)

        return let(table_places(parts), body)

    # a text without a table is one piece
    parts = F.when(html.rlike("(?i)</table"), pieces(html, _TABLE)).otherwise(pieces(html, "(?!)"))
    return let(let(parts, with_tables), lambda t: with_texts(t["rest"], t["map"]))


def reverse(skeleton: Column, text_map: Column, table_map: Column) -> Column:
    """Texts back in one pass, then tables; tokens without an entry stay."""
    return unmask(unmask(skeleton, text_map), table_map)


def parse_text_format(text: Column) -> Column:
    """A map from lines of ``key: value``; a line without a colon has an empty value."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*)", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:?", "")).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])))


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings, else null."""
    return F.from_json(F.when(text.rlike(r"^\s*\{"), text), "map<string,string>")


def chosen_map(final: Column, old: Column) -> Column:
    """The final text's own map if it is JSON with text tokens, else that text for every token."""
    own = json_map(final)
    return F.when(F.exists(F.map_keys(own), lambda k: k.startswith("[TEXT_")), own).otherwise(F.transform_values(old, lambda k, v: final))


def freeze_documents(df: DataFrame, html_col: str = "html") -> DataFrame:
    out = df.withColumn("_f", freeze(F.col(html_col)))
    return out.select(*df.columns, "_f.*")
