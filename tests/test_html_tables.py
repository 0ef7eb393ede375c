"""Nested tables: numbers in document order, outermost frozen, exact round trip."""

import re

import numpy as np
from pyspark.sql import functions as F

from textshield.operators import html

ODD = [None, "", "plain", "<table>", "</table>", "</table><table></table>", "<table><table></table>", "<TABLE a='1'>x</TABLE\n>", "<!-- <table> -->a<table>b</table>", "<script>'<table>'</script><table><style></table></style></table>", "<tablet>x</tablet><table>y</table>", "<table><!-- </table> -->z</table>w"]


def brute(page):
    """(table sources in document order, page with outermost tables as tokens)."""
    tag = re.compile(r"(?is)<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript)\s*>|(<table\b[^>]*>)|(</table\s*>)")
    stack, found = [], []
    for m in tag.finditer(page):
        if m[1]:
            stack.append(m.start())
        elif m[2] and stack:
            found.append((stack.pop(), m.end()))
    found.sort()
    out, at = "", 0
    for k, (a, b) in enumerate(found):
        if a >= at:
            out += page[at:a] + f"[TABLE_{k + 1:02d}]"
            at = b
    return [page[a:b] for a, b in found], out + page[at:]


def pages():
    rng = np.random.default_rng(11)
    bits = ["<table>", "<table class='x'>", "</table>", "<tr><td>", "</td></tr>", "text ", "<p>more</p>", "<!-- <table> -->", "<script>var t='</table>'</script>", "\n"]
    return [*ODD, *("".join(rng.choice(bits, rng.integers(1, 60))) for _ in range(150)), "<table>" * 300 + "deep" + "</table>" * 300]


def test_nested_tables_against_a_stack(spark):
    rows = list(enumerate(pages()))
    df = spark.createDataFrame(rows, "i int, html string")
    frozen = html.freeze_documents(df)
    got = {r["i"]: r for r in frozen.select("i", "html", "skeleton", "text_map", "table_map", html.reverse(F.col("skeleton"), F.col("text_map"), F.col("table_map")).alias("back")).collect()}
    for i, page in rows:
        r = got[i]
        assert r["back"] == page
        if page is None:
            continue
        sources, skeleton = brute(page)
        assert r["table_map"] == {f"[TABLE_{k + 1:02d}]": source for k, source in enumerate(sources)}
        # texts back, tables not: the page with its outermost tables as tokens
        shown = r["skeleton"]
        for token, text in r["text_map"].items():
            shown = shown.replace(token, text)
        assert shown == skeleton


def test_many_texts_and_tables(spark):
    """Time grows with the number of pieces, not with its square."""
    n = 100_000
    df = spark.createDataFrame([("<b></b>" * 10 * n,), ("<table></table>" * n,)], "html string").repartition(2)
    out = html.freeze_documents(df).select(F.length("skeleton").alias("n"), F.size("table_map").alias("t")).collect()
    assert sorted(r["t"] for r in out) == [0, n]
