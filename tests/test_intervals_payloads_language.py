import json
import random

from pyspark.sql import functions as F

from textshield.operators import intervals, language, payloads
from textshield.sources.io import read_table

# --- intervals ------------------------------------------------------------


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc string, st int, en int, note string")


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)

    def some(n, name):
        rows = [(rng.choice("ab"), st, st + rng.choice([0, 1, 5, 40, 300]), f"{name}{i}") for i, st in enumerate(rng.randrange(400) for _ in range(n))]
        return [*rows, rows[0], (None, 1, 9, name), ("a", None, 9, name), ("a", 3, None, name)]

    a, b = some(60, "a"), some(40, "b")
    meet = lambda x, y: None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    for width in (1, 16, 1000):
        got = intervals.overlapping(_spans(spark, a), _spans(spark, b), "doc", width).collect()
        assert sorted((r["doc"], tuple(r["a"]), tuple(r["b"])) for r in got) == sorted((x[0], x, y) for x in a for y in b if meet(x, y))
        free = intervals.apart(_spans(spark, a), _spans(spark, b), "doc", width).collect()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, free), key=key) == sorted((x for x in a if not any(meet(x, y) for y in b)), key=key)


def test_a_text_with_many_spans(spark):
    """100,000 spans of one text on either side: nobody compares all with all."""
    a = spark.range(100_000).selectExpr("'d' AS doc", "cast(id * 10 AS INT) AS st", "cast(id * 10 + 4 AS INT) AS en")
    b = spark.range(100_000).selectExpr("'d' AS doc", "cast(id * 20 + 3 AS INT) AS st", "cast(id * 20 + 6 AS INT) AS en")
    assert intervals.apart(a, b, "doc").count() == 50_000
    assert intervals.overlapping(a, b, "doc").count() == 50_000


# --- payloads ---------------------------------------------------------------


def _first(value, path="$"):
    """The first hit, fields in order of their names."""
    if isinstance(value, dict):
        for k in sorted(value):
            if k.startswith("$"):
                return f"{path}.{k}", f"forbidden key: {k}"
            if hit := _first(value[k], f"{path}.{k}"):
                return hit
    elif isinstance(value, list):
        for i, x in enumerate(value):
            if hit := _first(x, f"{path}[{i}]"):
                return hit
    elif isinstance(value, str) and "<b>" in value:
        return path, "html/xss"
    elif isinstance(value, str) and "drop" in value:
        return path, "sql-like"
    return None


def test_payloads_against_recursion(spark):
    rng = random.Random(7)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return rng.choice([None, True, 3, 1.5, "fine", "$fine", "[{(", "<b>x", "drop it", '"quoted" \\ {'])
        if kind < 0.65:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", "c", "z", "$w", "é"]): value(depth - 1) for _ in range(rng.randrange(4))}

    rows = [(i, json.dumps(v), _first(v)) for i, v in enumerate(value(6) for _ in range(150))]
    rows += [(900, None, None), (901, "", None), (902, "{broken", None), (903, '"<b>"', ("$", "html/xss")), (904, "[" * 30 + '"<b>"' + "]" * 30, ("$" + "[0]" * 30, "html/xss"))]
    df = spark.createDataFrame([r[:2] for r in rows], "id int, raw string")
    got = {r["id"]: (r["path"], r["reason"]) for r in payloads.scan(df, "id", "raw").collect()}
    assert got == {i: hit for i, _, hit in rows if hit}
    assert payloads.scan(df.limit(0), "id", "raw").count() == 0


# --- language ---------------------------------------------------------------


def _right(docs, found):
    return docs.join(found, docs["doc_id"] == found["id"]).where(F.col("lang") == F.col("detected")).count()


def test_profiles_are_as_good_as_words(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    by_words, by_profile = _right(docs, language.detect(docs)), _right(docs, language.detect_by_profile(docs))
    assert by_profile >= by_words
    learned = language.learn_profiles(docs.where("doc_id % 2 = 0"))
    held_out = docs.where("doc_id % 2 = 1")
    assert learned.groupBy("lang").count().where(f"count > {language.RANKS}").isEmpty()
    assert _right(held_out, language.detect_by_profile(held_out, table=learned)) >= 0.98 * held_out.count()


def test_profiles_by_example(spark):
    rows = [(1, "Laporan ini tidak akan dari mereka karena sudah ada pada saat itu"), (2, "the report of the company was not what we would have said"), (3, "hii ni taarifa ya watu wa mji huu na siku za baada ya kuwa"), (4, None), (5, ""), (6, "12 !!"), (None, "der Bericht und die Firma ist nicht von uns")]
    got = {r["id"]: r for r in language.detect_by_profile(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {k: r["detected"] for k, r in got.items()} == {1: "id", 2: "en", 3: "sw", None: "de"}
    assert all(0.5 <= r["confidence"] <= 1 for r in got.values())
    assert all(r <= language.RANKS for _, _, r in language.profiles())
