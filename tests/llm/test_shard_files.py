"""Shards as files: whole rows, bounds, and range queries that leave files unread."""

import re
from collections import Counter

from pyspark.sql import functions as F

from textshield.llm import hilbert, ledger


def _key(r):
    return tuple(str(x) for x in r)


def test_range_queries_read_few_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "s")
    bounds = hilbert.write_shards(docs, path, 40)
    assert bounds.count() == 40 and {r["n"] for r in bounds.collect()} == {25}
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.drop("shard").select(*docs.columns).exceptAll(docs).isEmpty() and rows.count() == docs.count()
    for ranges, most in (({"doc_id": (100, 200)}, 20), ({"lang": ("de", "de"), "n_chars": (0, 500)}, 15), ({"n_chars": (1000, 1500), "doc_id": (500, 900), "lang": ("en", "en")}, 20), ({"doc_id": (10**9, 10**9)}, 0)):
        got = hilbert.read_range(spark, path, ranges)
        want = docs
        for d, (low, high) in ranges.items():
            want = want.where(F.col(d).between(low, high))
        assert sorted(map(_key, got.select(*docs.columns).collect())) == sorted(map(_key, want.collect()))
        if most:
            read = {re.search(r"shard=(\d+)/", f)[1] for f in got.inputFiles()}
            assert len(read) <= most


def test_files_of_a_large_shard(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("lang"))
    path = str(tmp_path / "s")
    bounds = hilbert.write_shards(docs, path, 4, rows_per_file=20)
    assert all(r["lang_min"] is None and r["n"] == 75 for r in bounds.collect())
    files = spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) == 16 and max(r["count"] for r in files) == 20
    assert hilbert.read_range(spark, path, {"lang": ("a", "z")}).count() == 0
    empty = hilbert.write_shards(docs.limit(0), str(tmp_path / "e"), 4)
    assert empty.count() == 0
    assert hilbert.read_range(spark, str(tmp_path / "e"), {"doc_id": (0, 9)}).columns == ["doc_id", "text", "lang", "shard"]


# --- secrets, by a walk over characters that shares nothing with the operator -----



def _base(text):
    """(kind, start, end) of all three kinds."""
    out, n = [], len(text)

    def run(i, chars):
        j = i
        while j < n and text[j] in chars:
            j += 1
        return j

    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = set(upper + upper.lower() + digits + "/+_.=-")
    i = 0
    while i < n:
        match = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c in upper else c for c in text[i : i + len(name)]) != name:
                continue
            for quoted in (True, False):
                j = i + len(name)
                if quoted and j < n and text[j] in "\"'":
                    j += 1
                elif quoted:
                    continue
                j = run(j, " ")
                if j < n and text[j] in ":=":
                    j = run(j + 1, " ")
                    # a quote may stand before the value
                    j += j < n and text[j] in "\"'"
                    end = run(j, word)
                    if end > j:
                        match = (i, j, end)
                        break
            if match:
                break
        if match:
            if match[2] - match[1] >= 8:
                out.append(("assign", match[0], match[2]))
            i = match[2]
        else:
            i += 1
    for kind, head, chars, least in (("access", "AKIA", set(upper + digits), 16), ("hex", "", set("abcdef" + digits), 32)):
        i = 0
        while i < n:
            j = run(i + len(head), chars) if text.startswith(head, i) else i
            if j > i + len(head):
                if j - i >= least:
                    out.append((kind, i, j))
                i = j
            else:
                i += 1
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_secrets_against_a_walk(spark):
    odd = ["", None, "password=12345678", "PassWd' :  \"abcd.efgh=", "token=short token: longenough1", "api-key=12345678", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "AKIAAKIA" + "0" * 20, "f" * 31, "f" * 32 + "G" + "0" * 40, "secret==abcdefgh", "ſecret=abcdefgh", "token\t=abcdefgh", "secret token=password=abcdefghi", "é password = '0123456789abcdef0123456789abcdef'", "apikey='", "passwd: token: abcdefghij"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in ledger.scan(docs).collect()}
    assert got == {i: _base(t) for i, t in texts.items()}
