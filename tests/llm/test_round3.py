"""Filter audit, whitening and URL filters on small odd tables, against brute force."""

import itertools
import math
import re
from collections import Counter
from math import factorial

import numpy as np
import pytest

from textshield.llm import filter_audit, queries, urls, whitening

# --- filter audit -----------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, words string, digest string, n string, A string, least string, good string"
LABELS = "doc_id long, quality int, toxic int, id string, good string, part string"


def _audit_tables(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocab, n)) for n in (20, 99, 100, 101, 300, 1000)]
    texts += [texts[4], texts[4], texts[4].upper(), texts[3] + " $", texts[0].title() + " |", "dup " * 150, None, "", " \t\n\x0b\x0c\r ", "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, "é Ä ß 語 " * 40, "a b " * 120, "x" * 200_000, "w " * 120_000]
    rows = [(i * 3 - 9, t, [None, "en", "de", ""][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[4], "en"), (None, "alone", "th"), (10**14, texts[1], "en")]
    rows += [(1000 + i, "the same", "hot") for i in range(60)]
    docs = spark.createDataFrame([(*r, "s", 1, *["clash"] * 8) for r in rows], DOCS).repartition(3)
    marks = [(r[0], int(rng.integers(0, 2)), int(rng.integers(0, 2))) for r in rows[::2]]
    marks += [marks[0], (marks[1][0], 1, None), (None, 1, 1), (77777, 1, 1), (marks[2][0], None, 1)]
    return rows, marks, docs, spark.createDataFrame([(*m, "clash", "clash", "clash") for m in marks], LABELS)


def _brute_audit(rows, marks):
    def fails(i, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return (
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        )

    good = {m[0] for m in marks if m[1] == 1 and m[0] is not None}
    toxic = {m[0] for m in marks if m[2] == 1 and m[0] is not None}
    table = [(p or "", fails(i, t), i in good, i in toxic) for i, t, p in rows]
    out, shapley = {}, Counter()
    for part in {r[0] for r in table}:
        own = [r for r in table if r[0] == part]
        for order in itertools.permutations(range(5)):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                key = (part, "".join("ABCDE"[x] for x in order), k + 1)
                out[key] = (
                    len(left),
                    len(gone),
                    sum(r[1][f] for r in own) - len(gone),
                    sum(r[1][f] and sum(r[1]) == 1 for r in own),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                    f,
                )
                shapley[part, f] += len(gone)
    return {(*k, *v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows, marks, docs, labels = _audit_tables(spark)
    got = filter_audit.interaction_audit(filter_audit.document_failures(docs, labels))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r[n] for n in names) for r in got.collect()]
    want = _brute_audit(rows, marks)
    assert len(found) == len(want) == 5 * 600
    assert set(found) == want
    # the values of a filter's share add up to all that is removed
    one = [r for r in found if r[0] == "en" and r[1] == "ABCDE"]
    assert sum(r[9] for r in one) == factorial(5) * sum(r[4] for r in one)


def test_filter_audit_states_run_once(spark, monkeypatch):
    """32 states but the last one, whatever the number of orders, and none stays in memory."""
    _, _, docs, labels = _audit_tables(spark)
    rows = filter_audit.document_failures(docs, labels)
    edges = filter_audit.edge_counts(rows, "ABCDE", ("good", "toxic"))
    masks = [r["mask"] for r in edges.where("part = 'en'").collect()]
    assert len(masks) == len(set(masks)) and 0 in masks and 31 not in masks
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_filter_audit_empty_and_few(spark):
    _, _, docs, labels = _audit_tables(spark)
    none = filter_audit.document_failures(docs.limit(0), labels.limit(0))
    assert filter_audit.interaction_audit(none).count() == 0
    bare = filter_audit.document_failures(docs, labels.limit(0))
    assert bare.where("good or toxic").count() == 0
    two = filter_audit.interaction_audit(bare, "AD", ())
    assert {r["filter_order"] for r in two.collect()} == {"AD", "DA"}
    with pytest.raises(ValueError):
        filter_audit.interaction_audit(bare, "ABCDEFGH")


# --- whitening --------------------------------------------------------------


def _brute_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    off = n * x - s
    centred = (off / n).astype(float)
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    return (off * off).sum(1), centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize(("d", "tile", "block"), [(40, 16, 7), (40, None, 2048), (5, 2, 3)])
def test_whitening(spark, d, tile, block):
    rng = np.random.default_rng(d)
    good = [list(map(float, v)) for v in rng.normal(size=(300, d)) * np.linspace(0.2, 2, d)]
    good += [good[0]] * 100  # a hot vector
    rows = [(i if i % 50 else None, v, "clash") for i, v in enumerate(good)]
    odd = [None, [None] + [0.0] * (d - 1), [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [1.0] * (d - 1), []]
    df = spark.createDataFrame(rows + [(9000 + i, v, "x") for i, v in enumerate(odd)], "vec_id long, embedding array<double>, id string").repartition(5)
    got = whitening.whiten(df, 32, tile=tile, block_rows=block).collect()
    k = min(32, d)
    deviation, white, explained = _brute_whitening(good, k)
    assert len(got) == len(good) and {r["n"] for r in got} == {len(good)}
    assert Counter((r["id"], int(r["deviation"])) for r in got) == Counter((i, int(x)) for (i, _, _), x in zip(rows, deviation, strict=True))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8
    assert np.allclose(got[0]["explained"], explained, rtol=1e-9)
    by_id = {r["id"]: np.array(r["whitened"]) for r in got if r["id"] is not None}
    a = np.array([by_id[i] for i, _, _ in rows if i is not None])
    b = np.array([w for (i, _, _), w in zip(rows, white, strict=True) if i is not None])
    signs = np.sign((a * b).sum(0))
    assert np.allclose(a * signs, b, atol=1e-6)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    # one dimension is constant: one component; entries past 64-bit products stay exact
    rows = [(i, [float(i * 2**40), 3.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert all(len(r["whitened"]) == 1 for r in got)
    deviation, _, _ = _brute_whitening([v for _, v in rows], 1)
    assert {(r["id"], int(r["deviation"])) for r in got} == set(enumerate(map(int, deviation)))


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    deviation, white, explained = _brute_whitening([r["embedding"] for r in rows], 32)
    got = queries.op12_tiled_whitening(spark, sf).toPandas()
    assert len(got) == 32 * len(rows)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    assert np.allclose(wide * np.sign((wide * white).sum(0)), white, atol=1e-6)
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == {r["vec_id"]: int(x) for r, x in zip(rows, deviation, strict=True)}
    assert np.allclose(got.groupby("component").explained.first(), explained)
    assert got.identity_error.max() < 1e-4


# --- URL filters ------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http:/x.org/", "https://Example.ORG/es/1?x#y", "https://example.org/en/10", "http://a.b.example.org/en/2", "http://xexample.org/es/",
    "http://org/", "http://org", "http://.org/x", "http://a..org/", "http://com/fr/", "ftp://shop.com/de/?q=/fr/", "http://shop.com?/fr/", "http://shop.com#/de/", "http://shop.com/fr", "http://shop.com/FR/",
    "x?u=http://y.org/z", "http://user@shop.com:80/de/", "http://ÄÖ.org/ü", "http://" + "a." * 30_000 + "com/de/" + "p" * 50_000, "http://net/es/", "http://\n.com/fr/\n?", "HTTPS://EXAMPLE.org/en/1",
]
RULES = [(v, h, p) for v, h, p in queries.OP13_RULES]


def _brute_urls(rows, rules, default="allow"):
    out = Counter()
    for i, u in rows:
        rest = u.split("://", 1)[1] if u is not None and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if path.startswith(p) and (host == h or host.endswith("." + h))]
        best = max(fit, default=(0, 0, None, default))
        out[i, host, path, best[2], best[3]] += 1
    return out


@pytest.mark.parametrize("most", [urls.BROADCAST_CHARS, 0])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "hot_rows", lambda n: 20)  # some prefixes are hot
    rows = [(i if i % 7 else None, u) for i, u in enumerate(URLS)] + [(99, URLS[4])] * 70
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], "page_id long, url string, html string, id string, host string, path string, rule string").repartition(4)
    more = [*RULES, ("block", "b.example.org", "/en/2"), ("block", "org", ""), ("allow", "", ""), ("block", "", "/es/"), ("block", "com", "/fr/"), ("allow", "com", "/fr/")]
    for rules in (RULES, more):
        table = spark.createDataFrame(rules, "verdict string, host string, path string")
        got = Counter(tuple(r) for r in urls.filter_urls(df, table, broadcast_chars=most).select("id", "host", "path", "rule", "verdict").collect())
        assert got == _brute_urls(rows, [r for r in rules if r != ("allow", "com", "/fr/") or rules is RULES])


def test_url_filter_empty(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    got = urls.filter_urls(pages, rules.limit(0), default="block").first()
    assert (got["rule"], got["verdict"]) == (None, "block")


def test_url_prefix_collision(spark, monkeypatch):
    """With prefixes of one digit most meet by chance; digests keep them apart."""
    monkeypatch.setattr(urls, "PREFIX", 1)
    rows = [(i, f"http://h{i}.com/p{i % 9}/x") for i in range(200)]
    rules = [("block", f"h{i}.com", f"/p{i % 5}") for i in range(0, 200, 3)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert Counter(tuple(r) for r in got.collect()) == _brute_urls(rows, rules)


