"""Operators on small tables with every odd case, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_small_parts import brute_repeats
from tokenizers import Tokenizer

from textshield.llm import common, exact, hilbert, ledger, packing, projections, records, repeats, simhash, toxicity, wordtrie

BYTE = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
WORD = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th string, label string, blob string"


def _texts():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(200)]
    base = [" ".join(rng.choice(vocab, n)) for n in (3, 30, 150, 150, 400, 3000)]
    passage = " ".join(rng.choice(vocab, 120))
    return [*base, base[2], base[2] + " ", f"{base[1]} {passage} end", f"start {passage} {base[3]}", base[4].replace("a", "A", 1), None, "", " \n\t", "x" * 1300, "password = 'abcdefgh12' and " + "0f" * 20, base[5]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 - 20, t, None if i % 5 == 0 else "en", f"s{i % 3}", None if i % 4 == 0 else len(t or "")) for i, t in enumerate(_texts())]
    rows += [rows[3], rows[3], (None, "nobody's text", None, None, None), (10**15, "far away", "fr", "s9", 8)]
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_records(spark, docs, empty, tmp_path):
    path, index = records.write_and_index(docs, BYTE, end_id=2, path=str(tmp_path / "r"))
    tok = Tokenizer.from_str(BYTE)
    rows = sorted(index.collect(), key=lambda r: r["start"])
    assert [r["id"] is None for r in rows] == [True] + [False] * (len(rows) - 1)
    ids = [r["id"] for r in rows[1:]]
    assert ids == sorted(ids)
    want = Counter((i, zlib.crc32(np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in local(docs))
    assert Counter((r["id"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    back = records.read_records(spark, index, BYTE, seed=3).collect()
    assert Counter((r["id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back) == want
    few = index.where("id = 1").limit(1)
    assert records.read_records(spark, few, BYTE).count() == 1
    _, none = records.write_and_index(empty, BYTE, end_id=2, path=str(tmp_path / "e"))
    assert none.count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = sorted({simhash.fingerprint(t) for _, t in local(docs)})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 4:
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, t in local(docs):
        k = find(simhash.fingerprint(t))
        least[k] = i if least[k] is None else least[k] if i is None else min(i, least[k])
    want = Counter((i, least[find(simhash.fingerprint(t))]) for i, t in local(docs))
    assert Counter((r["id"], r["component"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_across_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    heart = int(rng.integers(1, 2**62))
    fps = sorted({heart ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (300, 2))})
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    cut = simhash.tiles
    monkeypatch.setattr(simhash, "tiles", lambda *a, **k: cut(*a, **k, rows=16))
    roots = common.connected_components(simhash.links(classes)).collect()
    assert {r["root"] for r in roots} == {0} and len(roots) == len(fps)


def test_packing(docs, empty):
    tok = Tokenizer.from_str(BYTE)
    rows = packing.pack_documents(docs, BYTE, end_id=2).collect()
    whole = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
    for i, t in set(local(docs)):
        whole[i] += len(tok.encode(t, add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in local(docs))
    for r in rows:
        assert 1 <= r["length"] <= 1024 and len(r["ids"]) == 4 * r["length"] and (r["piece"] == 0 or r["length"] == 1024)
    ends = {}
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows):
        assert o == ends.get(s, 0)
        ends[s] = o + n
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(ends.values()) // 1024) + 1
    assert packing.pack_documents(empty, BYTE, end_id=2).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(-20, 100)] + [(None, 1, None), (1, 0, None), (1, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    ids = [r["id"] for r in got if r["id"] is not None]
    held = {r[0]: r[1] for r in docs.select("doc_id", toxicity.held_out("doc_id")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in ids) and held[None] is False
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_toxicity_separates_held_out_rows(spark):
    d, g = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d, g)
    rows = toxicity.score(d, model).withColumnRenamed("id", "doc_id").join(g, "doc_id").where(toxicity.held_out("doc_id")).select("score", "toxic").collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    ranks = np.argsort(np.argsort(s))
    auc = (ranks[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.9


def test_word_trie(docs, empty):
    ref = Tokenizer.from_str(WORD)
    want = Counter()
    for i, t in local(docs):
        ids = ref.encode(t, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in wordtrie.encode_digests(docs, WORD).collect()) == want
    coded = wordtrie.encode(docs, WORD)
    assert wordtrie.decode(coded, WORD, text_col="again").where("decoded <> again").count() == 0
    assert wordtrie.encode(empty, WORD).count() == 0


def test_ledger(docs, empty, tmp_path):
    book = str(tmp_path / "ledger")
    want = Counter((i, tuple(ledger.base_spans(t))) for i, t in local(docs))
    for _ in range(2):
        got = ledger.scan(docs, book).collect()
        assert Counter((r["id"], tuple(tuple(s) for s in r["spans"])) for r in got) == want
    spark = docs.sparkSession
    rows = spark.read.parquet(book)
    assert rows.count() == len({t for _, t in local(docs)}) == rows.select("blob").distinct().count()
    newer = ledger.Rules("base-2")
    ledger.scan(docs, book, newer)
    assert spark.read.parquet(book).count() == 2 * rows.count()
    clean = ledger.redact(docs, ledger.scan(docs))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any(ledger.base_spans(t) for _, t in local(clean)) and clean.where("text like '[SECRET]%[SECRET]'").count() == 1
    assert ledger.scan(empty).count() == 0


@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_hilbert_shards(docs, empty, n_shards):
    rows = hilbert.shard(docs, n_shards).collect()
    want = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in local(docs))
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert hilbert.shard(empty, n_shards).count() == 0


def test_hilbert_curve_moves_one_step(spark):
    for dims, bits in [(2, 3), (3, 2), (4, 2), (2, 1)]:
        n = 1 << (dims * bits)
        df = spark.range(n).select(F.array(*(F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int") for i in range(dims))).alias("x"))
        rows = sorted((r["h"], r["x"]) for r in df.select("x", hilbert.hilbert_index(F.col("x"), dims, bits).alias("h")).collect())
        assert [h for h, _ in rows] == list(range(n))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(rows, rows[1:]))


def test_native_plans(docs):
    for df in (hilbert.shard(docs), exact.exact_duplicates(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16))
    x[40:] = x[0] + 0.02 * rng.standard_normal((20, 16))
    x[39] = x[38]
    rows = [(i, v.astype(np.float32).tolist(), None if i == 7 else int(i % 2) if i < 30 else 0) for i, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [1.0, None] * 8, 0), (104, [float("inf")] + [0.0] * 15, 0), (105, [1.0, 2.0], 0), (106, [2.0, 4.0], 0), (107, [], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = {r["id"]: (r["n_links"], r["component"]) for r in projections.near_duplicates(df).collect()}
    good = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if g is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {i: [j for j, (w, h) in good.items() if j != i and h == g and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98] for i, (v, g) in good.items()}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(links.get(i, [])), min(seen))
    assert projections.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_a_dense_label(spark):
    """Pairs of ids far apart in a label around one mean; neighbours in id are no links."""
    rng = np.random.default_rng(8)
    mean = rng.standard_normal(32)
    x = mean / np.sqrt(mean @ mean) + 0.05 * rng.standard_normal((6000, 32))
    x[3000:3200] = x[:200] + 0.0125 * rng.standard_normal((200, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "hot") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string").repartition(3)
    y = x.astype(float)
    near = (y @ y.T) / np.outer(np.sqrt((y * y).sum(1)), np.sqrt((y * y).sum(1))) >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum() > 300
    root = simhash.spanning(len(y), iter([np.nonzero(near)]))
    got = {r["id"]: (r["n_links"], r["component"]) for r in projections.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(y))}


def brute_links(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    y = x.astype(float)
    near = ((y @ y.T) / np.outer(np.sqrt((y * y).sum(1)), np.sqrt((y * y).sum(1))) >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("kind", ["scattered", "around one mean", "one dense group", "chains"])
def test_vector_passes_find_links(spark, kind, monkeypatch):
    """The passes alone: at least 0.9 of the link ends, no link or component that brute force lacks."""
    monkeypatch.setattr(projections, "SWEEP_ROWS", 256)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 32))
    labels = np.zeros(len(x), int)
    if kind == "scattered":
        labels = rng.integers(0, 3, len(x))
        x[2000:] = x[:2000] + rng.uniform(0.02, 0.21, (2000, 1)) * rng.standard_normal((2000, 32))
        labels[2000:] = labels[:2000]
    elif kind == "around one mean":
        x = rng.standard_normal(32) + 0.3 * x
        x[2000:] = x[:2000] + 0.15 * rng.standard_normal((2000, 32))
    elif kind == "one dense group":
        x[:1500] = x[0] + 0.12 * rng.standard_normal((1500, 32))
    else:
        for i in range(1, 1000):
            x[i] = x[i - 1] + 0.14 * rng.standard_normal(32)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int").repartition(5)
    near = brute_links(x, labels)
    root = simhash.spanning(len(x), iter([np.nonzero(near)]))
    got = {r["id"]: (r["n_links"], r["component"]) for r in projections.near_duplicates(df, exact=False).collect()}
    n = np.array([got[i][0] for i in range(len(x))])
    assert near.sum() > 1500 and (n <= near.sum(1)).all()
    assert n.sum() >= 0.9 * near.sum()
    assert all(root[got[i][1]] == root[i] and got[i][1] <= i for i in range(len(x)))


def test_vector_passes_with_odd_rows(spark):
    """Nulls, zeros, other lengths, repeated rows, an empty table: as with all pairs compared."""
    rows = [(i, [1.0, 0.001 * i], "a", "clash") for i in range(5)] + [(7, [1.0, 0.0], "a", ""), (7, [1.0, 0.0], "a", ""), (None, [1.0, 0.0], "a", "")]
    rows += [(10, None, "a", ""), (11, [], "a", ""), (12, [0.0, 0.0], "a", ""), (13, [1.0, None], "a", ""), (14, [float("inf"), 0.0], "a", ""), (15, [1.0], "a", ""), (16, [1.0, 0.0], None, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, root string")
    both = [sorted(map(repr, projections.near_duplicates(df, exact=e).collect())) for e in (True, False)]
    assert both[0] == both[1] and len(both[0]) == len(rows)
    assert projections.near_duplicates(df.limit(0), exact=False).count() == 0


def test_passes_grow_with_the_rows():
    some = [projections.passes_for(n, 32, 0.98) for n in (0, 1, 10**4, 10**9, 10**12)]
    assert some == sorted(some) and some[0] == projections.PASSES < some[-1] < 100


@pytest.mark.parametrize("most", [500, 1])
def test_repeats(docs, empty, most, monkeypatch):
    monkeypatch.setattr(repeats, "DICTIONARY_PHRASES", most)
    rows = local(docs)
    marks = brute_repeats([t.encode() for _, t in rows], 400)
    want = Counter()
    for (i, t), m in zip(rows, marks):
        kept = np.frombuffer(t.encode(), np.uint8)[~m].tobytes()
        want[(i, len(m), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = repeats.remove_repeats(docs, 400).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert repeats.remove_repeats(empty, 400).count() == 0


def wanted_groups(docs):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]", "", t), t) for i, t in local(docs)]
    groups = defaultdict(list)
    for i, n, t in rows:
        groups[n].append((-len(t), i is None, i, t))
    want = Counter()
    for i, n, _ in rows:
        keep = min(groups[n], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want[(i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest())] += 1
    return want


def as_counter(found):
    return Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect())


def test_exact(docs, empty):
    for bucket_rows in (512, 2):
        assert as_counter(exact.exact_duplicates(docs, bucket_rows=bucket_rows)) == wanted_groups(docs)
    assert exact.exact_duplicates(empty).count() == 0


def test_exact_compares_bytes_in_chains(docs, monkeypatch):
    """With a hash that many texts share, and with hot ones."""
    monkeypatch.setattr(exact, "hashed", lambda norm: F.xxhash64(F.length(norm) % 3))
    assert as_counter(exact.exact_duplicates(docs)) == wanted_groups(docs)
    monkeypatch.setattr(exact, "hot_rows", lambda total: 1)
    assert as_counter(exact.exact_duplicates(docs)) == wanted_groups(docs)


def test_exact_deals_hot_texts_over_owners(docs, monkeypatch):
    monkeypatch.setattr(exact, "hot_rows", lambda total: 1)
    assert as_counter(exact.exact_duplicates(docs)) == wanted_groups(docs)


def test_index_finds_later_rows(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    exact.build_index(docs.where("doc_id < 40"), path=path, bucket_rows=2)
    known = {n for _, _, _, _, n in wanted_groups(docs.where("doc_id < 40"))}
    got = exact.lookup(docs, path).collect()
    assert len(got) == docs.count() and all((r["keep_id"] is not None) == (r["text_sha256"] in known) for r in got)


def test_directory_doubles(spark):
    hashes = spark.range(2000).select(F.xxhash64("id").alias("h")).unionByName(spark.range(300).select(F.shiftleft("id", 45).alias("h"))).distinct()
    slots, deep = exact.directory(hashes, 64)
    of = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
    rows = [r["h"] & (2**64 - 1) for r in hashes.collect()]
    sizes = Counter(of[h >> (64 - deep)] for h in rows)
    assert max(sizes.values()) <= 64 and len({d for _, d in sizes}) > 2
    assert all((h >> (64 - d)) << (deep - d) == b for h in rows for b, d in [of[h >> (64 - deep)]])
    slots, deep = exact.directory(hashes, 8, most_bits=5)
    assert deep == 5 and slots.count() <= 32
    assert exact.directory(hashes.limit(0))[0].count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r["id"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
