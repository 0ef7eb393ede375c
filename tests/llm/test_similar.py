"""Documents linked by the similarity of their shingle sets, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from textshield.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, text, least):
    """A copy that is ``least`` alike or just above."""
    words = text.split()
    for at in rng.sample(range(len(words)), len(words)):
        old, words[at] = words[at], f"new{rng.randrange(10**6)}"
        if alike(text, " ".join(words)) < least:
            words[at] = old
            break
    return " ".join(words)


def components(ids, linked):
    root = {i: i for i in ids}
    for a, b in linked:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    return {i: top(i) for i in ids}


def test_copies_at_the_edge_and_below(spark):
    rng = random.Random(3)
    rows, planted, apart = [], [], []
    for k in range(160):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 300, 900])))
        rows.append((10 * k, text))
        level = (0.8, 0.9, 0.6)[k % 3]
        rows.append((10 * k + 1, changed(rng, text, level)))
        (planted if alike(*(t for _, t in rows[-2:])) >= 0.8 else apart).append((10 * k, 10 * k + 1))
    got = {r["id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and len(planted) > 80 and len(apart) > 30
    assert sum(got[a] == got[b] for a, b in planted) >= 0.93 * len(planted)
    assert all(got[a] != got[b] for a, b in apart)


def test_dense_cluster_over_many_tiles(spark):
    """3,000 copies of one text with a word or two changed, in tries of several tiles."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]

    def copy():
        w = list(words)
        for at in rng.sample(range(200), 2):
            w[at] = f"n{rng.randrange(10**6)}"
        return " ".join(w)

    rows = [(i, copy()) for i in range(3000)] + [(5000 + i, " ".join(f"x{rng.randrange(3000)}" for _ in range(50))) for i in range(300)]
    got = {r["id"]: r["component"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert {got[i] for i in range(3000)} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(300))


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (5, text.upper()), (5, text), (None, text), (None, "alone with no id at all"), (6, "few words"), (7, "Few  words"), (8, "x " * 200_000), (9, "x " * 200_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "rep", "f0", "shingles", "component", "a", "b", "end", "tile_id", "known")})
    got = sorted(((r["id"], r["component"]) for r in simhash.similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (None, None), (6, 6), (7, 6), (8, 8), (9, 8)], key=str)
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_trie_join_leaves_known_components_and_forest():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    p = np.sort(np.concatenate([seeds ^ np.uint64(1 << b) for b in rng.integers(0, 60, 12)]))
    label = np.array([int(np.bitwise_count(seeds ^ x).argmin()) for x in p])
    label[::7] = -np.arange(len(label[::7])) - 1
    node = np.array([[0, len(p), 0, len(p)]])
    zero = np.zeros(1)
    q = p.copy()
    pairs = {(int(i), int(j)) for a, b in simhash.trie_join(p, q, node, zero, zero, 3, (label, label)) for i, j in zip(a, b)}
    brute = {(i, j) for i in range(len(p)) for j in range(len(p)) if int(p[i] ^ p[j]).bit_count() <= 3}
    assert pairs <= brute and {x for x in brute if label[x[0]] != label[x[1]]} <= pairs
    wide = p.reshape(-1, 1)
    i, j = simhash.nearest_forest(simhash.trie_join(p, None, node, zero, zero, 3), wide, wide, 3)
    want = components(range(len(p)), [x for x in brute if x[0] < x[1]])
    assert components(range(len(p)), list(zip(i.tolist(), j.tolist()))) == want
    assert len(i) == len(p) - len(set(want.values()))


def test_tiles_meet_unless_common_bits_rule_links_out(spark):
    rng = np.random.default_rng(3)
    tops = rng.integers(-(1 << 63), (1 << 63) - 1, 40, dtype=np.int64)
    rows = []
    for t, top in enumerate(tops.tolist()):
        free = int(rng.integers(0, 65))
        mask = (1 << free) - 1
        base = (top if t % 3 else int(tops[0])) & ~mask
        held = sorted({(base & ((1 << 64) - 1) | (int(r) & mask)) for r in rng.integers(0, 1 << 63, 5)})
        rows.append((0, 1, t, False, sorted((h + (1 << 63)) % (1 << 64) - (1 << 63) for h in held)))
    cut = spark.createDataFrame(rows, "choice int, key long, tile_id long, whole boolean, orders array<long>")
    got = {tuple(r) for r in simhash._meeting(cut, ["choice", "key"], 4).collect()}
    want = set()
    for *_, i, _, p in rows:
        for *_, j, _, q in rows:
            if i < j:
                free = max((p[0] ^ p[-1]) % (1 << 64), (q[0] ^ q[-1]) % (1 << 64)).bit_length()
                if (((p[0] ^ q[0]) % (1 << 64)) >> free).bit_count() <= 4:
                    want.add((i, j))
    assert got == want and 0 < len(want) < 780


def chains(rng, number, length):
    """Rows of texts each some 0.82 alike to the one before, so that only neighbours link."""
    rows = []
    for k in range(number):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
        for step in range(length):
            rows.append((1000 * k + step, text))
            text = changed(rng, text, 0.82)
    return rows


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    where = {}
    for i, s in sets:
        for x in s:
            where.setdefault(x, []).append(i)
    texts = dict(sets)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    linked = [(a, b) for a, b in pairs if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])]
    return components([i for i, _ in rows], linked)


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r["id"]: r["component"] for r in simhash.similar_documents(docs, **how).collect()}


def test_chains(spark):
    rows = chains(random.Random(8), 30, 6)
    want, got = brute(rows), found(spark, rows)
    assert found(spark, rows, exact=True) == want
    neighbours = [(a, b) for (a, _), (b, _) in zip(rows, rows[1:]) if want[a] == want[b]]
    assert len(neighbours) > 120
    assert sum(got[a] == got[b] for a, b in neighbours) >= 0.9 * len(neighbours)
    assert all(want[i] == want[c] for i, c in got.items())


def test_refused_edges_hide_no_other_pair(spark):
    """Short texts whose fingerprints tell little: nearest candidates are often refused."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]

    def edited():
        w = list(words)
        for at in rng.sample(range(40), rng.randrange(5)):
            w[at] = f"n{rng.randrange(3)}"
        return " ".join(w)

    rows = [(i, edited()) for i in range(1, 1300)]
    want = brute(rows)
    assert found(spark, rows, exact=True) == want
    assert len(set(want.values())) > 20


def test_refused_pairs_are_no_rows(spark, monkeypatch):
    """Texts of one source that mostly aren't 0.8 alike, but whose fingerprints are near: no table may have a row for each pair."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(110)]

    def edited():
        w = list(words)
        for at in rng.sample(range(110), rng.randrange(3, 6)):
            w[at] = f"n{rng.randrange(10**6)}"
        return " ".join(w)

    rows, most = [(i, edited()) for i in range(700)], []

    def counted(df, path=None):
        out = materialise(df, path)
        most.append((out.count(), out.columns))
        return out

    materialise = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", counted)
    want, got = brute(rows), found(spark, rows)
    # up to a row for each leaf and choice
    choices = len(simhash.bit_choices(len(rows), 48)[2])
    assert max(n for n, columns in most if "tile_a" in columns) <= 700 * choices
    assert 1 < len(set(want.values())) and all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_each_candidate_is_tested_in_one_choice():
    rng = np.random.default_rng(2)
    width, budget, orders = simhash.bit_choices(5000, 48)
    masks = simhash._choice_masks(orders, width)
    differ = np.packbits(rng.random((4000, 256)) < rng.choice([0.02, 0.1, 0.17], (4000, 1)), axis=1, bitorder="little").view(np.uint64)
    bits = np.unpackbits(differ.view(np.uint8), axis=1, bitorder="little")
    met = np.array([(bits[:, o[:width]].sum(axis=1) == 0) & (bits[:, o].sum(axis=1) <= budget) for o in orders])
    before = np.array([simhash._met_before(differ, np.full(len(differ), t), masks, budget) for t in range(len(orders))])
    assert ((met & ~before).sum(axis=0) == met.any(axis=0)).all() and 0 < met.any(axis=0).sum() < len(differ)


def test_all_links_by_products_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(50, 61), replace=False), rng.integers(1 << 41, 1 << 42, rng.integers(0, 8))])) for _ in range(90)]
    sets += [np.empty(0, np.int64), np.empty(0, np.int64)]
    n = len(sets)
    wide, known, right = np.zeros((n, 4), np.uint64), np.arange(n), np.arange(n) % 2 == 1
    for side in (None, right):
        pairs = [(i, j) for i in range(n) for j in range(n) if (i < j if side is None else not side[i] and side[j])]
        alike_ = [(i, j) for i, j in pairs if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
        want = components(range(n), alike_)
        for few in (0, 10**6):
            monkeypatch.setattr(simhash, "FEW_PAIRS", few)
            root = simhash.all_links(sets, wide, known, side, 0, (0, 64, 256), simhash._choice_masks([], 0), 0.8)
            assert dict(enumerate(root.tolist())) == want
        assert 20 < len(alike_) < 0.9 * len(pairs) and len(set(want.values())) > 1
