"""SimHash near-duplicates: 64-bit fingerprints joined by a binary trie.

Fingerprints.  Texts are lower-cased in A-Z, cut into words at ASCII white
space, and each run of ``shingle`` words (repeats included; a shorter text is
one run) is hashed with XXH64, seed 42.  A bit of the fingerprint is 1 if it is
set in more than half of the hashes.  A null or wordless text has fingerprint 0.

Join.  All pairs of different fingerprints with at most ``budget`` differing
bits are linked.  The bits are dealt into blocks; two such fingerprints agree
on all bits of some choice of ``blocks - budget`` blocks.  For every choice the
chosen blocks go to the front, and each value of them is the root of a binary
trie over the remaining bits.  The trie is joined with itself: pairs of nodes
are followed together from the root, differing bits add up, and a pair is
dropped once they exceed the budget.  No choice is left out, so no link is.

Large tries are cut into tiles (runs of leaves in trie order); two tiles of one
trie are joined from the deepest node above each, so the budget prunes whole
tiles.  Within a tile only a spanning forest of the links is returned: what
counts is which fingerprints connect.

Similarity.  ``similar_documents`` links texts by the similarity of their
shingle sets (five words, 0.8) through the same join.  At 0.8 some 15 % of a
fingerprint's bits differ, too many for blocks that must agree, so fingerprints
are 256 bits wide, 48 of them may differ, and a number of random choices of 64
bits takes the place of the block choices.  The choice's first bits are the
root of a trie, the others are joined below it within an error budget, and what
is left must keep the whole fingerprint's.  The number of choices grows with
the rows so that pairs at the very edge are met with ``RECALL``, nearer ones
almost surely.  With ``exact`` the keys are the shingles of each text's prefix
in order of rarity instead: of two texts as alike as that one shares a key, so
no link is missed.

Tests.  A tile yields the nearest spanning forest of its candidates, whose edges
are then held against the shingle sets.  Of a tile with a refused edge whose ends
nothing else connects, the leaves with a candidate in another component are sent
once more, with their sets, and all these candidates are tested in the tile's
task: a refused edge never hides another pair, and no pair is a row of a table.
A pair that several bit choices bring together is tested in the first of them.
Tiles whose leaves are one component already don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, partitions_for, text_or_empty, tile_pairs, tiles

BITS = 64
#: Node pairs of at most so many leaf pairs are compared leaf by leaf.
LEAF_PAIRS = 8
#: Leaf or node pairs followed at once; bounds a task's memory.
FRONTIER = 1 << 20
#: Up to so many pairs of a tile are tested one by one, more of them by products of blocks.
FEW_PAIRS = 2000
#: Words of 64 bits in the fingerprints that ``similar_documents`` compares.
WIDE = 4
#: Chance that the bit choices bring a pair together that differs in all bits allowed.
RECALL = 0.95
_WIDE_FIELDS = [f"f{i}" for i in range(WIDE)]
_NODE = "struct<" + ", ".join(f"{n}: long" for n in ("rep", *_WIDE_FIELDS)) + ">"
_MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    stop = ends[shingle - 1 :].tolist()
    start = [0, *(ends[: n - shingle] + 1).tolist()]
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(start, stop, strict=True)], np.uint64, len(stop))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of the bits set in more than half of the rows of ``hashes`` (rows x words)."""
    ones = np.zeros(BITS * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 1 << 14):
        block = np.ascontiguousarray(hashes[i : i + (1 << 14)])
        ones += np.unpackbits(block.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    h = shingle_hashes(text, shingle, seed)
    return int(majority(h.reshape(-1, 1))[0]) if len(h) else 0


def wide_fingerprint(text: str | None, shingle: int = 5) -> tuple[np.ndarray, int]:
    """256 bits by majority over the set of shingles, and a hash of that set; zeros without words."""
    h = np.unique(shingle_hashes(text, shingle))
    if not len(h):
        return np.zeros(WIDE, np.uint64), 0
    x = h[:, None] * _MIXERS
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return majority(x), xxhash.xxh64_intdigest(h.tobytes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col)).mapInArrow(run, "id long, fp long")


def block_choices(rows: int, budget: int) -> list[list[int]]:
    """Bit orders, one for each choice of key blocks, and the key's width first.

    More rows take more, narrower blocks and thereby longer keys, so that a
    trie keeps a few dozen leaves; every choice is made, whatever the number.
    """
    want = max(0, rows.bit_length() - 5)
    for blocks in range(budget + 2, BITS // 2):
        width = BITS * (blocks - budget) // blocks
        if width >= want or blocks == budget + 5:
            break
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    orders = []
    for chosen in combinations(range(blocks), blocks - budget):
        key = [b for c in chosen for b in range(cuts[c], cuts[c + 1])]
        orders.append([len(key), *key, *(b for b in range(BITS) if b not in set(key))])
    return orders


def _permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits in the given order, the first one highest."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, order], axis=1, bitorder="big").copy().view(">u8").reshape(-1).astype(np.uint64)


def trie_join(p: np.ndarray, q: np.ndarray | None, nodes: np.ndarray, depth: np.ndarray, spent: np.ndarray, budget: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Follow pairs of nodes together; yield indexes (into p, into q) of linked leaves.

    ``p`` and ``q`` are sorted within each trie; a node is a range of rows.
    ``nodes`` has columns a_lo, a_hi, b_lo, b_hi; without ``q`` b is in p too
    and a pair (a, a) stands for a node with itself.  ``depth``: bits already
    followed, ``spent``: bits that differ so far.  ``known``: components of the
    leaves of p and q; pairs of nodes that hold only one and the same are left.
    """
    same = q is None
    changes = [np.concatenate([[0], np.cumsum(c[1:] != c[:-1])]) for c in known] if known else []
    q = p if same else q
    stack = [(nodes.astype(np.int64), depth.astype(np.int64), spent.astype(np.int64))]
    while stack:
        n, d, s = stack.pop()
        if len(n) > FRONTIER // 4:
            half = len(n) // 2
            stack += [(n[:half], d[:half], s[:half]), (n[half:], d[half:], s[half:])]
            continue
        if known:
            alike = known[0][n[:, 0]] == known[1][n[:, 2]]
            for change, lo, hi in ((changes[0], n[:, 0], n[:, 1]), (changes[1], n[:, 2], n[:, 3])):
                alike &= change[lo] == change[hi - 1]
            n, d, s = n[~alike], d[~alike], s[~alike]
        size_a, size_b = n[:, 1] - n[:, 0], n[:, 3] - n[:, 2]
        self_pair = same & (n[:, 0] == n[:, 2]) & (n[:, 1] == n[:, 3])
        small = (size_a * size_b <= LEAF_PAIRS) | (d >= BITS)
        if small.any():
            yield from _leaves(p, q, n[small], self_pair[small], budget)
        n, d, s, self_pair = n[~small], d[~small], s[~small], self_pair[~small]
        if not len(n):
            continue
        bit = (np.uint64(BITS - 1) - d.astype(np.uint64)).astype(np.uint64)
        mid_a, mid_b = _split(p, n[:, 0], n[:, 1], bit), _split(q, n[:, 2], n[:, 3], bit)
        a0, a1 = np.stack([n[:, 0], mid_a], 1), np.stack([mid_a, n[:, 1]], 1)
        b0, b1 = np.stack([n[:, 2], mid_b], 1), np.stack([mid_b, n[:, 3]], 1)
        kids = [(a0, b0, 0, None), (a1, b1, 0, None), (a0, b1, 1, None), (a1, b0, 1, ~self_pair)]
        out_n, out_d, out_s = [], [], []
        for a, b, more, keep in kids:
            ok = (a[:, 1] > a[:, 0]) & (b[:, 1] > b[:, 0]) & (s + more <= budget)
            if keep is not None:
                ok &= keep
            alone = same & (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1]) & (a[:, 1] - a[:, 0] == 1)
            ok &= ~alone
            out_n.append(np.concatenate([a[ok], b[ok]], 1))
            out_d.append(d[ok] + 1)
            out_s.append(s[ok] + more)
        stack.append((np.concatenate(out_n), np.concatenate(out_d), np.concatenate(out_s)))


def _split(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First row of each node whose next bit is 1: bisection, all nodes at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (p[np.minimum(mid, len(p) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaves(p, q, n, self_pair, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows_a, rows_b = n[:, 1] - n[:, 0], n[:, 3] - n[:, 2]
    count = rows_a * rows_b
    stops = np.cumsum(count)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + FRONTIER, "right")))
        c = count[at:end]
        pair = np.repeat(np.arange(at, end), c)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c)
        i, j = n[pair, 0] + k // rows_b[pair], n[pair, 2] + k % rows_b[pair]
        ok = ~(self_pair[pair] & (i >= j))
        i, j = i[ok], j[ok]
        near = np.bitwise_count(p[i] ^ q[j]) <= budget
        yield i[near], j[near]
        at = end


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index connected to each of n indexes."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (step := root[root]).tobytes() != root.tobytes():
                root = step
    return root


def _tile_links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = np.diff(b.column("orders").offsets.to_numpy())
            fps = b.column("orders").flatten().to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            ids = b.column("payloads").flatten().to_numpy()
            ends = np.cumsum(lens)
            lo = ends - lens
            nodes = np.stack([lo, ends, lo, ends], 1)
            width = b.column("width").to_numpy().astype(np.int64)
            root = spanning(len(fps), trie_join(fps, None, nodes, width, np.zeros(len(nodes)), budget))
            own = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    return run


def _pair_links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                one = b.slice(r, 1)
                p, q = (np.array(one.column(c)[0].values.to_numpy(), np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in ("orders", "orders_b"))
                ia, ib = (one.column(c)[0].values.to_numpy() for c in ("payloads", "payloads_b"))
                fixed = min(_common(p), _common(q))
                spent = int(np.bitwise_count((p[0] ^ q[0]) >> np.uint64(BITS - fixed))) if fixed else 0
                if spent > budget:
                    continue
                node = np.array([[0, len(p), 0, len(q)]])
                found = ((i, j + len(p)) for i, j in trie_join(p, q, node, np.array([fixed]), np.array([spent]), budget))
                root = spanning(len(p) + len(q), found)
                ids = np.concatenate([ia, ib])
                own = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    return run


def _common(sorted_fps: np.ndarray) -> int:
    """Leading bits that all rows of a tile share."""
    return BITS - int(sorted_fps[0] ^ sorted_fps[-1]).bit_length()


def _meeting(cut: DataFrame, key: list[str], budget: int) -> DataFrame:
    """(tile_a, tile_b) of a key's tiles whose common leading bits leave room for a link.

    Only first and last fingerprints are compared; no others are moved.
    """
    ends = cut.where(~F.col("whole")).select(*key, "tile_id", F.get("orders", F.lit(0)).alias("low"), F.element_at("orders", -1).alias("high"))
    # bits behind those that all rows of the tile share
    ends = materialise(ends.select(*key, "tile_id", "low", F.expr("CASE WHEN low = high THEN 0 ELSE length(bin(low ^ high)) END").alias("free")))
    a, b = (ends.withColumnsRenamed({"tile_id": f"tile_{s}", "low": f"low_{s}", "free": f"free_{s}"}) for s in "ab")
    spent = F.expr("CASE WHEN greatest(free_a, free_b) = 64 THEN 0 ELSE bit_count(shiftrightunsigned(low_a ^ low_b, greatest(free_a, free_b))) END")
    return a.join(b, key).where("tile_a < tile_b").where(spent <= budget).select("tile_a", "tile_b")


def links(classes: DataFrame, budget: int = 4) -> DataFrame:
    """Edges (a, b) between ``rep`` ids that connect just what the links connect.

    ``classes``: (fp long, rep long), each fp once.
    """
    spark = classes.sparkSession
    rows = classes.count()
    orders = block_choices(rows, budget)

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array(b.column(0).to_numpy(), np.int64).view(np.uint64)
            for t, (width, *order) in enumerate(orders):
                p = _permuted(fp, order)
                n = len(fp)
                signed = (p ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array((p >> np.uint64(BITS - width)).astype(np.int64)), pa.array(np.full(n, width, np.int32)), pa.array(signed), b.column(1)], names=["choice", "key", "width", "p", "rep"])

    spread = classes.select("fp", "rep").mapInArrow(permute, "choice int, key long, width int, p long, rep long")
    spread = materialise(spread)
    cut = materialise(tiles(spread, ["choice", "key", "width"], "p", "rep", partitions_for(spark, rows * len(orders), 500_000)))
    within = cut.where("n > 1").select("width", "orders", "payloads").mapInArrow(_tile_links(budget), "a long, b long")
    pairs = materialise(_meeting(cut, ["choice", "key", "width"], budget))
    left = cut.select(F.col("tile_id").alias("tile_a"), "orders", "payloads")
    right = cut.select(F.col("tile_id").alias("tile_b"), F.col("orders").alias("orders_b"), F.col("payloads").alias("payloads_b"))
    across = pairs.join(left, "tile_a").join(right, "tile_b").mapInArrow(_pair_links(budget), "a long, b long")
    return within.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(id, fp, component) of every row; component is the least id reachable by links.

    Equal fingerprints are linked.  Null ids are kept as rows of their own
    fingerprint's component but never are a component's id, unless all of its
    ids are null (then null).  Repeated rows come back as often as they occur;
    an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(links(classes.where("rep is not null"), budget))
    named = materialise(classes.join(roots, classes.rep == roots.id, "left").select("fp", F.coalesce("root", "rep").alias("component")))
    return prints.join(named, "fp", "left").select("id", "fp", "component")


def bit_choices(rows: int, most: int, recall: float = RECALL) -> tuple[int, int, list[list[int]]]:
    """(bits of the key, error budget below it, choices of 64 of the wide bits).

    A key leaves a trie some hundred leaves; the budget is passed by one in a
    hundred pairs that differ in ``most`` bits of the whole; the number of
    choices brings such a pair together with chance ``recall``.
    """
    width = min(BITS // 2, max(6, rows.bit_length() - 7))
    share, rest = most / (BITS * WIDE), BITS - width
    budget = min(rest, int(np.ceil(rest * share + 2.33 * np.sqrt(rest * share * (1 - share)))))
    number = int(np.ceil(np.log(1 - recall) / np.log1p(-0.99 * (1 - share) ** width)))
    rng = np.random.default_rng(rows.bit_length())
    return width, budget, [rng.permutation(BITS * WIDE)[:BITS].tolist() for _ in range(number)]


def _leaf_columns(tile: pa.RecordBatch, suffix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted bits, representatives and wide fingerprints of all leaves of a batch of tiles."""
    p = tile.column("orders" + suffix).flatten().to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    node = tile.column("payloads" + suffix).flatten()
    wide = np.stack([node.field(f).to_numpy().view(np.uint64) for f in _WIDE_FIELDS], 1)
    return p, node.field("rep").to_numpy(), wide


def _kruskal(order: np.ndarray, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of the edges, taken in ``order``, those of a spanning forest over the leaves' labels."""
    nodes, ends = np.unique(np.concatenate([label[i[order]], label[j[order]]]), return_inverse=True)
    u, v = ends[: len(order)], ends[len(order) :]
    root, taken = np.arange(len(nodes)), []
    step = max(4096, len(order) // 32)
    for at in range(0, len(order), step):
        part = np.flatnonzero(root[u[at : at + step]] != root[v[at : at + step]]) + at
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for e, x, y in zip(part.tolist(), root[u[part]].tolist(), root[v[part]].tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[x] = y
                taken.append(e)
        if up:
            move = np.arange(len(nodes))
            move[list(up)] = [top(x) for x in up]
            root = move[root]
    return np.array(taken, np.int64)


def _forest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Edges of the nearest spanning forest."""
    order = np.argsort(apart, kind="stable")
    keep = order[_kruskal(order, i, j, label)]
    return [i[keep], j[keep], apart[keep]]


def nearest_forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the minimum spanning forest of the pairs whose wide fingerprints differ in at most ``most`` bits.

    ``pairs`` are indexes into ``a`` and ``b``; those into ``b`` come back
    raised by len(a) where b is another tile's.  ``label``: which leaves count
    as one node.  At most some two million pairs are held at once, or the
    forest where that is more.
    """
    base = 0 if a is b else len(a)
    label = np.arange(base + len(b)) if label is None else label
    held, size, room = [[np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]], 0, FRONTIER
    for i, j in pairs:
        apart = np.bitwise_count(a[i] ^ b[j]).sum(axis=1)
        near = apart <= most
        held.append([i[near], j[near] + base, apart[near]])
        size += int(near.sum())
        if size > room:
            held = [_forest(*(np.concatenate(c) for c in zip(*held, strict=True)), label)]
            size = len(held[0][0])
            room = max(FRONTIER, 2 * size)
    i, j, _ = _forest(*(np.concatenate(c) for c in zip(*held, strict=True)), label)
    return i, j


def _choice_masks(orders: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each choice's key bits, and of all its bits."""
    masks = np.zeros((2, len(orders), WIDE), np.uint64)
    for t, order in enumerate(orders):
        for at, bit in enumerate(order):
            masks[int(at >= width), t, bit // BITS] |= np.uint64(1) << np.uint64(bit % BITS)
    return masks[0], masks[0] | masks[1]


def _met_before(differ: np.ndarray, choice: np.ndarray, masks: tuple[np.ndarray, np.ndarray], budget: int) -> np.ndarray:
    """Whether a choice before its own brings a pair together whose fingerprints differ in the bits ``differ``."""
    met = np.zeros(len(differ), bool)
    for t in range(min(len(masks[0]), int(choice.max(initial=0)))):
        rest = np.flatnonzero(~met & (choice > t))
        rest = rest[~(differ[rest] & masks[0][t]).any(axis=1)]
        met[rest[np.bitwise_count(differ[rest] & masks[1][t]).sum(axis=1) <= budget]] = True
    return met


def _candidates(width: int, budget: int, most: int, masks: tuple[np.ndarray, np.ndarray], leaves: bool):
    """Edges to test: of each tile with itself, or of each row's two tiles.

    Pairs in one component (``known``) are left out.  With ``leaves``: not the
    forest's edges, but each leaf that has a candidate no earlier choice meets.
    """

    def edges(b: pa.RecordBatch) -> pa.RecordBatch:
        two = "orders_b" in b.schema.names
        p, ids, wide = _leaf_columns(b)
        known = b.column("known").flatten().to_numpy()
        ends = np.cumsum(np.diff(b.column("orders").offsets.to_numpy()))
        lo = np.concatenate([[0], ends[:-1]])
        tile = np.repeat(np.arange(len(b)), ends - lo)
        ids_b, wide_b, known_b = ids, wide, known
        if two:
            q, ids_b, wide_b = _leaf_columns(b, "_b")
            known_b = b.column("known_b").flatten().to_numpy()
            fixed = max(width, min(_common(p), _common(q)))
            spent = int(np.bitwise_count((p[0] ^ q[0]) >> np.uint64(BITS - fixed))) if fixed else 0
            node = np.array([[0, len(p), 0, len(q)]])
            found = trie_join(p, q, node, np.array([fixed]), np.array([spent]), budget, (known, known_b)) if spent <= budget else iter(())
            leaf_ids, leaf_known, leaf_wide, leaf_tile = np.concatenate([ids, ids_b]), np.concatenate([known, known_b]), np.concatenate([wide, wide_b]), np.zeros(len(p) + len(q), np.int64)
        else:
            nodes = np.stack([lo, ends, lo, ends], 1)
            found = trie_join(p, None, nodes, np.full(len(nodes), width), np.zeros(len(nodes)), budget, (known, known))
            leaf_ids, leaf_known, leaf_wide, leaf_tile = ids, known, wide, tile
        still_open = ((i[ok], j[ok]) for i, j in found for ok in [known[i] != known_b[j]])
        if leaves:
            base, used = len(p) if two else 0, np.zeros(len(leaf_ids), bool)
            choice = b.column("choice").to_numpy()[leaf_tile]
            for i, j in still_open:
                differ = wide[i] ^ wide_b[j]
                near = np.flatnonzero(np.bitwise_count(differ).sum(axis=1) <= most)
                near = near[~_met_before(differ[near], choice[i[near]], masks, budget)]
                used[i[near]] = used[j[near] + base] = True
            at = np.flatnonzero(used)
            of, words = pa.array(leaf_tile[at]), leaf_wide[at].view(np.int64)
            right = pa.array(at >= len(p)) if two else pa.nulls(len(at), pa.bool_())
            columns = [*(b.column(c).take(of) for c in ("tile_a", "tile_b", "choice")), right, pa.array(leaf_ids[at]), pa.array(leaf_known[at]), *(pa.array(words[:, k]) for k in range(WIDE))]
            return pa.RecordBatch.from_arrays(columns, names=["tile_a", "tile_b", "choice", "right", "id", "known", *_WIDE_FIELDS])
        # a component is a node of its own in each of the batch's tiles
        values = np.unique(leaf_known, return_inverse=True)[1]
        label = leaf_tile * (values.max(initial=0) + 1) + values
        i, j = nearest_forest(still_open, wide, wide_b, most, label)
        of, x, y = pa.array(leaf_tile[i]), leaf_ids[i], leaf_ids[j]
        return pa.RecordBatch.from_arrays([b.column("tile_a").take(of), b.column("tile_b").take(of), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["tile_a", "tile_b", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "orders_b" in b.schema.names:
                yield from (edges(b.slice(r, 1)) for r in range(len(b)))
            else:
                yield edges(b)

    return run


def common_shingles(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the sets i and j have in common, pair by pair."""
    if len(i) <= FEW_PAIRS:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[word] > 1
    owner, word = owner[shared], (np.cumsum(counts > 1) - 1)[word[shared]]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    both = np.zeros((len(rows), len(cols)), np.float64)
    step = max(256, (1 << 22) // len(sets))
    for low in range(0, int(word.max(initial=-1)) + 1, step):
        part = slice(*np.searchsorted(word, [low, low + step]))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[part], word[part] - low] = 1
        both += has[rows] @ has[cols].T
    return both[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def all_links(sets: list[np.ndarray], wide: np.ndarray, known: np.ndarray, right: np.ndarray | None, choice: int, limits: tuple[int, int, int], masks: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Index of the least leaf each leaf connects to, once all candidates are tested that no earlier choice meets.

    ``right``: which leaves are the second tile's; none where there is one tile.
    """
    n, (_, budget, most) = len(sets), limits
    sizes = np.array([len(s) for s in sets])

    def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, FRONTIER // max(1, n))
        for low in range(0, n, step):
            own = np.arange(low, min(low + step, n))
            may = known[own][:, None] != known[None, :]
            may &= (own[:, None] < np.arange(n)[None, :]) if right is None else (~right[own][:, None] & right[None, :])
            i, j = np.nonzero(may)
            i = own[i]
            # sets of too different sizes can't be alike
            ok = np.minimum(sizes[i], sizes[j]) >= np.maximum(sizes[i], sizes[j]) * similarity
            i, j = i[ok], j[ok]
            differ = wide[i] ^ wide[j]
            near = np.flatnonzero(np.bitwise_count(differ).sum(axis=1) <= most)
            near = near[~_met_before(differ[near], np.full(len(near), choice), masks, budget)]
            i, j = i[near], j[near]
            if len(i):
                both = common_shingles(sets, i, j)
                good = both >= (sizes[i] + sizes[j] - both) * similarity
                yield i[good], j[good]

    return spanning(n, linked())


def _test_all(limits: tuple[int, int, int], masks: tuple[np.ndarray, np.ndarray], similarity: float):
    """Rows come sorted by tiles; each pair of tiles' leaves are tested together, and a spanning forest of the links comes back."""

    def settle(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held)
        sets = [np.array(s.values.to_numpy()) for b in held for s in b.column("shingles")]
        wide = np.stack([t[f].to_numpy().view(np.uint64) for f in _WIDE_FIELDS], 1)
        right = None if t["right"].null_count else t["right"].to_numpy()
        ids = t["id"].to_numpy()
        root = all_links(sets, wide, t["known"].to_numpy(), right, t["choice"][0].as_py(), limits, masks, similarity)
        own = np.flatnonzero(root != np.arange(len(ids)))
        return ids[own], ids[root[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def links(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b"])

        for b in batches:
            tiles_of = np.stack([b.column(c).to_numpy() for c in ("tile_a", "tile_b")], 1)
            starts = [0, *(np.flatnonzero((tiles_of[1:] != tiles_of[:-1]).any(axis=1)) + 1).tolist()] if len(b) else []
            for at, end in zip(starts, [*starts[1:], len(b)]):
                key = tuple(tiles_of[at].tolist())
                if key != now and held:
                    yield links(settle(held))
                    held = []
                now = key
                held.append(b.slice(at, end - at))
        if held:
            yield links(settle(held))

    return run


def shingle_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(end, shingles): the set of shingles of the texts of ``ids`` (end); of an id with several texts, of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["end", "shingles"])

    texts = docs.join(ids, docs.id == ids.end, "left_semi").select("id", "text")
    return materialise(texts.mapInArrow(run, "end long, shingles array<long>").distinct())


def tested(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, good): whether the ids' sets of shingles are ``similarity`` alike or more."""
    a, b = (sets.select(F.col("end").alias(n), F.col("shingles").alias(f"set_{n}")) for n in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    whole = F.size("set_a") + F.size("set_b") - both
    # of an id with several texts any may do
    found = edges.join(a, "a").join(b, "b").groupBy("a", "b").agg(F.max(both >= whole * similarity).alias("good"))
    return materialise(found)


def _with_leaves(tasks: DataFrame, cut: DataFrame, roots: DataFrame) -> DataFrame:
    """The tasks' tiles with their leaves and these leaves' components; those of ``tile_b``, where it is another tile, as ``_b``."""
    known = _known(cut, roots, tasks).select("tile_id", "known")
    whole = cut.select("tile_id", "choice", "orders", "payloads").join(known, "tile_id")
    alone, two = tasks.where("tile_a = tile_b"), tasks.where("tile_a <> tile_b")
    if two.isEmpty():
        return alone.join(whole.withColumnRenamed("tile_id", "tile_a"), "tile_a")
    right = whole.select(F.col("tile_id").alias("tile_b"), *(F.col(c).alias(f"{c}_b") for c in ("orders", "payloads", "known")))
    return two.join(whole.withColumnRenamed("tile_id", "tile_a"), "tile_a").join(right, "tile_b")


def _settle(tasks: DataFrame | None, cut: DataFrame, roots: DataFrame | None, docs: DataFrame, limits: tuple[int, int, int], masks: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """(id, root) once all candidates of the tasks are refused or connected.

    ``tasks``: tile_a, tile_b, different ones in all rows; none: each tile with
    itself; ``roots``: the components before, none to begin with.
    """
    if tasks is None:
        own = F.col("tile_id")
        rows = cut.where("n > 1").select(own.alias("tile_a"), own.alias("tile_b"), "choice", "orders", "payloads", F.col("payloads.rep").alias("known"))
    else:
        rows = _with_leaves(tasks, cut, roots)
    edges = materialise(rows.mapInArrow(_candidates(*limits, masks, False), "tile_a long, tile_b long, a long, b long"))
    sets = shingle_sets(edges.select(F.explode(F.array("a", "b")).alias("end")).distinct(), docs, shingle)
    roots = _united(tested(edges.select("a", "b").distinct(), sets, similarity).where("good").select("a", "b"), roots)
    # a tile without a refused edge, or with all of their ends connected, has no candidate left
    root_a, root_b = (roots.select(F.col("id").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab")
    refused = edges.join(root_a, "a", "left").join(root_b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    tasks = materialise(refused.select("tile_a", "tile_b").distinct())
    if tasks.isEmpty():
        return roots
    fields = ", ".join(f"{f} long" for f in _WIDE_FIELDS)
    leaves = materialise(_with_leaves(tasks, cut, roots).mapInArrow(_candidates(*limits, masks, True), f"tile_a long, tile_b long, choice int, right boolean, id long, known long, {fields}"))
    new = materialise(leaves.select(F.col("id").alias("end")).distinct().join(sets, "end", "left_anti"))
    if not new.isEmpty():
        sets = sets.unionByName(shingle_sets(new, docs, shingle))
    tile = ["tile_a", "tile_b"]
    parts = partitions_for(docs.sparkSession, leaves.count(), 10_000)
    dealt = leaves.join(sets, leaves.id == sets.end).drop("end").repartition(parts, *tile).sortWithinPartitions(*tile)
    return _united(materialise(dealt.mapInArrow(_test_all(limits, masks, similarity), "a long, b long")), roots)


def _united(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(id, root) of the components that the links make of those before."""
    if roots is not None:
        links = links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return materialise(connected_components(links))


def _known(cut: DataFrame, roots: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(tile_id, known, least, most): the components of each tile's leaves, in their order."""
    leaves = cut
    if tasks is not None:
        used = tasks.select(F.explode(F.array("tile_a", "tile_b")).alias("tile_id")).distinct()
        leaves = cut.join(used, "tile_id", "left_semi")
    leaves = leaves.select("tile_id", F.posexplode("payloads.rep").alias("at", "id"))
    known = leaves.join(roots, "id", "left").select("tile_id", "at", F.coalesce("root", "id").alias("root"))
    return materialise(known.groupBy("tile_id").agg(F.sort_array(F.collect_list(F.struct("at", "root")))["root"].alias("known"), F.min("root").alias("least"), F.max("root").alias("most")))


def rare_shingles(classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(choice, key, p, node): each class under the shingles of its prefix that others have too.

    A prefix is so long that two sets as alike as ``similarity`` share one of
    its shingles, the rarest coming first.
    """
    sets = shingle_sets(classes.select(F.col("rep").alias("end")), docs, shingle)
    each = sets.select("end", F.xxhash64("shingles").alias("of"), F.explode("shingles").alias("key"))
    counts = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    ordered = each.join(counts, "key").groupBy("end", "of").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    size = F.size("keys")
    prefix = ordered.select("end", F.explode(F.slice("keys", F.lit(1), size - F.ceil(size * similarity - 1e-9).cast("int") + 1)).alias("k")).where("k.n > 1").select("end", "k.key").distinct()
    node = F.struct("rep", *_WIDE_FIELDS).alias("node")
    return classes.join(prefix, classes.rep == prefix.end).select(F.lit(0).alias("choice"), "key", F.col("f0").alias("p"), node)


def similar_roots(classes: DataFrame, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 48, exact: bool = False) -> DataFrame:
    """(id, root) of the classes that connect to others: root is the least ``rep`` reachable.

    ``classes``: rep long and the wide fingerprint's words; ``docs``: id, text.
    """
    spark = classes.sparkSession
    rows = classes.count()
    if exact:
        spread = materialise(rare_shingles(classes, docs, shingle, similarity))
        keyed, limits, masks = spread.count(), (0, BITS, BITS * WIDE), _choice_masks([], 0)
    else:
        width, budget, choices = bit_choices(rows, most)
        keyed, limits, masks = rows * len(choices), (width, budget, most), _choice_masks(choices, width)

        def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = np.stack([b.column(f).to_numpy() for f in _WIDE_FIELDS], 1)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
                node = pa.StructArray.from_arrays([b.column(c) for c in ("rep", *_WIDE_FIELDS)], names=["rep", *_WIDE_FIELDS])
                for t, order in enumerate(choices):
                    p = np.packbits(bits[:, order], axis=1, bitorder="big").copy().view(">u8").reshape(-1).astype(np.uint64)
                    signed = (p ^ np.uint64(1 << 63)).view(np.int64)
                    key = (p >> np.uint64(BITS - width)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t, np.int32)), pa.array(key), pa.array(signed), node], names=["choice", "key", "p", "node"])

        spread = classes.select("rep", *_WIDE_FIELDS).mapInArrow(permute, f"choice int, key long, p long, node {_NODE}")
    cut = materialise(tiles(spread, ["choice", "key"], "p", "node", partitions_for(spark, keyed, 500_000)))
    roots = _settle(None, cut, None, docs, limits, masks, shingle, similarity)
    # tiles of one key meet unless all their leaves are one component by now
    open_tiles = cut.where(~F.col("whole"))
    known = _known(open_tiles, roots)

    def side(name: str) -> DataFrame:
        return known.select(F.col("tile_id").alias(f"tile_{name}"), F.struct("least", "most").alias(f"range_{name}"))

    meet = tile_pairs(cut, ["choice", "key"]).select("tile_a", "tile_b").join(side("a"), "tile_a").join(side("b"), "tile_b")
    meet = materialise(meet.where(~((F.col("range_a") == F.col("range_b")) & (F.col("range_a.least") == F.col("range_a.most")))).select("tile_a", "tile_b"))
    return roots if meet.isEmpty() else _settle(meet, cut, roots, docs, limits, masks, shingle, similarity)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = 48, exact: bool = False) -> DataFrame:
    """(id, component) of every row: documents whose shingle sets are ``similarity`` alike or more connect.

    Candidates are texts whose 256-bit fingerprints differ in at most ``most``
    bits: at a similarity of 0.8 they differ in 39 on average, with a standard
    deviation of 6.  All links are held against the sets themselves, so they are
    right; a link may be missed at the edge, where bits differ more than the
    similarity says.  With ``exact`` candidates are the texts that share a rare
    shingle, and none is missed; that takes a row for each shingle.  Texts with
    one set of shingles always link; null and wordless ones have the empty set.  Null ids never are a component's id,
    unless all of its ids are null (then null).  Repeated rows come back as
    often as they occur, and an id with several texts connects them; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide_fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            words = np.array([w for w, _ in found], np.uint64).reshape(-1, WIDE).view(np.int64)
            sets = np.array([h for _, h in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(words[:, i]) for i in range(WIDE)), pa.array(sets)], names=["id", *_WIDE_FIELDS, "shingles"])

    fields = ", ".join(f"{f} long" for f in (*_WIDE_FIELDS, "shingles"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    prints = materialise(docs.mapInArrow(run, f"id long, {fields}"))
    same = [*_WIDE_FIELDS, "shingles"]
    classes = materialise(prints.groupBy(*same).agg(F.min("id").alias("rep")))
    roots = similar_roots(classes.where("rep is not null"), docs, shingle, similarity, most, exact)
    named = materialise(classes.join(roots, classes.rep == roots.id, "left").select(*same, F.coalesce("root", "rep").alias("component")))
    return prints.join(named, same, "left").select("id", "component")
