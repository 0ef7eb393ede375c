"""Parts that need no Spark session, against plain versions."""

import functools
import itertools

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textshield.llm import ledger, packing, records, repeats, simhash, toxicity
from textshield.llm.tokenise import WordTokenizer
from textshield.llm.wordtrie import TrieTokenizer

ODD = ["", "<|endoftext|>", "a<|endoftext|> b <|startoftext|><|endoftext|>c  \n\n d", "it's  we'll\t\tx  y'S", "\x1c\x1d x\x85y", "½ ²³ x", "日本語テキスト 123", "á é é", "\U0001f600 emoji", "   ", "ſ K ǅ", "ΑΣ ΣΑΣ όσος İstanbul", "मनीष है", "don't!!! ... --- ###", "a" * 3000, "trailing ", " lead", "two\nlines, end.", "\nfirst", "x\n\ny", "a\tb c\t d \te", "word,  two", "É,é ça: 12,", "x\x85 y", "one.\nTwo! three?"]


@pytest.fixture(scope="module")
def byte_json():
    return open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def trie():
    return TrieTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_crc32c():
    def slow(d):
        c = 0xFFFFFFFF
        for x in d:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    data = [bytes(range(n % 256)) * (n // 100 + 1) for n in (0, 1, 2, 255, 511, 700)] + [b"123456789"]
    assert records.crc32c(data).tolist() == [slow(d) for d in data] and slow(b"123456789") == 0xE3069283


def test_frames_roundtrip_and_damage():
    payloads = [b"x" * n for n in (1, 5, 600)]
    data = b"".join(records.frame([payloads[0], b"", payloads[1], payloads[2]]))
    assert [p for _, p in records.unframe(data)] == payloads
    for at in (3, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))


def test_word_tokenizer(byte_json):
    want = [e.ids for e in Tokenizer.from_str(byte_json).encode_batch(ODD, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in WordTokenizer(byte_json).encode_batch(ODD)] == want


def test_trie_tokenizer(trie):
    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [e.ids for e in ref.encode_batch(ODD, add_special_tokens=False)]
    assert trie.encode_batch(ODD) == want
    text = [ref.decode(x, skip_special_tokens=False) for x in want]
    assert [trie.decode(x) for x in want] == text
    assert trie.written_batch(ODD) == [(" ".join(map(str, x)), t) for x, t in zip(want, text)]


@functools.cache
def both():
    path = P.path("word_bpe_49k.json")
    return TrieTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
@example("þ\U000142a7")  # a letter that Python's Unicode version doesn't know
@example("\u1c89 \ua7cb\U0001f600 Straße")
def test_trie_tokenizer_on_any_text(text):
    trie, ref = both()
    text = text.encode("utf-8", "ignore").decode()
    assert trie.encode_batch([text])[0] == ref.encode(text, add_special_tokens=False).ids


@functools.cache
def both_bytes():
    path = P.path("byte_bpe_50k.json")
    return WordTokenizer(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aB1 \n\t.,é'\u3000", max_size=30)))
@example("a\U000142a7b \U000142a7")
def test_word_tokenizer_on_any_text(text):
    words, ref = both_bytes()
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(words.encode_batch([text])[0], words.dtype).tolist() == ref.encode(text, add_special_tokens=False).ids


def test_fingerprint():
    def plain(text):
        words = text.encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ["", "  \t", "One", "one two THREE", "a b c d", "a b c d e f a b c d e f g", "É é x y z w q"]:
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint(None) == 0


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    near = base[:300].copy()
    for _ in range(5):
        near ^= np.where(rng.random(300) < 0.8, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
    fp = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if bin(int(fp[i]) ^ int(fp[j])).count("1") <= 4}
    got = set()
    for width, *order in simhash.block_choices(len(fp), 4):
        p = simhash._permuted(fp, order)
        o = np.argsort(p)
        key = p[o] >> np.uint64(64 - width)
        lo = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        hi = np.r_[lo[1:], len(p)]
        for i, j in simhash.trie_join(p[o], None, np.stack([lo, hi, lo, hi], 1), np.full(len(lo), width), np.zeros(len(lo)), 4):
            got |= {tuple(sorted((int(o[a]), int(o[b])))) for a, b in zip(i, j)}
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_plan_is_a_packing(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=31)
    runs, made, fixed = packing.plan(counts)
    placed = []
    seen = np.zeros(31, int)
    for length, rank, n, first, offset in runs.tolist():
        assert rank == seen[length]
        seen[length] += n
        placed += [(first + k, offset, length) for k in range(n)]
    assert (seen == counts).all() and fixed <= made
    ends = {}
    for s, o, length in sorted(placed):
        assert o == ends.get(s, 0)
        ends[s] = o + length
    assert len(ends) == made and all(e <= 30 for e in ends.values())
    first_fit = []
    for x in sorted(lengths, reverse=True):
        i = next((i for i, r in enumerate(first_fit) if r >= x), None)
        if i is None:
            first_fit.append(30 - x)
        else:
            first_fit[i] -= x
    assert made <= len(first_fit) + 1


def plain_best_fit(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(size - x)
    return sorted(rooms)


def test_plan_fills_open_sequences_with_equal_pieces():
    counts = np.zeros(1025, int)
    counts[[600, 200]] = 1000, 2000
    assert packing.plan(counts)[1] == 1000 == len(plain_best_fit([600] * 1000 + [200] * 2000, 1024))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=8))
@example({35: 10, 12: 20})
def test_plan_is_best_fit_after_the_reduction(pieces):
    counts = np.zeros(61, int)
    counts[list(pieces)] = list(pieces.values())
    runs, made, fixed = packing.reduced_plan(counts)
    rooms, rest = np.full(made, 60), []
    for length, _, n, first, _ in runs.tolist():
        rooms[first : first + n] -= length
        rest += [length] * n if first >= fixed else []
    assert sorted(rooms[fixed:].tolist()) == plain_best_fit(rest, 60)


def fewest(lengths, size):
    """The least number of sequences, by trying every set that could hold the longest piece."""

    @functools.cache
    def best(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        found = len(rest)
        for n in range(min(len(others), 5) + 1):
            for pick in set(itertools.combinations(range(len(others)), n)):
                if first + sum(others[i] for i in pick) <= size:
                    found = min(found, 1 + best(tuple(x for i, x in enumerate(others) if i not in pick)))
        return found

    return best(tuple(sorted(lengths, reverse=True)))


def test_plan_is_never_worse_than_best_fit():
    rng = np.random.default_rng(6)
    for _ in range(1000):
        size = int(rng.integers(20, 120))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 60)))
        if rng.random() < 0.5:
            lengths = rng.choice(lengths[:6], len(lengths))
        counts = np.bincount(lengths, minlength=size + 1)
        assert packing.plan(counts)[1] <= len(plain_best_fit(lengths.tolist(), size))


def test_reduction_loses_no_optimum():
    rng = np.random.default_rng(7)
    triples = 0
    for _ in range(300):
        size = 30
        lengths = rng.integers(5, 20, 8).tolist()
        counts = np.bincount(lengths, minlength=size + 1)
        runs, _, fixed = packing.reduced_plan(counts)
        held = {}
        rest = []
        for length, _, n, first, _ in runs.tolist():
            for q in range(first, first + n):
                held.setdefault(q, []).append(length)
        for q, parts in held.items():
            rest += parts if q >= fixed else []
            triples += len(parts) == 3 and q < fixed
        assert fixed + fewest(rest, size) == fewest(lengths, size)
    assert triples


def test_secret_spans():
    text = 'éé password = "abcdefgh1" TOKEN:short12 api_key=ABCDEFGH. AKIAABCDEFGHIJKL ' + "0" * 31 + " " + "a" * 32
    spans = ledger.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("assign", 'password = "abcdefgh1'), ("assign", "api_key=ABCDEFGH."), ("access", "AKIAABCDEFGHIJKL"), ("hex", "a" * 32)]
    assert ledger.base_spans("\u017fecret: abcdefgh") == [] and ledger.base_spans("to\u212aen: abcdefgh") == []


def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(300)]
    bad = ["grumblefoul", "snarkvile", "hatewort"]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(vocab, 40))
        if i % 2:
            words[5:7] = rng.choice(bad, 2)
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = toxicity.fit(texts, labels)
    clean, toxic = " ".join(rng.choice(vocab, 40)), " ".join(list(rng.choice(vocab, 38)) + ["grumbblefoul", "snarkvlle"])
    low, high, none = toxicity.score_texts(model, [clean, toxic, None], {})
    assert high > 0.7 > low and 0 <= none <= 1
    assert toxicity.score_texts(toxicity.fit([], []), ["x"], {})[0] < 0.01


def brute_repeats(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    marks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                marks[i][p : p + length] = True
    return marks


def test_repeated_windows_and_phrases():
    rng = np.random.default_rng(2)
    a, b = rng.integers(97, 123, 900, dtype=np.uint8).tobytes(), rng.integers(97, 123, 900, dtype=np.uint8).tobytes()
    texts = [a, b + a[100:600], a[100:520] + b, b"x" * 900, b"", b"ab" * 450, a]
    offsets = np.cumsum([0, *map(len, texts)])
    text, start, windows, trigger, name = repeats.phrases(np.frombuffer(b"".join(texts), np.uint8), offsets, 400)
    covered = sorted((t, s + k) for t, s, w in zip(text.tolist(), start.tolist(), windows.tolist()) for k in range(w))
    assert covered == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 399)]
    same = {}
    for t, s, w, trig in zip(text.tolist(), start.tolist(), windows.tolist(), trigger.tolist()):
        for k in range(w):
            assert same.setdefault(texts[t][s + k : s + k + 400], trig) == trig
    again = repeats.repeated_windows([a, a[100:520] + b], [1, 1], 400)
    assert np.flatnonzero(again[0]).tolist() == list(range(100, 121)) and np.flatnonzero(again[1]).tolist() == list(range(21))

