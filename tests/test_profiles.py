"""Languages by profiles: texts counted at once in a task, and ids of many rows by groups."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textshield.operators import language
from textshield.sources.io import read_table

#: With ties, a run no text has, letters beyond 16 bits, a language twice and one without a name.
TABLE = [("x", "a", 1), ("x", "ab", 2), ("y", "a", 1), ("y", "ab", 2), ("y", "zzz", 3), ("z", " b", 1), ("z", " b", 9), ("z", "öß", 2), ("q", "𠀀", 1), ("q", "𐐨𠀀", 2), ("q", "漢 ", 3), ("s", "ς ", 1), ("s", "σ", 2), (None, "c", 1)]


def _runs(text):
    words = "".join(c if c.isalpha() else " " for c in text[: language.SNIPPET].lower()).split()
    return Counter(g for w in words for p in [f" {w} "] for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")


def _brute(rows, table):
    """{id: (detected, confidence)}, run by run."""
    counts = {}
    for i, text in rows:
        counts.setdefault(i, Counter()).update(_runs(text or ""))
    out = {}
    for i, runs in counts.items():
        own = {g: k + 1 for k, g in enumerate(sorted(runs, key=lambda g: (-runs[g], g))[: language.RANKS])}
        worth = Counter()
        for lang, gram, rank in table:
            if gram in own:
                worth[lang] += language.RANKS - abs(own[gram] - rank)
        two = sorted(worth.items(), key=lambda x: (x[1], x[0] is not None, x[0] or ""), reverse=True)
        if two and two[0][1] > 0:
            out[i] = (two[0][0], two[0][1] / (two[0][1] + (two[1][1] if two[1:] else 0)))
    return out


def _rows():
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    rows = [(i, rng.choice([" ", "-", "  7 ", "\n"]).join(word(rng.choice(["abc", "aB", "öẞßÖ", "漢𠀀𐐀", "ΟΔΣ", "İIıi", "é"])) for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(rng.choice([None, 7, 500, 501]), f"{word('abc')} {word('bcde')}") for _ in range(60)]
    rows += [(600, f"{word('abcde')} {word('cde')}") for _ in range(language.MOST_ROWS + 1)]
    # cut within a word; more runs than ranks; an id at the most rows, one of them longer than all that is counted at once
    rows += [(700, "b" * 3999 + "a a a"), (701, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000)) + " a"), (702, None), (703, ""), (704, "12 !")]
    rows += [(705, f"{word('abc')} " * 900) for _ in range(language.MOST_ROWS)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_rows", [language.MOST_ROWS, 0])
def test_odd_rows_against_brute_force(spark, monkeypatch, most_rows):
    monkeypatch.setattr(language, "MOST_ROWS", most_rows)
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    for table in (TABLE, None):
        made = table and spark.createDataFrame(table, "lang string, gram string, rank int")
        got = [tuple(r) for r in language.detect_by_profile(docs, table=made).collect()]
        assert len(got) > 100 and sorted(got, key=str) == sorted(((i, *x) for i, x in _brute(rows, table or language.profiles()).items()), key=str)
    assert language.detect_by_profile(docs, table=spark.createDataFrame([], "lang string, gram string, rank int")).isEmpty()
    assert language.detect_by_profile(docs.limit(0)).isEmpty()


def test_batches_end_within_a_text(monkeypatch):
    rng = random.Random(5)
    texts = [[" " + "".join(rng.choice("ab ") for _ in range(rng.randrange(9))).strip().replace("  ", " ") + " " for _ in range(rng.randrange(1, 6))] for _ in range(80)]
    flat = [(i, t.replace("  ", " "), len(ts)) for i, ts in enumerate(texts) for t in ts]
    want = _brute([(i, t) for i, t, _ in flat], TABLE)
    for cut, most_texts, most_chars in ((1, 512, 1000), (7, 3, 1000), (1000, 512, 20)):
        monkeypatch.setattr(language, "TEXTS", most_texts)
        monkeypatch.setattr(language, "CHARS", most_chars)
        batches = [pa.RecordBatch.from_pylist([dict(zip(("id", "letters", "rows"), r, strict=True)) for r in flat[a : a + cut]]) for a in range(0, len(flat), cut)]
        got = [r for b in language.Profiles(TABLE).judge_rows(iter(batches)) for r in b.to_pylist()]
        assert {r["id"]: (r["detected"], r["worth"] / (r["worth"] + r["next"])) for r in got} == want and len(got) == len(want)


def test_the_most_letters_at_once_fit_a_code():
    """As many texts and different characters as one group may have, in 63 bits."""
    letters = [chr(c) for c in range(0x100, 0x10FFFF) if not 0xD800 <= c < 0xE000][: language.CHARS - 3 * language.TEXTS]
    parts = [f" {''.join(p)}a " for p in np.array_split(np.array(letters), language.TEXTS)]
    assert sum(map(len, parts)) == language.CHARS
    best, worth, next_ = language.Profiles([("x", "a ", 4), ("y", parts[100][:2], 1), ("z", parts[-1][:2], 2)]).judge(parts)
    assert best.tolist() == [1 if i == 100 else 2 for i in range(language.TEXTS)] and (worth == 300).all()
    assert next_.tolist() == [{100: 300, language.TEXTS - 1: 299}.get(i, 0) for i in range(language.TEXTS)]


def test_ordinary_texts_give_no_row_for_each_run(spark, sf, monkeypatch):
    docs = read_table(spark, sf, "documents")
    want = docs.count()
    monkeypatch.setattr(language, "_grams", lambda text: F.array(F.raise_error(F.lit("a row for each run")).cast("string")))
    assert language.detect_by_profile(docs).count() == want
