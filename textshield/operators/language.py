"""Language by frequent words: with joins and groups for a table, as an expression for a row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .models import _groups

# Frequent words by language.
WORDS = {
    "en": "the of and to in is that it was for on are with as be this have from or by not but what all were when we there can an your which their said if do will each how them then she many some so these would into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know".split(),
    "fr": "le la les un une des du de et est en que qui dans pour par sur au aux avec pas plus ce cette sont ne se il elle nous vous ils ou mais comme".split(),
    "de": "der die das den dem des ein eine einer und ist in zu mit von auf für nicht sich auch als an es im wird aus er sie wir ihr oder aber wie".split(),
    "es": "el la los las un una unos de del y en que es por para con no se su al lo como más pero sus le ya o este sí porque".split(),
    "id": "yang dan di ini itu dengan untuk tidak dari dalam akan pada juga saya ke karena tersebut bisa ada mereka lebih kata sudah atau saat oleh menjadi".split(),
    "sw": "na ya wa kwa ni katika la za cha kuwa hii huo hiyo yake wake kama lakini pia sana watu baada huu hivyo mtu siku".split(),
    "ms": "yang dan di ini itu dengan untuk tidak dari dalam akan pada juga saya ke kerana boleh ialah beliau telah kepada adalah sebagai oleh".split(),
}


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, detected, confidence) of rows with at least one frequent word.

    The language whose words the row has most of; ties by name.  Words are
    counted per row before they meet the list, which is small and fixed.
    """
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(w, lang) for lang, words in WORDS.items() for w in sorted(set(words))], "word string, lang string"))
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word"))
    hits = words.join(table, "word").groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("id").agg(F.max(F.struct("n", "lang")).alias("b"), F.sum("n").alias("all"))
    return best.select("id", F.col("b.lang").alias("detected"), (F.col("b.n") / F.col("all")).alias("confidence"))


def detected(text: Column) -> Column:
    """struct(lang, confidence) of one text, null without a frequent word.

    The same language as ``detect``'s.  The confidence is the part of the words
    known in any language that the language has, so that words which several
    languages share don't lower it.
    """
    every = sorted({w for words in WORDS.values() for w in words})

    def among(words: Column, own: list[str]) -> Column:
        return F.filter(words, lambda w: w.isin(*own))

    def judge(words: Column) -> Column:
        counts = F.array(*(F.struct(F.size(among(words, own)).alias("n"), F.lit(lang).alias("lang")) for lang, own in WORDS.items()))
        best = F.array_max(counts)
        return F.struct(best["lang"].alias("lang"), (best["n"] / F.size(words)).alias("confidence"))

    known = among(F.split(F.lower(text), r"[^\p{L}]+"), every)
    # one element, so that the words are cut once
    found = F.get(F.transform(F.filter(F.array(known), lambda words: F.size(words) > 0), judge), F.lit(0))
    # Thai is told by its letters and has no code of its own
    thai = F.length(F.regexp_replace(text, r"[^\u0E00-\u0E7F]", "")) * 2 > F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(thai, F.struct(F.lit("").alias("lang"), F.lit(1.0).alias("confidence"))).otherwise(found)


#: Lengths of character runs, and how many of them a profile ranks.
GRAMS, RANKS = (1, 2, 3), 300
#: Characters of a text that are looked at.
SNIPPET = 4000
#: Rows of an id, of which more are counted by joins and groups, which spill.
MOST_ROWS = 256
#: Texts and characters that are counted at once; codes of a text and of three characters so fit 63 bits.
TEXTS, CHARS = 512, (1 << 18) - 2


def profiles() -> list[tuple[str, str, int]]:
    """(language, run of characters, rank from 1) made from the word lists.

    A word counts by its place in its list, the k-th one k times less than the
    first, and so do the runs in it, blanks at its ends included.
    """
    out = []
    for lang, words in WORDS.items():
        weight: Counter = Counter()
        for k, word in enumerate(dict.fromkeys(words)):
            padded = f" {word} "
            for n in GRAMS:
                for i in range(len(padded) - n + 1):
                    weight[padded[i : i + n]] += 1_000_000 // (k + 1)
        del weight[" "]
        ranked = sorted(weight, key=lambda g: (-weight[g], g))[:RANKS]
        out += [(lang, g, r + 1) for r, g in enumerate(ranked)]
    return out


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, rank) from labelled texts: counts over all of them, then the most frequent of each language."""
    grams = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(_grams(_letters(F.col(text_col)))).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= RANKS).select("lang", "gram", "rank")


def _letters(text: Column) -> Column:
    """The words of a text's snippet, a blank before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.left(text, F.lit(SNIPPET))), F.lit(" ")), r"[^\p{L}]+", " ")


def _grams(letters: Column) -> Column:
    """Runs of 1 to 3 characters of the words in ``_letters``, each as often as it occurs."""
    words = F.filter(F.split(letters, " "), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(w) + 3 - n), lambda i: F.substring(padded, i, F.lit(n)))
        return F.filter(F.concat(*(runs(n) for n in GRAMS)), lambda g: g != " ")

    return F.flatten(F.transform(words, of_word))


class Profiles:
    """(lang, gram, rank) rows as arrays, by which texts of ``_letters`` are judged."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        known = [(g, lang, r) for lang, g, r in rows if g and r is not None and len(g) <= max(GRAMS) and "\0" not in g]
        # last name first, so that the first of equals is the last by name
        self.langs = sorted({lang for _, lang, _ in known}, key=lambda x: (x is not None, x or ""), reverse=True) or [None]
        known.sort(key=lambda x: x[0])
        self._chars = np.array([[ord(c) for c in g.ljust(max(GRAMS), "\0")] for g, _, _ in known], np.int64).reshape(-1, max(GRAMS))
        self._lang = np.array([self.langs.index(lang) for _, lang, _ in known], np.int64)
        self._rank = np.array([r for _, _, r in known], np.float64)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the index of its language, what it is worth (-inf: nothing known), and what the next one is.

        Runs are numbers: codes of the text and of three characters, in order,
        0 where a run is shorter.
        """
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        code = np.zeros(int(chars.max()) + 1, np.int64)
        code[chars] = 1
        bits = int(code.sum()).bit_length()
        code[code > 0] = np.arange(1, code.sum() + 1)
        c = code[chars]
        one = (np.repeat(np.arange(len(texts)), [len(t) for t in texts]) << 3 * bits) + (c << 2 * bits)
        two = one[:-1] + (c[1:] << bits)
        three = two[:-1] + c[2:]
        # words share the blank between them, and there are two between texts: neither lies within a run
        blank = c == code[ord(" ")]
        runs = np.concatenate([one[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]])
        runs.sort()
        starts = np.flatnonzero(np.diff(runs, prepend=-1))
        n = np.diff(starts, append=len(runs))
        runs = runs[starts]
        # by text, the most frequent first, then by the run
        text, wide, room = runs >> 3 * bits, len(chars).bit_length(), len(runs).bit_length()
        order = np.sort((((text << wide) + len(chars) - n) << room) + np.arange(len(runs))) & ((1 << room) - 1)
        own = np.arange(1, len(runs) + 1) - np.searchsorted(text, np.arange(len(texts)))[text]
        ranked = own <= RANKS
        own, text, runs = own[ranked], text[ranked], (runs & ((1 << 3 * bits) - 1))[order[ranked]]

        mine = np.where(self._chars < len(code), code[np.minimum(self._chars, len(code) - 1)], 0)
        here = ((mine > 0) | (self._chars == 0)).all(axis=1)
        mine, lang, rank = mine[here] @ (1 << np.arange(2, -1, -1) * bits), self._lang[here], self._rank[here]
        first, last = np.searchsorted(mine, runs), np.searchsorted(mine, runs, "right")
        met = last - first
        at = np.arange(met.sum()) + np.repeat(last - np.cumsum(met), met)
        cell = np.repeat(text, met) * len(self.langs) + lang[at]
        size = len(texts) * len(self.langs)
        worth = np.bincount(cell, RANKS - np.abs(np.repeat(own, met) - rank[at]), size).astype(float)  # integers if none is met
        worth[np.bincount(cell, minlength=size) == 0] = -np.inf
        worth = worth.reshape(len(texts), -1)
        every = np.arange(len(texts))
        best = worth.argmax(axis=1)
        most = worth[every, best]
        worth[every, best] = -np.inf
        next_ = worth.max(axis=1)
        return best, most, np.where(np.isneginf(next_), 0, next_)

    def judge_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, detected, worth, next) from (id, letters, rows), where an id's rows follow each other."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([held, t]) if held else t).combine_chunks()
            rows, letters = t["rows"].to_pylist(), t["letters"].to_pylist()
            starts, at = [], 0
            while at < len(rows) and at + rows[at] <= len(rows):
                starts.append(at)
                at += rows[at]
            held = t.slice(at)
            texts = ["".join(letters[a : a + rows[a]]) for a in starts]
            for group in _groups(texts, TEXTS, CHARS):
                best, worth, next_ = self.judge([texts[i] for i in group])
                known = worth > 0
                ids = t["id"].take(pa.array([starts[i] for i in group], pa.int64()).filter(pa.array(known))).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array([self.langs[i] for i in best[known]], pa.string()), pa.array(worth[known]), pa.array(next_[known])], names=["id", "detected", "worth", "next"])


def detect_by_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: DataFrame | None = None) -> DataFrame:
    """(id, detected, confidence) by the distance of ranks (Cavnar and Trenkle, 1994).

    A text's most frequent runs are ranked, and each is worth ``RANKS`` less the
    distance to its rank in a language's profile, or nothing if that lacks it.
    The language worth most is detected, of equals the last by name; Thai, told
    by its letters, has no code of its own.  Confidence is what the language is
    worth over what it and the next one are.  Texts without a known run give no
    row; rows with a null id are one text.  ``table`` (lang, gram, rank), at
    most ``RANKS`` rows a language, replaces the profiles of the word lists; it
    is collected.

    Only the snippets are shuffled, by id; a task counts many texts at once.
    Ids of over ``MOST_ROWS`` rows, whose runs may not fit its memory, are
    counted by groups and joined with the profiles.
    """
    spark = docs.sparkSession
    schema = "lang string, gram string, rank int" if table is None else table.select("lang", "gram", "rank").schema
    ranks = profiles() if table is None else [tuple(r) for r in table.select("lang", "gram", "rank").collect()]
    snippets = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _letters(F.col(text_col)).alias("letters"))
    counted = snippets.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("id")))

    fields = [StructField("id", snippets.schema["id"].dataType), StructField("detected", StringType()), StructField("worth", DoubleType()), StructField("next", DoubleType())]
    few = counted.where(F.col("rows") <= MOST_ROWS).mapInArrow(Profiles(ranks).judge_rows, StructType(fields))

    grams = counted.where(F.col("rows") > MOST_ROWS).select("id", F.explode(_grams(F.col("letters"))).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = grams.withColumn("own", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "gram"))).where(F.col("own") <= RANKS)
    met = own.join(F.broadcast(spark.createDataFrame(ranks, schema)), "gram")
    worth = met.groupBy("id", "lang").agg(F.sum(F.lit(RANKS) - F.abs(F.col("own") - F.col("rank"))).alias("worth"))
    two = worth.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("worth", "lang")), asc=False), 1, 2).alias("two"))  # a few languages
    best, next_ = F.get("two", F.lit(0)), F.coalesce(F.get("two", F.lit(1))["worth"], F.lit(0))
    many = two.select("id", best["lang"].alias("detected"), best["worth"].cast("double").alias("worth"), next_.cast("double").alias("next"))

    return few.unionByName(many).where(F.col("worth") > 0).select("id", "detected", (F.col("worth") / (F.col("worth") + F.col("next"))).alias("confidence"))
