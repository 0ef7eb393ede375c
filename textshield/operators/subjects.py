"""Subject continuity in Indonesian reports: repeated subjects become pronouns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.spans import let

_TITLED = rf"\b((?:{'|'.join(tables.SUBJECT_TITLES)})\s+[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+){{0,200}})\b"
_SPACED = r"(?<=[.!?])\s+"


def subjects(para: Column) -> Column:
    """Different titled subjects, in order of appearance."""
    found = F.regexp_extract_all(para, F.lit(f"(?U){_TITLED}"), 1)
    return F.array_distinct(F.transform(found, lambda s: F.regexp_replace(s, r"^(\w+)\s+", "$1 ")))


def dominant_name(para: Column) -> Column:
    """The capitalised word that occurs most, at least twice; the first of equals."""
    words = F.filter(F.regexp_extract_all(para, F.lit(r"(?U)\b([A-Z][a-z]+)\b"), 1), lambda w: ~w.isin(*tables.NAME_STOPWORDS, *tables.SUBJECT_TITLES))
    counted = F.transform(F.array_distinct(words), lambda w, i: F.struct(F.size(F.filter(words, lambda x: x == w)).alias("n"), (-i).alias("i"), w.alias("w")))
    return let(F.array_max(counted), lambda best: F.when(best["n"] >= 2, best["w"]))


def lead_name(first: Column) -> Column:
    """A name that a paragraph opens with: before a listed verb, else up to three capitalised words."""
    verb = F.regexp_extract(first, rf"(?U)^\s*([A-Z][a-z]+)\s+(?:{'|'.join(tables.SUBJECT_VERBS)})\b", 1)
    words = F.regexp_extract(first, r"(?U)^\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b", 1)
    return F.when(verb != "", verb).when((words != "") & ~words.isin(*tables.NAME_STOPWORDS, *tables.SUBJECT_TITLES), words)


def _paragraph(para: Column, most: int | None) -> Column:
    def body(x: Column) -> Column:
        sentences = x["sentences"]
        first = F.get(F.filter(sentences, lambda s: (F.trim(s) != "") & ~F.trim(s).rlike(r"(?i)^(Percobaan|Trial)\s+\d+\s*:\s*$")), F.lit(0))
        one = F.when(F.size(x["titled"]) == 0, F.coalesce(lead_name(F.trim(first)), x["dominant"])).when(F.size(x["titled"]) == 1, F.get(x["titled"], F.lit(0))).otherwise(x["dominant"])

        def rewrite(subject: Column) -> Column:
            pronoun = F.when(subject.rlike(rf"^(?:{'|'.join(tables.SUBJECT_TITLES)}) "), "Beliau").otherwise("Ia")

            def sentence(s: Column, i: Column) -> Column:
                bare = F.ltrim(s)
                repeated = bare.startswith(subject)
                bare_start = bare.rlike(r"(?U)^[a-z]") & ~bare.rlike(r"^(?:Beliau|Ia|Dia)\b")
                due = (i >= 1) & (F.lit(True) if most is None else i <= most)
                after = F.when(repeated, F.concat(pronoun, F.substring(bare, F.length(subject) + 1, F.length(bare)))).when(bare_start, F.concat(pronoun, F.lit(" "), bare))
                via = F.when(repeated, "subject_repeat_to_pronoun").when(bare_start, "missing_subject_prefix_pronoun")
                return F.struct(s.alias("from"), F.when(due, F.coalesce(after, s)).otherwise(s).alias("to"), F.when(due & after.isNotNull(), via).alias("via"))

            return F.transform(sentences, sentence)

        kept = F.array(F.struct(para.alias("from"), para.alias("to"), F.lit(None).cast("string").alias("via")))
        return let(one, lambda subject: F.when(subject.isNull() | (F.size(sentences) <= 1), kept).otherwise(rewrite(subject)))

    return let(F.struct(F.split(para, _SPACED).alias("sentences"), subjects(para).alias("titled"), dominant_name(para).alias("dominant")), body)


def continue_subjects(text: Column, locale: Column, check: Column, most: int | None = None) -> Column:
    """struct(text, applied, skipped, changes).  Rows of other locales or checks pass as they are."""
    wanted = F.coalesce(F.lower(locale).startswith("id") & (F.replace(F.lower(check), F.lit("_"), F.lit("-")) == "reference-check"), F.lit(False))
    paras = F.transform(F.split(text, r"\n\s*\n+"), lambda p: _paragraph(p, most))

    def body(x: Column) -> Column:
        new = F.array_join(F.transform(x, lambda p: F.array_join(F.transform(p, lambda s: s["to"]), " ")), "\n\n")
        changes = F.filter(F.flatten(x), lambda s: s["via"].isNotNull())
        return F.struct(new.alias("text"), (F.size(changes) > 0).alias("applied"), F.lit(False).alias("skipped"), changes.alias("changes"))

    none = F.struct(text.alias("text"), F.lit(False).alias("applied"), F.lit(True).alias("skipped"), F.array().cast("array<struct<`from`:string,`to`:string,via:string>>").alias("changes"))
    return F.when(wanted & text.isNotNull(), let(paras, body)).otherwise(none)


def continue_documents(df: DataFrame, text_col: str = "text", locale_col: str = "locale", check_col: str = "type_of_check") -> DataFrame:
    out = df.withColumn("_s", continue_subjects(F.col(text_col), F.col(locale_col), F.col(check_col)))
    return out.withColumn(text_col, F.col("_s.text")).withColumn("subject_changes", F.col("_s.changes")).drop("_s")
