"""Stage tables, their mirror, the summary and the report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.spans import fold_sql, let_sql
from ..functions.tables import MONTHS_ID
from ..schema import MIRROR_COLUMNS, QA_COLUMNS


def local_iso(ts: Column) -> Column:
    """ISO seconds at +07:00, which has no summer time."""
    return F.concat(F.date_format(ts + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))


def local_long(ts: Column) -> Column:
    local = ts + F.expr("INTERVAL 7 HOURS")
    month = F.get(F.array(*map(F.lit, MONTHS_ID)), F.month(local) - 1)
    return F.concat(F.date_format(local, "dd"), F.lit(" "), month, F.lit(" "), F.date_format(local, "yyyy HH:mm:ss"), F.lit(" WIB"))


def document_id(*cols: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), 256)


def fingerprint(text: Column) -> tuple[Column, Column]:
    """SHA-1 in hex and in base64."""
    digest = F.sha1(F.coalesce(text, F.lit("")).cast("binary"))
    return digest, F.base64(F.unhex(digest))


def stage_rows(df: DataFrame, columns: list[str], now: Column) -> DataFrame:
    return df.select(document_id("report_id").alias("_id"), *columns, local_iso(now).alias("created_at"), local_long(now).alias("created_at2"))


def stage_tables(accepted: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Each stage's rows, from what ``proofread`` accepted; the HTML stages have the rows of that format."""
    rows = accepted.withColumn("toc_type", F.col("type_of_check"))
    keys = ["report_id", "toc_type", "tenant", "locale"]
    pages = rows.where("format = 'html'").withColumns({"report_id_html": F.concat(F.col("report_id"), F.lit("_html")), "html_tag": F.lit(True), "body_html": F.col("data")})
    prompt = rows.withColumns({"llm_prompt": F.col("message_01"), "llm_meta": F.create_map(F.lit("token_ok"), F.col("token_ok").cast("string"))})
    masked = [*keys, "message_01", "layers"]
    return {
        "html_freeze": stage_rows(pages, ["report_id_html", *keys, "html_tag", "body_html", "skeleton", "text_map", "table_map"], now),
        "masking": stage_rows(rows, [*keys, "body", "message_01", "layers", "order"], now),
        "generative": stage_rows(prompt, [*masked, "message_02", "llm_prompt", "llm_meta"], now),
        "unmask": stage_rows(rows, [*masked, "message_02", "message_03", "layered_maps"], now),
        "final": stage_rows(rows, [*masked, "message_02", "message_03", "message_final"], now),
        "html_reverse": stage_rows(pages, ["report_id_html", *keys, "html_tag", "html_final"], now),
    }


def mirror(stage: DataFrame) -> DataFrame:
    """The nine columns that may be copied, with the source's id and times."""
    return stage.select(*MIRROR_COLUMNS)


def writes(cfg: Config) -> dict[str, bool]:
    """Which writes run: guarded, forced, mirrored."""
    return {"guarded": cfg.store and not cfg.db_disabled, "forced": not cfg.db_disabled, "mirror": cfg.mirror and not cfg.db_disabled}


def upsert_summary(rows: DataFrame, fields: list[str], key: str = "report_id", seq: str = "seq", created: str = "created_at") -> DataFrame:
    """One row for each key: each field's latest value that isn't null, the first creation time."""
    latest = [F.expr(f"max_by(`{f}`, `{seq}`) FILTER (WHERE `{f}` IS NOT NULL)").alias(f) for f in fields]
    return rows.groupBy(key).agg(*latest, F.min(created).alias(created))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def missing_fields(row_keys: Column, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), row_keys))


def number_rows(rows: DataFrame, order: list[str], start: int = 0, no: str = "no") -> DataFrame:
    """Running numbers in order, without a task that sees all rows: counts of ranges add up."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    first = ranged.groupBy("_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    base = first.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # one row for each range
    return ranged.join(base, "_p").withColumn(no, (F.col("_base") + F.col("_i") - F.col("_first") + 1 + start).cast("long")).drop("_p", "_i", "_first", "_base")


def qa_rows(final: DataFrame, order: list[str], start: int = 0, with_personal: bool = False) -> DataFrame:
    """The thirteen report columns; personal data only if asked for."""
    rows = final if with_personal else final.withColumns({"before": F.lit(None).cast("string"), "pii_dictionary": F.lit(None).cast("string")})
    return number_rows(rows, order, start).select(*QA_COLUMNS)


def qa_active(cfg: Config) -> bool:
    return cfg.qa_sheet


# Depth behind each token of a JSON text.
_DEPTHS = fold_sql("t", "0", "a.s + CASE WHEN x IN ('{', '[') THEN 1 WHEN x IN ('}', ']') THEN -1 ELSE 0 END", "a.s + CASE WHEN x IN ('{', '[') THEN 1 WHEN x IN ('}', ']') THEN -1 ELSE 0 END")
_LINE = "concat('\n', repeat('  ', get(d, i)))"
_SHOWN = f"""CASE WHEN x IN ('{{', '[') AND NOT coalesce(get(t, i + 1) IN ('}}', ']'), false) THEN concat(x, {_LINE})
  WHEN x IN ('}}', ']') AND NOT coalesce(get(t, i - 1) IN ('{{', '['), false) THEN concat({_LINE}, x)
  WHEN x = ',' THEN concat(x, {_LINE}) WHEN x = ':' THEN ': ' ELSE x END"""


def pretty_json(text: Column) -> Column:
    """A JSON text over lines, two blanks a level; what is no JSON stays as it is, null becomes empty.

    Strings and numbers stay as they are written.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*+"|[\[\]{},:]|[^\s\[\]{},:"]+)'), 1)
    shown = let_sql(tokens, "t", f"get(transform(array({_DEPTHS}), d -> array_join(transform(t, (x, i) -> {_SHOWN}), '')), 0)")
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull(), shown).otherwise(text), F.lit(""))
