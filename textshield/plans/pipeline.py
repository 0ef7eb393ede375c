"""The whole way of a document: guards, masking, rewrite, unmasking, reformatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import backends, guards, html, masking, reformat, subjects


def proofread(requests: DataFrame, cfg: Config | None = None, ner: backends.NerBackend | None = None, rewriter: backends.Rewriter = backends.identity) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with every stage's text, rejected rows with their error).

    Rows need the front door's columns.  Nothing but the masked text reaches
    the rewriter, and a rewrite that lost or moved a token is not taken.  No
    stage shuffles.
    """
    cfg = cfg or Config()
    accepted, rejected = guards.split(requests, cfg)
    frozen = html.freeze_documents(accepted.withColumn("_html", F.when(F.col("format") == "html", F.col("data")).otherwise("")), "_html").drop("_html")
    body = F.when(F.col("format") == "html", F.col("text_format")).otherwise(F.col("data"))
    rows = subjects.continue_documents(frozen.withColumn("body", body), "body")
    rows = masking.mask_layers(rows, F.col("body"))
    rows = backends.mask_names(rows, ner)
    rows = rows.withColumns({"message_01": F.col("_m.text"), "tokens": F.col("_m.tokens")}).drop("_m")
    rows = rows.withColumns({"layers": masking.layers(F.col("tokens")), "layered_maps": masking.flat_map(F.col("tokens")), "order": F.array_distinct(F.transform("tokens", lambda t: t["layer"]))})
    rows = backends.rewrite(rows, cfg, rewriter, "message_01") if cfg.rewrite else rows.withColumns({"message_02": F.col("message_01"), "token_ok": F.lit(True)})
    rows = rows.withColumn("message_03", masking.unmask(F.col("message_02"), F.col("layered_maps")) if cfg.unmask else F.col("message_02"))
    if cfg.reformat:
        rows = reformat.reformat_documents(rows, "message_03", "locale", "message_final", "tenant")
    else:
        rows = rows.withColumn("message_final", F.col("message_03"))
    restored = html.reverse(F.col("skeleton"), html.chosen_map(F.col("message_final"), F.col("text_map")), F.col("table_map"))
    return rows.withColumn("html_final", F.when(F.col("format") == "html", restored)), rejected
