from pyspark.sql import functions as F

from textshield.config import Config
from textshield.operators import backends, guards, html, language, tokens
from textshield.plans.pipeline import proofread

LONG = "This is a long enough report text with more than ten words in it, sent by Budi Santoso to a@b.org today."


def requests(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type_of_check string, tenant string, locale string, format string, data string, report_id string")


def test_error_codes(spark):
    df = requests(spark, ("", " Indonesia", "ID", None, LONG, "1"), ("", "x", "en", "", LONG, "2"), ("", "thailand", "xx", "", LONG, "3"), ("", "thailand", "", "", LONG, "4"), ("", "thailand", "en", "pdf", LONG, "5"), ("", "thailand", "en", "", "hi", "6"), ("", "thailand", "en", "", None, "7"))
    got = [r[0] for r in guards.verdicts(df).orderBy("i").select("error.error").collect()]
    assert got == [None, "UNSUPPORTED_TENANT", "UNSUPPORTED_LOCALE", "MISSING_LOCALE", "UNSUPPORTED_FORMAT", "TEXT_TOO_SHORT", "MISSING_DATA"]


def test_content_guards(spark):
    df = spark.createDataFrame([("<b>hi</b>",), ("javascript:alert(1)",), ("plain",), ("SELECT * FROM users",), ("12345",), (None,)], "t string")
    rows = df.select(guards.has_markup(F.col("t")), guards.has_sql(F.col("t")), guards.symbol_only(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (True, False, False), (False, False, False), (False, True, False), (False, False, True), (False, False, True)]
    raw = spark.createDataFrame([('{"data": 1, "x": 2}',), ("[1]",), ('{"$where": 1}',)], "r string")
    shape = [r[0] for r in raw.select(guards.payload_shape(F.col("r"))["error"]).collect()]
    assert shape == ["UNKNOWN_FIELDS", "INVALID_JSON_PAYLOAD", "UNKNOWN_FIELDS"]
    assert [r[0] for r in raw.select(guards.forbidden_key(F.col("r"))).collect()] == [False, False, True]


def test_language_verdict(spark):
    df = spark.createDataFrame([("id", "en", 0.9, 100), ("id", "id", 0.1, 100), ("id", "id", 0.9, 100), ("id", "id", 0.9, 10)], "l string, d string, c double, n int")
    got = [r[0] for r in df.select(guards.language_verdict(F.col("l"), F.col("d"), F.col("c"), F.col("n"))["reason"]).collect()]
    assert got == ["locale_language_mismatch", "low_confidence", "ok", "text_too_short"]


def test_language_detection(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    found = d.join(language.detect(d), F.col("doc_id") == F.col("id"))
    assert found.where("lang = detected").count() > 0.9 * found.count()


def test_language_guard_in_proofread(spark):
    german = "Der Bericht ist von der Leitung und wird nicht an die Kunden oder das Amt gesendet, weil er noch nicht fertig ist."
    df = requests(spark, ("", "indonesia", "en", "", LONG, "1"), ("", "indonesia", "en", "", german, "2"), ("", "indonesia", "en", "", "zzz qqq " * 20, "3"), ("", "indonesia", "ID", "", LONG, "4"))
    ok, bad = proofread(df, Config(check_language=True))
    assert [r["i"] for r in ok.collect()] == [0]
    assert {r["i"]: r["error"]["error"] for r in bad.collect()} == dict.fromkeys([1, 2, 3], "LOCALE_LANGUAGE_MISMATCH")


def test_language_of_a_row_is_the_tables(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    both = d.join(language.detect(d), F.col("doc_id") == F.col("id"), "left").select("detected", language.detected(F.col("text"))["lang"].alias("own"))
    assert both.where("not (detected <=> own)").count() == 0 and both.where("own is not null").count() > 100


def test_token_tables(spark):
    old = spark.createDataFrame([(1, "[ORG_2]", "A"), (1, "[PERSON_5]", "B")], "doc_id int, token string, original string")
    new = spark.createDataFrame([(1, "[ORG_1]", "X"), (1, "[PERSON_1]", "Y"), (1, "[ORG_7]", "A"), (1, "[ORG_8]", "[ORG_1]"), (1, "bad", "z"), (1, "[ORG_9]", " ")], "doc_id int, token string, original string")
    clean = tokens.sanitise(new, old)
    got = {r["original"]: r["new_token"] for r in tokens.reindex(clean, old).collect()}
    assert got == {"X": "[ORG_3]", "Y": "[PERSON_6]"}


def test_apply_outside_and_preserved(spark):
    m = F.create_map(F.lit("[ORG_2]"), F.lit("Alice"))
    out = tokens.apply_outside(F.lit("Hello Alice [ORG_1] Alice"), m)
    assert spark.range(1).select(out).first()[0] == "Hello [ORG_2] [ORG_1] [ORG_2]"
    same = spark.range(1).select(tokens.preserved_strict(F.lit("[A_0] [B_1]"), F.lit("[B_1] [A_0]")), tokens.preserved(F.array(F.lit("[A_0]")), F.lit("x [A_0]"))).first()
    assert tuple(same) == (False, True)


def test_html(spark, sf):
    page = '<p>Hello</p><script>"</p>Hi"</script><p> </p><table><tr><td>1</td></tr></table>'
    df = html.freeze_documents(spark.createDataFrame([(page,)], "html string"))
    row = df.first()
    assert row["skeleton"] == '<p>[TEXT_01]</p><script>"</p>Hi"</script><p> </p>[TABLE_01]' and row["text_format"] == "Hello"
    assert df.select(html.reverse(F.col("skeleton"), F.col("text_map"), F.col("table_map"))).first()[0] == page
    pages = html.freeze_documents(spark.read.parquet(f"{sf}/pages.parquet"))
    assert pages.where(~html.reverse(F.col("skeleton"), F.col("text_map"), F.col("table_map")).eqNullSafe(F.col("html"))).count() == 0
    assert spark.range(1).select(html.parse_text_format(F.lit("KEY: value\nx"))).first()[0] == {"KEY": "value", "x": ""}


def test_proofread_masks_before_the_rewriter(spark):
    seen = {}

    def rewriter(df, col):
        seen["columns"] = col
        return F.replace(F.col(col), F.lit("[EMAIL_0]"), F.lit("lost"))

    df = requests(spark, ("general", "indonesia", "en", "plain", LONG, "1"), ("general", "indonesia", "en", "html", f"<p>{LONG}</p>", "2"))
    ok, bad = proofread(df, rewriter=rewriter)
    rows = ok.orderBy("i").collect()
    assert bad.count() == 0 and seen["columns"] == "message_01"
    assert "a@b.org" not in rows[0]["message_01"] and not rows[0]["token_ok"] and "a@b.org" in rows[0]["message_final"]
    assert rows[1]["html_final"] == f"<p>{LONG}</p>"


def test_prompts(spark):
    row = spark.range(1).select(backends.render_prompt(F.lit("Fix {{text}} in {{LOCALE_LANG_NAME}}: {{token_list}}"), F.lit("x [A_0]"), F.lit("en")), backends.json_reply(F.lit('so {"a": "1"} yes'))).first()
    assert row[0].endswith("Fix x [A_0] in English: [A_0]") and row[1] == {"a": "1"}


def test_config_is_frozen():
    assert Config().rate_limit == 20
