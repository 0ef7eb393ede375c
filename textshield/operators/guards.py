"""Guards as columns: every row gets a verdict, none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import tables
from ..functions.spans import TOKEN, pieces
from . import language

ERROR = "struct<message:string,error:string,status_code:int>"
REQUEST_KEYS = ["type_of_check", "tenant", "locale", "format", "data", "report_id"]

# What markup and statements look like.
_HTML = r"<[^>]+>"
_XSS = r"(?i)javascript:|<script\b|\bon\w+\s*="
_SQL = r"(?i)\b(?:select|insert|update|delete|drop|union|alter|create|truncate)\b|--|;|\bor\s+1\s*=\s*1\b"


def error(message: str | Column, code: str, status: int = 422) -> Column:
    return F.struct((F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(code).alias("error"), F.lit(status).alias("status_code"))


def normalise(df: DataFrame) -> DataFrame:
    """Trimmed lower-case tenant, locale and format; defaults for check and format."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return df.withColumns({
        "type_of_check": F.coalesce(F.nullif(F.trim("type_of_check"), F.lit("")), F.lit("general")),
        "tenant": clean("tenant"),
        "locale": clean("locale"),
        "format": F.coalesce(F.nullif(clean("format"), F.lit("")), F.lit("plain")),
    })


def locale_tenant(locale: Column, tenant: Column) -> Column:
    def check(c: Column, allowed: list[str], name: str) -> Column:
        low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
        return F.when(low == "", error(f"{name.lower()} is required", f"MISSING_{name}", 400)).when(~low.isin(*allowed), error(f"{name.lower()} must be one of: {', '.join(sorted(allowed))}", f"UNSUPPORTED_{name}"))

    return F.coalesce(check(locale, tables.LOCALES, "LOCALE"), check(tenant, tables.TENANTS, "TENANT"))


def symbol_only(text: Column) -> Column:
    """No letter at all; null counts."""
    return ~F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def payload_shape(raw: Column, allowed: list[str] | None = None) -> Column:
    """Whether a JSON text is an object with no other keys."""
    keys = F.json_object_keys(raw)
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed or REQUEST_KEYS))))
    return F.when(keys.isNull(), error("payload is not an object", "INVALID_JSON_PAYLOAD", 400)).when(F.size(extra) > 0, error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")), "UNKNOWN_FIELDS", 400))


def forbidden_key(raw: Column) -> Column:
    """Whether a key at any depth begins with a dollar sign; values don't count."""
    keys = F.regexp_replace(raw, r'("(?:[^"\\]|\\.)*+"\s*:)|"(?:[^"\\]|\\.)*+"', "$1")
    return F.coalesce(keys.rlike(r'[{,]\s*"\$'), F.lit(False))


def validate_and_scan(raw: Column, allowed: list[str] | None = None, reject_markup: bool = True, markup: bool = True, statements: bool = True) -> Column:
    """struct(error, data): shape, then keys and content; without ``reject_markup`` tags are stripped from data instead."""
    data = F.get_json_object(raw, "$.data")
    reason = F.when(forbidden_key(raw), "forbidden key")
    if markup and reject_markup:
        reason = F.coalesce(reason, F.when(has_markup(raw), "html/xss"))
    if statements:
        reason = F.coalesce(reason, F.when(has_sql(data), "sql-like"))
    malicious = F.when(reason.isNotNull(), error(F.concat(F.lit("malicious_payload: "), reason), "MALICIOUS_PAYLOAD", 400))
    found = F.coalesce(payload_shape(raw, allowed), malicious)
    return F.struct(found.alias("error"), F.when(found.isNull(), data if reject_markup else strip_markup(data)).alias("data"))


def has_markup(text: Column) -> Column:
    return F.coalesce(text.rlike(_HTML) | text.rlike(_XSS), F.lit(False))


def has_sql(text: Column) -> Column:
    return F.coalesce(text.rlike(_SQL), F.lit(False))


def strip_markup(text: Column) -> Column:
    """Tags go, their text stays with & and < written as entities."""
    bare = F.regexp_replace(text, _HTML, "")
    return F.replace(F.replace(bare, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def allow_tags(text: Column, tags: list[str]) -> Column:
    """Only these tags stay, without their attributes; other tags go, texts stay with & and < written as entities.

    Tags are not balanced: a closing tag without an opening one stays if allowed.
    """
    allowed = F.array(*(F.lit(t.lower()) for t in tags)).cast("array<string>")

    def tag(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, r"^</?\s*([A-Za-z][A-Za-z0-9]*)", 1))
        shown = F.concat(F.when(p.startswith("</"), "</").otherwise("<"), name, F.lit(">"))
        return F.when((name != "") & F.array_contains(allowed, name), shown).otherwise("")

    plain = lambda p: F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.array_join(F.transform(pieces(text, _HTML), lambda p, i: F.when(i % 2 == 1, tag(p)).otherwise(plain(p))), "")


def clean(text: Column, tokens_too: bool = True) -> Column:
    """The first 4000 characters without tokens, addresses and long numbers, white space squeezed."""
    bare = F.regexp_replace(text, TOKEN, " ") if tokens_too else text
    bare = F.left(bare, F.lit(4000))
    bare = F.regexp_replace(bare, r"https?://\S+|www\.\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\d{3,}", " "), r"\s+", " "))


def semantic(text: Column, cfg: Config | None = None) -> Column:
    """struct(passes, reason, chars, words) of a text's size."""
    cfg = cfg or Config()
    c = F.coalesce(clean(text), F.lit(""))
    chars, words = F.length(c), F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    reason = F.when(chars < cfg.min_chars, "too_short").when(words < cfg.min_words, "too_few_words").otherwise("length_only_ok")
    return F.struct((reason == "length_only_ok").alias("passes"), reason.alias("reason"), chars.alias("chars"), words.alias("words"))


def semantic_error(verdict: Column) -> Column:
    """The error of a verdict that doesn't pass; a reason of another detector falls in one class."""
    named = F.when(verdict["reason"] == "too_short", error("text is too short", "TEXT_TOO_SHORT"))
    named = named.when(verdict["reason"] == "too_few_words", error("text has too few words", "TEXT_TOO_FEW_WORDS"))
    named = named.when(verdict["reason"] == "not_meaningful", error("text has no meaning to check", "TEXT_NOT_MEANINGFUL"))
    return F.when(~verdict["passes"], named.otherwise(error("text can't be checked", "TEXT_INVALID_SEMANTIC")))


def tokens_of(text: Column) -> Column:
    """About a token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def over_limit(text: Column, limit: int) -> Column:
    return F.when(F.lit(limit > 0) & (tokens_of(text) > limit), error(f"input exceeds {limit} tokens", "INPUT_TOKEN_LIMIT"))


def language_verdict(locale: Column, lang: Column, confidence: Column, chars: Column, cfg: Config | None = None) -> Column:
    """struct(passes, reason) from what the detector said."""
    cfg = cfg or Config()
    allowed = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in tables.LOCALE_LANGS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.lower(locale)), F.array().cast("array<string>"))
    match = F.array_contains(allowed, lang)
    if cfg.lang_close:
        match = match | (F.lower(locale).isin("id", "ms") & lang.isin("id", "ms"))
    reason = (
        F.when(chars < cfg.lang_min_chars, "text_too_short")
        .when(F.coalesce(lang, F.lit("")) == "", "undetected_low_confidence")
        .when(confidence < cfg.lang_min_confidence, "low_confidence")
        .when(~match, "locale_language_mismatch")
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("passes"), reason.alias("reason"))


def language_error(locale: Column, text: Column, cfg: Config | None = None) -> Column:
    """An error unless the text is surely in a language of the locale."""
    c = F.coalesce(clean(text, tokens_too=False), F.lit(""))

    def judge(found: Column) -> Column:
        verdict = language_verdict(locale, found["lang"], found["confidence"], F.length(c), cfg)
        message = F.concat(F.lit("text language '"), F.coalesce(found["lang"], F.lit("")), F.lit("' does not match locale '"), F.lower(locale), F.lit("'"))
        return F.when(~verdict["passes"], error(message, "LOCALE_LANGUAGE_MISMATCH"))

    return F.get(F.transform(F.array(language.detected(c)), judge), F.lit(0))


def verdicts(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Adds ``error``: the first guard that fails, else null.  All rows stay."""
    cfg = cfg or Config()
    df = normalise(df)
    data = F.col("data")
    none = F.lit(None).cast(ERROR)
    html_ok = F.col("format").isin("html", "markdown")
    found = F.coalesce(
        locale_tenant(F.col("locale"), F.col("tenant")),
        F.when(~F.col("format").isin(*tables.FORMATS), error("format must be plain, html or markdown", "UNSUPPORTED_FORMAT")),
        F.when(F.coalesce(data, F.lit("")) == "", error("data is required", "MISSING_DATA", 400)),
        F.when(has_markup(data) & ~html_ok, error("markup is not allowed", "HTML_NOT_ALLOWED")) if cfg.detect_html else none,
        F.when(has_sql(data), error("input looks like a statement", "MALICIOUS_INPUT")) if cfg.detect_sql else none,
        F.when(symbol_only(data), error("text has no letters", "SYMBOL_ONLY")) if cfg.reject_symbol_only else none,
        over_limit(data, cfg.token_limit),
        semantic_error(semantic(data, cfg)),
        language_error(F.col("locale"), data, cfg) if cfg.check_language else none,
    )
    return df.withColumn("error", found)


def split(df: DataFrame, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows."""
    v = verdicts(df, cfg)
    return v.where("error is null").drop("error"), v.where("error is not null")
