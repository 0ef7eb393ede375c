"""Phones, dates, ranges and titles rewritten for the row's locale.

Each pass is one substitution over the text the last pass left, on a state of
struct(text, changes); a pass logs what it changed.  Only expressions: no
shuffle, no Python.  What is already in the target form is matched first and
left alone, as are dates and dotted quads in the phone passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.spans import let, logged, replace_logged, replace_matches

_DONE = r"\(\+\d{1,3}\)\s*\d[\d ]*\d"
_DATE_OR_IP = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b"
_MONTH = tables.ANY_MONTH
REVIEW = "[PLEASE REVIEW]"
#: Pattern, what a match becomes, and the name it is logged under.
Pass = tuple[str, Callable[[Column], Column], str]


def _codes() -> Column:
    return F.split(F.lit(" ".join(tables.calling_codes())), " ")


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def grouped(s: Column, *sizes: int) -> Column:
    """Digits in groups of these sizes, the rest as a last group."""
    parts, at = [], 1
    for n in sizes:
        parts.append(F.substring(s, at, n))
        at += n
    parts.append(F.substring(s, F.lit(at), F.length(s)))
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def id_landline(area: Column, sub: Column) -> Column:
    n = F.length(sub)
    body = F.when(n == 6, grouped(sub, 3, 3)).when(n == 7, grouped(sub, 3, 2, 2)).when(n == 8, grouped(sub, 4, 4)).when(n == 9, grouped(sub, 3, 2, 2, 2)).otherwise(grouped(sub, 3, 3, 3))
    return F.concat(F.lit("("), area, F.lit(") "), body)


def id_mobile(nsn0: Column) -> Column:
    n = F.length(nsn0)
    return F.when(n == 10, grouped(nsn0, 4, 3, 3)).when(n == 11, grouped(nsn0, 4, 4, 3)).when(n == 12, grouped(nsn0, 4, 4, 4)).otherwise(grouped(nsn0, 4, 3, 4))


def intl_landline(cc: Column, area0: Column, sub: Column, prefer_43: Column | None = None) -> Column:
    n = F.length(sub)
    seven = grouped(sub, 3, 2, 2) if prefer_43 is None else F.when(prefer_43, grouped(sub, 4, 3)).otherwise(grouped(sub, 3, 2, 2))
    body = F.when(n == 6, grouped(sub, 3, 3)).when(n == 7, seven).when(n == 8, grouped(sub, 4, 4)).otherwise(grouped(sub, 3, 2, 2, 2))
    return F.concat(F.lit("(+"), cc, F.lit(") "), F.regexp_replace(area0, "^0", ""), F.lit(" "), body)


def intl_mobile(cc: Column, nsn0: Column) -> Column:
    n, digits = F.length(nsn0), F.substring(nsn0, F.lit(2), F.length(nsn0))
    body = F.when(n == 10, grouped(digits, 3, 3, 3)).when(n == 11, grouped(digits, 3, 4, 3)).otherwise(grouped(digits, 3, 4, 4))
    return F.concat(F.lit("(+"), cc, F.lit(") "), body)


def with_code(raw: Column) -> Column:
    """A number after its plus sign: the likeliest calling code, then the national form."""

    def body(d: Column) -> Column:
        def candidate(n: int) -> Column:
            rest = F.concat(F.lit("0"), F.substring(d, F.lit(n + 1), F.length(d)))
            score = F.when(rest.startswith("08"), 3).when(rest.startswith("021"), 2).when(rest.rlike("^0[23]"), 1).otherwise(0)
            return F.struct(score.alias("score"), F.lit(-n).alias("short"), F.left(d, F.lit(n)).alias("cc"), rest.alias("nsn0"))

        every = F.filter(F.array(*(candidate(n) for n in (1, 2, 3))), lambda c: F.length(c["nsn0"]) > 1)
        known = F.filter(every, lambda c: F.array_contains(_codes(), c["cc"]))
        best = F.array_max(F.when(F.size(known) > 0, known).otherwise(every))

        def render(b: Column) -> Column:
            nsn0 = b["nsn0"]
            hint = raw.rlike(r"\d{4}\D+\d{3}\s*$")
            land = intl_landline(b["cc"], F.left(nsn0, F.lit(3)), F.substring(nsn0, F.lit(4), F.length(nsn0)), hint)
            return F.when(nsn0.rlike("^0[23]"), land).otherwise(intl_mobile(b["cc"], nsn0))

        return F.when(F.length(d) < 2, raw).otherwise(let(best, render))

    return let(_only_digits(raw), body)


def _first_code(d: Column) -> Column:
    """The shortest calling code in use that the digits start with."""
    return F.get(F.filter(F.array(*(F.left(d, F.lit(n)) for n in (1, 2, 3))), lambda c: F.array_contains(_codes(), c) & (F.length(d) > F.length(c))), F.lit(0))


def phone_passes() -> list[Pass]:
    steps: list[Pass] = []
    skip = lambda p: p.rlike(rf"^(?:{_DONE}|{_DATE_OR_IP})$")
    steps.append((rf"{_DONE}|\+\d{{1,3}}(?:[\s.()-]*+\d)++", lambda p: F.when(p.startswith("+"), with_code(p)).otherwise(p), "cc-as-zero"))

    def spaced(p: Column) -> Column:
        d = _only_digits(p)
        ok = ~skip(p) & F.length(d).between(7, 13) & p.rlike(r"\D") & _first_code(d).isNotNull()
        return F.when(ok, with_code(F.concat(F.lit("+"), d))).otherwise(p)

    steps.append((rf"{_DONE}|{_DATE_OR_IP}|(?<!\d)\d{{1,3}}(?:[\s.()-]*+\d){{6,}}+(?!\d)", spaced, "cc-plain-spaced"))

    def plain(p: Column) -> Column:
        cc = _first_code(p)
        ok = ~skip(p) & ~p.startswith("0") & cc.isNotNull()
        return F.when(ok, let(cc, lambda c: intl_mobile(c, F.concat(F.lit("0"), F.substring(p, F.length(c) + 1, F.length(p)))))).otherwise(p)

    steps.append((rf"{_DONE}|{_DATE_OR_IP}|\b\d{{7,13}}\b", plain, "cc-plain-digits"))

    def land(p: Column) -> Column:
        greedy_area = F.regexp_extract(p, r"^0(2\d{1,2})\d{6,8}$", 1)
        area = F.when(greedy_area.startswith("21"), F.lit("021")).otherwise(F.concat(F.lit("0"), greedy_area))
        return let(area, lambda a: id_landline(a, F.substring(p, F.length(a) + 1, F.length(p))))

    steps.append((r"(?<!\d)02\d{1,2}\d{6,8}(?!\d)", land, "regex-landline"))

    def mobile(p: Column) -> Column:
        return let(_only_digits(p), lambda d: F.when(d.startswith("08") & F.length(d).between(10, 12), intl_mobile(F.lit("62"), d)).otherwise(p))

    steps.append((r"(?<!\d)0(?:[ .()-]?\d){9,11}(?!\d)", mobile, "regex-mobile"))
    return steps


def _month_place(name: Column) -> Column:
    """The month's place among all names, 1 to 36 (English, Indonesian, French); 0: no month."""
    plain = [n.lower().translate(_PLAIN) for n in (*tables.MONTHS_EN, *tables.MONTHS_ID, *tables.MONTHS_FR)]
    return F.array_position(F.split(F.lit(" ".join(plain)), " "), F.translate(F.lower(name), "éû", "eu"))


_PLAIN = str.maketrans("éû", "eu")


def _month(name: Column) -> Column:
    place = _month_place(name)
    return F.when(place > 0, F.pmod(place - 1, F.lit(12)) + 1).cast("int")


def _own_name(name: Column) -> Column:
    """The month's name in the language it is in already."""
    shown = [n[:1].upper() + n[1:] for n in (*tables.MONTHS_EN, *tables.MONTHS_ID, *tables.MONTHS_FR)]
    return F.get(F.split(F.lit(" ".join(shown)), " "), (_month_place(name) - 1).cast("int"))


def month_name(locale: Column, month: Column) -> Column:
    def pick(names: list[str]) -> Column:
        return F.get(F.split(F.lit(" ".join(n[:1].upper() + n[1:] for n in names)), " "), month - 1)

    low = F.lower(F.coalesce(locale, F.lit("")))
    return F.when(low.startswith("id"), pick(tables.MONTHS_ID)).when(low.startswith("fr"), pick(tables.MONTHS_FR)).otherwise(pick(tables.MONTHS_EN))


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _part(p: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(p, f"(?iu)^{pattern}$", group)


def _dated(p: Column, locale: Column, day: Column, month: Column, year: Column, keep_zero: bool | Column = False, own: Column | None = None) -> Column:
    """D Month YYYY, or a mark to review what is no day; the month in the locale's language or by its ``own`` name."""

    def body(x: Column) -> Column:
        d, m, y = x["d"], x["m"], x["y"]
        shown = F.when(F.lit(keep_zero) if isinstance(keep_zero, bool) else keep_zero, day).otherwise(d.cast("string"))
        name = month_name(locale, m) if own is None else own
        good = F.concat(shown, F.lit(" "), name, F.lit(" "), year)
        flag = F.concat(F.lit(f"{REVIEW} "), name, F.lit(" "), year)
        return F.when(m.isNull() | ~m.between(1, 12), p).when((d >= 1) & (d <= days_in_month(y, m)), good).otherwise(flag)

    return let(F.struct(day.try_cast("int").alias("d"), month.alias("m"), year.try_cast("int").alias("y")), body)


def date_passes(locale: Column) -> list[Pass]:
    steps: list[Pass] = []
    a = rf"\b({_MONTH})\s+(\d{{1,2}})(?:\s*+,\s*+|\s++)(\d{{4}})\b"
    steps.append((_quiet(a), lambda p: _dated(p, locale, _part(p, a, 2), _month(_part(p, a, 1)), _part(p, a, 3)), "datefmt_name"))
    b = rf"\b(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b"
    steps.append((_quiet(b), lambda p: _dated(p, locale, _part(p, b, 1), _month(_part(p, b, 2)), _part(p, b, 3), keep_zero=True), "datefmt_dayfirst"))
    c = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
    steps.append((_quiet(c), lambda p: _dated(p, locale, _part(p, c, 1), _part(p, c, 2).try_cast("int"), _part(p, c, 3)), "datefmt"))
    for pattern, d, m, y in [
        (rf"\b({_MONTH})\s++(\d{{4}})(?:\s*+,\s++|\s++)(\d{{1,2}})\b", 3, 1, 2),
        (rf"\b(\d{{1,2}})\s++(\d{{4}})\s*+,?+\s*+({_MONTH})\b", 1, 3, 2),
        (rf"\b(\d{{4}})\s*+,?+\s*+({_MONTH})\s++(\d{{1,2}})\b", 3, 2, 1),
        (rf"\b(\d{{4}})\s++(\d{{1,2}})\s*+,?+\s*+({_MONTH})\b", 2, 3, 1),
    ]:

        def reorder(p: Column, x: str = pattern, d: int = d, m: int = m, y: int = y) -> Column:
            day = _part(p, x, d)
            keeps = day.rlike("^0[0-9]$") & ~F.coalesce(F.lower(locale).startswith("id"), F.lit(False))
            return _dated(p, locale, day, _month(_part(p, x, m)), _part(p, x, y), keep_zero=keeps, own=_own_name(_part(p, x, m)))

        steps.append((_quiet(pattern), reorder, "datefmt_reorder"))
    e = rf"\b(\d{{4}})\s*+,?+\s*+({_MONTH})\b(?!\s+\d)"
    steps.append((_quiet(e), lambda p: F.concat(month_name(locale, _month(_part(p, e.replace(r'(?!\s+\d)', ''), 2))), F.lit(" "), _part(p, e.replace(r"(?!\s+\d)", ""), 1)), "monthyear_yearfirst"))
    f = rf"\b({_MONTH})\s*+,?+\s*+(\d{{4}})\b"
    steps.append((_quiet(f), lambda p: F.concat(month_name(locale, _month(_part(p, f, 1))), F.lit(" "), _part(p, f, 2)), "monthyear_monthfirst"))
    steps.append((rf"\b[1-9] (?:{'|'.join(dict.fromkeys([*tables.MONTHS_EN, *tables.MONTHS_ID, *(m.capitalize() for m in tables.MONTHS_FR)]))}) \d{{4}}\b", lambda p: F.when(p.rlike("^0"), p).otherwise(F.concat(F.lit("0"), p)), "date_zero_pad"))
    g = rf"\b({tables.RANGE_FROM})\b\s+({_MONTH})\s+(\d{{4}})\s+({tables.RANGE_TO})\s+({_MONTH})\s+(\d{{4}})\b"

    def swap_months(p: Column) -> Column:
        x = [_part(p, g, i) for i in range(1, 7)]
        later = (x[2] > x[5]) | ((x[2] == x[5]) & (_month(x[1]) > _month(x[4])))
        return F.when(later, F.concat_ws(" ", x[0], x[4], x[5], x[3], x[1], x[2])).otherwise(p)

    steps.append((_quiet(g), swap_months, "monthyear_range_swap"))
    h = rf"\b({tables.RANGE_FROM})\b\s+(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\s+({tables.RANGE_TO})\s+(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b"

    def swap_dates(p: Column) -> Column:
        x = [_part(p, h, i) for i in range(1, 9)]
        one = F.struct(x[3].try_cast("int"), _month(x[2]), x[1].try_cast("int"))
        two = F.struct(x[7].try_cast("int"), _month(x[6]), x[5].try_cast("int"))
        ok = x[1].try_cast("int").between(1, days_in_month(x[3].try_cast("int"), _month(x[2]))) & x[5].try_cast("int").between(1, days_in_month(x[7].try_cast("int"), _month(x[6])))
        return F.when(ok & (one > two), F.concat_ws(" ", x[0], x[5], x[6], x[7], x[4], x[1], x[2], x[3])).otherwise(p)

    steps.append((_quiet(h), swap_dates, "date_range_swap"))
    return steps


def _quiet(pattern: str) -> str:
    """The pattern ignoring case and without groups, to find whole matches."""
    out = pattern.replace("(?:", "\0").replace("(?!", "\2").replace("(?<", "\3").replace("\\(", "\4").replace("(", "(?:")
    return "(?iu)" + out.replace("\0", "(?:").replace("\2", "(?!").replace("\3", "(?<").replace("\4", "\\(")


def title_passes() -> list[Pass]:
    steps: list[Pass] = []
    name = r"(?:\[[A-Z][A-Z_]*_\d+\]|[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’-]*)"
    for pattern, written in tables.TITLES:
        words = tables.TITLE_EXCEPTIONS.get(pattern)
        hold = rf"(?!(?:{'|'.join(words)})(?![A-Za-zÀ-ÖØ-öø-ÿ'’-]))" if words else ""
        steps.append((rf"(?iu)(?<!\w){pattern}\s+{hold}{name}", lambda p, w=written, x=pattern: F.regexp_replace(p, rf"(?iu)^{x}\s+", f"{w} "), "honorific_cap"))
    return steps


#: What stands for digits and the plus sign where phone passes mustn't look.
_SHIELD = "".join(map(chr, range(0xE000, 0xE00B)))
_OPEN = "0123456789+"


def protect(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Every match (that is ``wanted``) with its digits shielded; ``restore`` brings them back."""
    shield = lambda p: F.translate(p, _OPEN, _SHIELD)
    return replace_matches(text, pattern, shield if wanted is None else lambda p: F.when(wanted(p), shield(p)).otherwise(p))


def restore(text: Column) -> Column:
    return F.translate(text, _SHIELD, _OPEN)


def tenant_allows(tenant: Column, name: str) -> Column:
    """Labelled numbers are a tenant's own business; an unnamed tenant has all rules."""
    return F.lower(F.trim(F.coalesce(tenant, F.lit("")))).isin("", name)


def protect_thai(text: Column) -> Column:
    """Numbers of identity cards, pairs of Buddhist and common years on lines of dates, registered addresses."""
    out = protect(text, tables.TH_CARD_LINE)
    out = replace_matches(out, tables.TH_DATE_LINE, lambda line: protect(line, tables.TH_YEAR_PAIR))
    return protect(out, tables.TH_ADDRESS_LINE)


def _card_digits(p: Column) -> Column:
    return _only_digits(F.regexp_extract(p, r"\(([^)]*)\)$", 1))


def compact_card(p: Column) -> Column:
    """An identity card's twelve digits without what stands between them."""
    return F.when(F.length(_card_digits(p)) == 12, F.concat(F.regexp_extract(p, r"^([^(]*\()", 1), _card_digits(p), F.lit(")"))).otherwise(p)


def protect_malaysian(text: Column) -> Column:
    return protect(text, tables.MY_CARD, lambda p: F.length(_card_digits(p)) == 12)


def without_doubled_codes(text: Column) -> Column:
    """(+(+62) and ((+62) are (+62)."""
    return F.regexp_replace(F.regexp_replace(text, r"\(\+\(\+(\d{1,3})\)", "(+$1)"), r"\(\(\+(\d{1,3})\)", "(+$1)")


def reformat_documents(df: DataFrame, text_col: str = "text", locale_col: str = "locale", final_col: str = "final", tenant_col: str | None = None) -> DataFrame:
    """Adds the final text, the changes (spans as of their pass) and changed_count.

    A null text stays null and has no changes.  Without ``tenant_col`` the
    tenant counts as unnamed.  Labelled card numbers, year pairs and addresses
    are shielded from the phone passes; a text that holds characters of the
    shield itself is not.
    """
    tenant = F.col(tenant_col) if tenant_col else F.lit("")
    out = df.withColumn("_r", logged(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("_held", ~F.col("_r.text").rlike(f"[{_SHIELD}]"))

    def run(passes: list[Pass]) -> None:
        nonlocal out
        for pattern, new, via in passes:
            out = out.withColumn("_r", replace_logged(F.col("_r"), pattern, new, via))

    def rewritten(text: Column) -> None:
        nonlocal out
        out = out.withColumn("_r", F.struct(text.alias("text"), F.col("_r.changes").alias("changes")))

    plus, *phones = phone_passes()
    run([plus])
    thai, malaysian = (F.col("_held") & tenant_allows(tenant, name) for name in ("thailand", "malaysia"))
    rewritten(F.when(thai, protect_thai(F.col("_r.text"))).otherwise(F.col("_r.text")))
    out = out.withColumn("_r", F.when(tenant_allows(tenant, "malaysia"), replace_logged(F.col("_r"), tables.MY_CARD, compact_card, "my_nric_compact")).otherwise(F.col("_r")))
    rewritten(F.when(malaysian, protect_malaysian(F.col("_r.text"))).otherwise(F.col("_r.text")))
    run(phones)
    clean = without_doubled_codes(F.col("_r.text"))
    rewritten(F.when(F.col("_held"), restore(clean)).otherwise(clean))
    run([*date_passes(F.col(locale_col)), *title_passes()])
    out = out.drop("_held")
    final = F.when(F.col(text_col).isNotNull(), F.col("_r.text"))
    return out.withColumn("changes", F.col("_r.changes")).withColumn(final_col, final).drop("_r").withColumn("changed_count", F.size("changes"))
