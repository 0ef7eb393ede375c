"""Numbering plans: which region a number is of, and whether it can be one.

A number is its digits with the calling code first.  The longest prefix that a
plan lists decides; a number is possible if the digits after the calling code
are as many as the plan allows there.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let


class Range(NamedTuple):
    region: str
    code: str
    national: str
    kind: str
    least: int
    most: int


# Fixed values. Public numbering plans: region, calling code, first national digits (blank-separated), kind, fewest and most national digits.
_PLANS = [
    ("ID", "62", "8", "mobile", 9, 12), ("ID", "62", "2 3 4 5 6 7 9", "fixed", 8, 11),
    ("MY", "60", "1", "mobile", 9, 10), ("MY", "60", "3", "fixed", 9, 9), ("MY", "60", "4 5 6 7 8 9", "fixed", 8, 8),
    ("SG", "65", "8 9", "mobile", 8, 8), ("SG", "65", "3 6", "fixed", 8, 8),
    ("TH", "66", "6 8 9", "mobile", 9, 9), ("TH", "66", "2 3 4 5 7", "fixed", 8, 8),
    ("PH", "63", "9", "mobile", 10, 10), ("PH", "63", "2", "fixed", 8, 9), ("PH", "63", "3 4 5 6 7 8", "fixed", 9, 9),
    ("US", "1", "2 3 4 5 6 7 8 9", "fixed or mobile", 10, 10),
    ("GB", "44", "7", "mobile", 10, 10), ("GB", "44", "1", "fixed", 9, 10), ("GB", "44", "2 3", "fixed", 10, 10),
    ("FR", "33", "6 7", "mobile", 9, 9), ("FR", "33", "1 2 3 4 5 9", "fixed", 9, 9),
    ("DE", "49", "15 16 17", "mobile", 10, 11), ("DE", "49", "2 3 4 5 6 7 8 9", "fixed", 5, 11),
    ("ES", "34", "6 7", "mobile", 9, 9), ("ES", "34", "8 9", "fixed", 9, 9),
    ("AU", "61", "4", "mobile", 9, 9), ("AU", "61", "2 3 7 8", "fixed", 9, 9),
]

#: What is dialled before a national number within the region.
TRUNK = {"ID": "0", "MY": "0", "SG": "", "TH": "0", "PH": "0", "US": "1", "GB": "0", "FR": "0", "DE": "0", "ES": "", "AU": "0"}
FOUND = "struct<region:string,code:string,kind:string,national:string,possible:boolean>"


def ranges() -> list[Range]:
    return [Range(region, code, n, kind, least, most) for region, code, first, kind, least, most in _PLANS for n in first.split()]


def planned_codes() -> list[str]:
    return sorted({r.code for r in ranges()})


def lookup(digits: Column) -> Column:
    """struct(region, code, kind, national, possible) of a number, null where no plan lists its beginning."""
    table = F.create_map(*(x for r in ranges() for x in (F.lit(r.code + r.national), F.struct(F.lit(r.region).alias("region"), F.lit(r.code).alias("code"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.lit(r.most).alias("most")))))
    longest = max(len(r.code + r.national) for r in ranges())

    def told(r: Column) -> Column:
        national = F.substring(digits, F.length(r["code"]) + 1, F.length(digits))
        return F.when(r.isNotNull(), F.struct(r["region"].alias("region"), r["code"].alias("code"), r["kind"].alias("kind"), national.alias("national"), F.length(national).between(r["least"], r["most"]).alias("possible")))

    return let(F.coalesce(*(F.try_element_at(table, F.left(digits, F.lit(n))) for n in range(longest, 1, -1))), told)


def classify(df: DataFrame, digits_col: str, into: str = "number") -> DataFrame:
    """Adds ``lookup``'s struct as a column."""
    return df.withColumn(into, lookup(F.col(digits_col)))


def international(dialled: Column, region: Column) -> Column:
    """A number as dialled in a region, as digits with the calling code; null where its region has no plan.

    A plus or 00 stands before a calling code; otherwise the region's trunk
    prefix goes and its code comes first.
    """
    digits = F.regexp_replace(dialled, r"\D", "")
    codes = F.create_map(*(F.lit(x) for r in {(r.region, r.code) for r in ranges()} for x in r))
    trunks = F.create_map(*(F.lit(x) for kv in TRUNK.items() for x in kv))
    code, trunk = F.try_element_at(codes, F.upper(region)), F.try_element_at(trunks, F.upper(region))
    own = F.when((trunk != "") & digits.startswith(trunk), F.substring(digits, F.length(trunk) + 1, F.length(digits))).otherwise(digits)
    return F.when(F.ltrim(dialled).startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, F.lit(3), F.length(digits))).otherwise(F.concat(code, own))
