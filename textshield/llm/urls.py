"""URL filters: host-suffix and path-prefix expressions met by short hash prefixes.

A rule is a host and a path prefix (``org/``, ``example.org/es/``) with a
verdict.  It fits its host and all subdomains where the URL's path starts with
the rule's.  Each URL is expanded into the expressions that could be a rule:
suffixes of its host at label boundaries, followed by prefixes of its path.
Only lengths that some rule has are expanded, so a long host or path costs no
more than there are shapes of rules.  Expressions and rules meet in an
equi-join on the first 32 bits of their SHA-256; the full digest confirms.

Verdicts are gathered by a row number, so a URL that a third of all rows repeat
is dealt like any other.  Rules are broadcast while their table is small, as
counted; beyond that they are joined by prefix, and the prefixes that many
expressions share (``com/``) are matched by broadcast.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_rows, join_hot

#: Hexadecimal digits of the short prefix: 32 bits.
PREFIX = 8
#: Characters of rules, digests included, that are broadcast at most.
BROADCAST_CHARS = 32_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def compiled(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule, verdict, host_len, path_len) of rules (host, path, verdict).

    Hosts are lower-cased; null hosts or paths count as empty.  Of rules that
    repeat with different verdicts block stays.
    """
    host = F.translate(F.coalesce("host", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    path = F.coalesce("path", F.lit(""))
    named = rules.where("verdict is not null").select(host.alias("h"), path.alias("p"), "verdict")
    # "allow" sorts before "block"
    one = named.groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("h", "p")
    return one.select(F.left(_digest(rule), F.lit(PREFIX)).alias("prefix"), _digest(rule).alias("digest"), rule.alias("rule"), "verdict", F.length("h").alias("host_len"), F.length("p").alias("path_len"))


def expressions(host: Column, path: Column, shapes: Column) -> Column:
    """Expressions of a URL that have the shape of a rule.

    ``shapes``: array of struct(host_len, path_lens), one for each length of a
    rule's host.  A suffix counts if it is the whole host or follows a dot.
    """
    def fits(s: Column) -> Column:
        n, own = s["host_len"], F.length(host)
        return (own == n) | ((own > n) & (F.substring(host, own - n, F.lit(1)) == "."))

    def of_host(s: Column) -> Column:
        suffix = F.substring(host, F.length(host) - s["host_len"] + 1, s["host_len"])
        return F.transform(F.filter(s["path_lens"], lambda n: n <= F.length(path)), lambda n: F.concat(suffix, F.substring(path, F.lit(1), n)))

    return F.flatten(F.transform(F.filter(shapes, fits), of_host))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(id, host, path, rule, verdict), one row for each row of ``pages``.

    Of the rules that fit, the longest (host and path together) decides, then
    the longer host; without one ``rule`` is null and the verdict ``default``.
    Null URLs and those without ``://`` have an empty host and path.  Repeated
    rows and null ids are judged row by row; an empty table gives no rows, an
    empty rule table the default for all.  Other columns are ignored.  Rows are
    numbered by the partition they are read from, so ``pages`` should be read
    from files or a written table.
    """
    table = compiled(rules)
    sizes = table.agg(F.sum(F.length("rule") + 2 * 64).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(F.monotonically_increasing_id().alias("rid"), "id", host.alias("host"), path.alias("path"))
    if not sizes["n"]:
        return rows.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # one row; there are no more shapes than lengths of hosts times lengths of paths
    shapes = table.groupBy("host_len").agg(F.sort_array(F.collect_set("path_len")).alias("path_lens")).agg(F.collect_list(F.struct("host_len", "path_lens")).alias("shapes")).first()["shapes"]
    listed = F.from_json(F.lit(json.dumps([{"host_len": s["host_len"], "path_lens": s["path_lens"]} for s in shapes])), "array<struct<host_len:int,path_lens:array<int>>>")
    wide = rows.withColumn("e", F.explode_outer(expressions(F.col("host"), F.col("path"), listed)))
    wide = wide.withColumn("own", _digest(F.col("e"))).withColumn("prefix", F.left("own", F.lit(PREFIX))).drop("e")
    if sizes["chars"] <= broadcast_chars:
        met = wide.join(F.broadcast(table), "prefix", "left")
    else:
        entries = table.groupBy("prefix").agg(F.collect_list(F.struct("digest", "rule", "verdict", "host_len", "path_len")).alias("r"))
        hot = wide.where("prefix is not null").groupBy("prefix").count().where(F.col("count") > hot_rows(pages.count())).select("prefix")
        # null prefixes are spread, not joined
        found = join_hot(wide.where("prefix is not null"), entries, "prefix", hot, "left")
        found = found.withColumn("r", F.explode_outer("r")).select(*wide.columns, "r.*")
        met = found.unionByName(wide.where("prefix is null").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "prefix")))
    right = F.col("digest") == F.col("own")
    best = F.max(F.when(right, F.struct((F.col("host_len") + F.col("path_len")).alias("n"), "host_len", "rule", F.col("verdict").alias("v")))).alias("best")
    judged = met.groupBy("rid", "id", "host", "path").agg(best)
    return judged.select("id", "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["v"], F.lit(default)).alias("verdict"))
