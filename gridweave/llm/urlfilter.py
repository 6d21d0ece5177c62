"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into (host suffix, path prefix) expressions, which meet the rules by equi-join on
the first four bytes of a SHA-256; the full digest then confirms, and the longest rule decides. Built
from DataFrame functions only. Host suffixes are taken with as many labels as some rule's host has, so a
URL has at most (label counts x path lengths of the rules) expressions, however long its host is.

A rule is (host, path, verdict). It fits its host and every subdomain of it, where the URL's path starts
with the rule's path. Path prefixes are taken at the lengths that rules' paths have, so any path prefix
is exact. Of several rules that fit the longest host + path wins, on a tie the longer host, then the
smaller string; two rules with the same host and path: the smaller verdict ("allow" before "block").

Defined results: a null url or one without "://" has empty host and path and gets the default verdict;
an empty rule list gives the default everywhere; repeated rows stay; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this many rules are broadcast (about 150 bytes each); more are joined by shuffle.
BROADCAST_RULES = 50_000
#: Bytes of the digest that form the join key.
SHORT_HEX = 8
DEFAULT = "allow"


def host_and_path(url):
    """Columns for the host and the path of a URL, both empty where there is no "://"."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, upper, lower), path


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [(h, p, v) for h, p, v in rules]
    base = spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string")
    full = F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256)
    return (
        base.groupBy("rule_host", "rule_path")
        .agg(F.min("rule_verdict").alias("rule_verdict"))
        .select("*", F.concat("rule_host", "rule_path").alias("rule"), full.alias("digest"), F.substring(full, 1, SHORT_HEX).alias("short"))
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule (null where none fits), verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = F.array(*(F.lit(n) for n in sorted({len(p) for _, p, _ in rules})))
    counts = sorted({h.count(".") + 1 for h, _, _ in rules})
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*(F.when(labels >= n, F.substring_index("host", ".", -n)) for n in counts)), lambda h: h.isNotNull())
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\x00", h, p), 256))))
    table = rule_table(pages.sparkSession, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    keyed = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("asked", F.explode_outer(asked))
    keyed = keyed.withColumn("short", F.substring("asked", 1, SHORT_HEX))
    found = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", F.col("rule_verdict").alias("verdict"))
    # a URL's expressions leave one task, so its rules are reduced to the longest before the shuffle
    best = (
        keyed.join(table, "short", "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max(F.when(F.col("asked") == F.col("digest"), found)).alias("best"))
    )
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
