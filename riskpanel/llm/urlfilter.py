"""URL filter lists: host-suffix and path-prefix expressions joined on short digests.

Every distinct (host, path) is expanded into the expressions that a rule for it could have: each suffix of the host that
has as many labels as some rule's host, with each prefix of the path that is as long as some rule's path. Expressions and rules meet in an
equi-join on the first 32 bits of their SHA-256; the full digest is confirmed afterwards, and of the confirmed rules the
longest wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.session import materialize

DIGEST_PREFIX = 8  # hexadecimal digits: 32 bits


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; without ``://`` the empty string."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; without ``://`` the empty string."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """The suffixes of the host that have as many labels as one of ``labels``; nothing for an empty host."""
    have = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    some = F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= have)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(some, lambda n: F.call_function("substring_index", host, F.lit("."), -n)))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (action, host, path) with expression, digest and digest prefix. A null host or path is empty. Of rules with
    the same host and path the one with the smaller action (allow before block) counts."""
    r = (rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("rule_host"),
                      F.coalesce("path", F.lit("")).alias("rule_path"), "action")
         .where("rule_host <> '' and action is not null")
         .groupBy("rule_host", "rule_path").agg(F.min("action").alias("action")))
    return (r.withColumn("rule", F.concat("rule_host", "rule_path"))
            .withColumn("rule_digest", _digest("rule_host", "rule_path"))
            .withColumn("rule_key", F.substring("rule_digest", 1, DIGEST_PREFIX)))


def _digest(host: str, path: str) -> Column:
    # the lengths keep "a.b" + "c/" and "a." + "bc/" apart
    return F.sha2(F.concat_ws("\n", F.length(host).cast("string"), host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each url.

    A rule fits its host and all subdomains when the path starts with the rule's path; the longest rule (characters of
    host and path together, then of the host) decides. Urls that no rule fits get a null rule and ``default``. A null
    url, or one without ``://``, has empty host and path and fits no rule. Repeated rows stay repeated; an empty table
    gives an empty result. Columns of the four names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    table = rule_table(rules)
    lengths = sorted(r[0] for r in table.select(F.length("rule_path")).distinct().collect())  # at most a path's length
    labels = sorted(r[0] for r in table.select(F.size(F.split("rule_host", r"\."))).distinct().collect())  # as many as rules are deep
    named = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    if not lengths:
        return named.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    places = named.select("host", "path").distinct()
    wide = (places.withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels)))
            .withColumn("n", F.explode(F.array(*[F.lit(x) for x in lengths])))
            .where(F.length("path") >= F.col("n"))
            .withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n"))))
    # a common expression (a top-level domain) is digested and joined once, not once for each url
    asked = wide.select("suffix", "prefix").distinct()
    asked = asked.withColumn("digest", _digest("suffix", "prefix")) \
        .withColumn("key", F.substring("digest", 1, DIGEST_PREFIX))
    hit = (asked.join(table, F.col("key") == F.col("rule_key")).where("digest = rule_digest")
           .select("suffix", "prefix", "rule", "action", F.length("rule_host").alias("host_length")))
    # a table of its own, so that a suffix with a third of all urls can be split, or the few hits broadcast by their size
    best = (wide.join(materialize(hit), ["suffix", "prefix"])
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("l"), "host_length", "rule", "action")).alias("w"))
            .select(F.col("host").alias("__host"), F.col("path").alias("__path"), "w.rule", F.col("w.action").alias("verdict")))
    return (named.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
            .drop("__host", "__path").withColumn("verdict", F.coalesce("verdict", F.lit(default))))
