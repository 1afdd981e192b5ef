"""URL filters: host suffixes and path prefixes met with rules on short digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rareflow.llm.common import LOWER, UPPER

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHORT = 8                    # hex digits of a digest that rules and expressions meet on


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_column: str = "url",
               default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each url.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains if the path starts with the rule's. The longest fitting rule wins; of equally
    long ones the one with the longer host; of equal rules the one that blocks. Without one the
    verdict is ``default`` and the rule null. Null urls and urls without ``://`` have an empty
    host and path and fit no rule. Repeated rows are repeated; columns of ``pages`` named like
    a new one are replaced.

    Equal urls are judged once. Prefixes are cut at the lengths that occur among rules, a
    list no longer than the longest rule.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
        "verdict").distinct()
    lengths = sorted(row[0] for row in rules.select(F.length("rule_path")).distinct().collect())
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    keyed = rules.select(
        digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short"),
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"),
                 F.length("rule_host").alias("host_size"), "rule_host", "rule_path",
                 "verdict").alias("found"))
    base = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": url_host(F.col(url_column)), "path": url_path(F.col(url_column))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
        or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    expressions = (base.where("host <> ''").select("host", "path").distinct()
                   .withColumn("suffix", F.explode(suffixes))
                   .withColumn("prefix", F.explode(prefixes))
                   .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
                   .withColumn("short", F.substring("digest", 1, SHORT)))
    winners = (expressions.join(keyed, "short").where("digest = rule_digest")
               .groupBy("host", "path").agg(F.max("found").alias("found")))
    return (base.join(winners, ["host", "path"], "left")
            .withColumn("rule", F.concat("found.rule_host", "found.rule_path"))
            .withColumn("verdict", F.coalesce("found.verdict", F.lit(default)))
            .select(*[c for c in base.columns], "rule", "verdict"))
