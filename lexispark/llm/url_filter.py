"""URL filter: host-suffix and path-prefix expressions against hashed rules.

A URL is expanded into the suffixes of its host of as many labels as some rule's
host has, times the prefixes of its path whose lengths occur among the rules, so
a host of thousands of labels costs no more than any other.  Expressions and
rules meet in an equi-join on the first bytes of their digests; full digests
then confirm, and the longest rule wins (a tie goes to the longer host, then to
block).  Equal URLs are judged once, so a hot host or URL costs its distinct
URLs only; the rules are broadcast only while they are few (Spark's own
threshold), else they are shuffled like any join side.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and gets the method's verdict, allow (what no rule names passes);
repeated rows each get the same answer; without rules everything is allowed;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BYTES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNLISTED = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256))


def rules_table(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return pages.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    rules: rule_host, rule_path, rule_verdict; rows with a null are no rules.
    """
    rules = rules.select("rule_host", "rule_path", "rule_verdict").where("rule_host is not null and rule_path is not null and rule_verdict is not null").withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path")))
    rules = rules.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_BYTES))
    # The distinct path lengths and label counts of the rules, short arrays whatever the number of rules.
    lengths = sorted(r[0] for r in rules.select(F.char_length("rule_path")).distinct().collect())
    labels = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\."))).distinct().collect())
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    dots = F.char_length("host") - F.char_length(F.translate("host", ".", ""))
    hosts = F.array_compact(F.array(*(F.when(dots >= n - 1, F.substring_index("host", ".", -n)) for n in labels)) if labels else F.array().cast("array<string>"))
    sizes = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length("path"))
    known = rows.select("host", "path").where("host != ''").distinct()
    asked = known.withColumn("suffix", F.explode(hosts)).withColumn("start", F.explode(F.transform(sizes, lambda n: F.substring(F.col("path"), F.lit(1), n))))
    asked = asked.withColumn("full", digest(F.col("suffix"), F.col("start"))).withColumn("prefix", F.substring("full", 1, PREFIX_BYTES))
    met = asked.join(rules, "prefix").where("full = rule_digest")
    name = F.concat("rule_host", "rule_path")
    strength = F.struct(F.char_length(name), F.char_length("rule_host"), (F.col("rule_verdict") == "block").cast("int"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), F.col("rule_verdict").alias("verdict")), strength).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(UNLISTED)).alias("verdict"))
