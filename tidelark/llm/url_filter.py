"""URL filters by hash-prefix lists.

Each URL is expanded into expressions, a suffix of its host with a prefix of
its path. An expression meets the rules of a digest prefix, the first four
bytes of SHA-256, by an equi-join; the full digest then confirms one of them,
and the longest rule of a URL wins. Suffixes and prefixes are expanded only at the label counts and
path lengths that rules have, which finds the same rules as all expansions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX_BYTES = 4
#: A list of up to so many rules is broadcast (under 20 MB); a longer one is joined by shuffling.
BROADCAST_RULES = 50_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the contract.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the winning rule, or null) and verdict.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's. The longest rule (host and path together) wins; at equal length the
    longer host, then `block`. Null and empty URLs and those without :// have
    an empty host and path and get `default`, as does every URL no rule fits;
    URLs of any length are read whole. A rule with an empty host fits nothing.
    Repeated rows and null ids are kept. An empty table gives an empty table.
    Other columns, whatever their names, aren't read.
    """
    spark = pages.sparkSession
    # By precedence: a rule's place in this order is what is compared from here on.
    rules = sorted({r for r in rules if r.host}, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block", r))
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    after = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    parts = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
        .select("id", F.coalesce(after, F.lit("")).alias("rest"))
        .select("id", "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("raw"))
        .select("id", F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0).alias("path"))
    )
    out = [F.col("id").alias(id_col), "host", "path"]
    if not rules:
        return parts.select(*out, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    small = len(rules) <= BROADCAST_RULES
    listed = spark.createDataFrame([(i, r.host, r.path, r.verdict) for i, r in enumerate(rules)], "place int, r_host string, r_path string, verdict string")
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    entries = listed.select(digest.alias("digest"), "place").groupBy(F.substring("digest", 1, 2 * PREFIX_BYTES).alias("r_prefix")).agg(F.collect_list(F.struct("digest", "place")).alias("entries"))
    texts = listed.select(F.col("place").alias("r_place"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    if small:
        entries, texts = F.broadcast(entries), F.broadcast(texts)

    # The first expression of every URL is null: it carries the URL through the join once.
    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    made = [F.when((n_labels >= k) & (F.length("path") >= n), F.concat_ws("\n", F.substring_index("host", ".", -k), F.substring("path", 1, n))) for k in labels for n in lengths]
    found = F.filter(F.array(*made), lambda x: x.isNotNull())
    rows = (
        parts.select("id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), found)).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("full", 1, 2 * PREFIX_BYTES))
    )
    confirmed = F.array_max(F.transform(F.filter("entries", lambda e: e["digest"] == F.col("full")), lambda e: e["place"]))
    hits = rows.join(entries, F.col("prefix") == F.col("r_prefix"), "left").select("id", "host", "path", F.col("expression").isNull().alias("first"), confirmed.alias("place")).where("first or place is not null")
    # One number for each URL and expression that hits: the greatest is known before the shuffle, so hot URLs and hosts stay small.
    judged = hits.groupBy("id", "host", "path").agg(F.max("place").alias("place"), F.count(F.when(F.col("first"), 1)).alias("n"))
    named = judged.join(texts, F.col("place") == F.col("r_place"), "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return named.select(*out, "rule", "verdict", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("copy")
