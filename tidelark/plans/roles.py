"""The driver's tables in the roles of recordings, windows and features, in Spark and in SQL.

A sample is a user of `events`, its signal the values in order of time; or a
row of `embeddings`, a stored window of 64 points; features are the numbers of
`lineitem`. Every frame here has its twin as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators import gates, windows

SIZE, STRIDE = 8, 4
#: Gate: level above, ratio below.
DC, RATIO = 3.0, 4.0
THRESHOLD = 0.3
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gap"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, target, idx, v, event_type: one row for each position."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), (F.col("user_id") % 2).cast("int").alias("target"), "event_type", F.col("value").alias("v"), "ts", "event_id")
    return windows.numbered(e, "sample", ["ts", "event_id"]).select("sample", "target", "event_type", "idx", "v")


SIG = "sig AS (SELECT user_id AS sample, CAST(user_id % 2 AS INT) AS target, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events)"
WROWS = f"wrows AS (SELECT *, unnest(generate_series(greatest(CAST(ceil((idx - {SIZE - 1}) / {STRIDE}.0) AS BIGINT), 0), idx // {STRIDE})) AS win FROM sig)"
WPAIRS = "wpairs AS (SELECT *, lag(v) OVER (PARTITION BY sample, win ORDER BY idx) AS u FROM wrows)"


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, target, window, start, dc, ac, ac_dc_ratio, prob of every whole window."""
    gate = gates.gate_features(signal(spark, sf_dir), "sample", "idx", "v", SIZE, STRIDE, {"level": F.avg("v"), "target": F.first("target")})
    prob = F.col("level") / (F.col("level") + 50)
    return gate.select("sample", "target", F.col("window").cast("long").alias("window"), F.col("start").cast("long").alias("start"), "dc", "ac", "ac_dc_ratio", prob.alias("prob"))


WIN = f"""win AS (
  SELECT sample, target, win, win * {STRIDE} AS start, min((u + v) / 2) AS dc, quantile_cont(abs(v - u), 0.5) AS ac,
    quantile_cont(abs(v - u), 0.5) / (abs(min((u + v) / 2)) + 1e-12) AS ac_dc_ratio, avg(v) / (avg(v) + 50) AS prob
  FROM wpairs GROUP BY ALL HAVING count(*) = {SIZE})""".replace("GROUP BY ALL", "GROUP BY sample, target, win")
WINDOWS = f"{SIG}, {WROWS}, {WPAIRS}, {WIN}"


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a small table came as fewer splits; a table of more splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, label, a: an array of 64 doubles."""
    return spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("sample"), "label", F.col("embedding").cast("array<double>").alias("a"))


EMB = "emb AS (SELECT vec_id AS sample, label, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with derived features; gap has missing values."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line"), F.col("l_orderkey").alias("sample"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_returnflag",
        (F.col("l_returnflag") == "R").cast("int").alias("target"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") - 25 * F.col("l_tax")).alias("gap"),
    )


LINES = """lines AS (SELECT l_orderkey || '-' || l_linenumber AS line, l_orderkey AS sample, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(l_returnflag = 'R' AS INT) AS target,
  l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity - 25 * l_tax END AS gap FROM lineitem)"""
LONG = "long AS (UNPIVOT (SELECT line, sample, target, " + ", ".join(FEATURES) + " FROM lines) ON " + ", ".join(FEATURES) + " INTO NAME feature VALUE x)"
