"""Grouped folds: all rows of a sample in one fold."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelark.operators.grids import attached
from tidelark.operators.stats import quantiles


def round_robin(df: DataFrame, group: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: groups in the order of a seeded hash, dealt in turn. Ranks are over groups, not rows, and joined back.

    Groups are ranked within ranges of their hash; what ranges before hold, one
    number for each, comes from a count. No task ranks all groups.
    """
    digest = F.sha2(F.concat_ws("::", F.lit(str(seed)), F.col(group).cast("string")), 256)
    groups = df.select(group).distinct().withColumn("_digest", digest).withColumn("_range", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int"))
    sizes = {r["_range"]: r["count"] for r in groups.groupBy("_range").count().collect()}
    before = list(accumulate((sizes.get(i, 0) for i in range(255)), initial=0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_digest")) - 1 + F.element_at(F.array(*map(F.lit, before)), F.col("_range") + 1)
    return df.join(groups.select(group, (rank % n_folds).cast("int").alias("fold")), group)


def hashed(df: DataFrame, group: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold by a hash of the group: no shuffle and no ranks, for any number of groups; folds are alike in size only on average."""
    digest = F.sha2(F.concat_ws("::", F.lit(str(seed)), F.col(group).cast("string")), 256)
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_folds).cast("int"))


def stratified(df: DataFrame, keys: list[str], target: str = "target", n_folds: int = 3, seed: int = 42) -> DataFrame:
    """Adds fold by a hash of the row within its class: classes are spread alike, samples aren't kept together."""
    digest = F.sha2(F.concat_ws("::", F.lit(str(seed)), F.col(target).cast("string"), *[F.col(k).cast("string") for k in keys]), 256)
    return df.withColumn("fold", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_folds).cast("int"))


def with_fallback(df: DataFrame, group: str, keys: list[str], target: str = "target", n_folds: int = 3, seed: int = 42) -> tuple[DataFrame, str]:
    """Grouped folds if any is legal, else stratified ones, else two halves; and which it was."""
    n = df.select(group).distinct().count()
    if n >= n_folds:
        dealt = round_robin(df, group, n_folds, seed)
        if legal(dealt, target).head(1):
            return dealt, group
    dealt = stratified(df, keys, target, n_folds, seed)
    if legal(dealt, target).head(1):
        return dealt, "stratified_fallback"
    return hashed(df, keys[0], 2, seed), "simple_fallback"


def balanced(sizes: dict, n_folds: int) -> dict:
    """Largest groups first, each to the lightest fold. For as many groups as a driver holds."""
    weight = np.zeros(n_folds)
    out = {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], str(x[0]))):
        out[g] = int(weight.argmin())
        weight[out[g]] += n
    return out


def legal(df: DataFrame, target: str = "target") -> DataFrame:
    """Folds with both classes inside and outside."""
    counted = df.groupBy("fold").agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n"))
    total = counted.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return attached(counted, total).where("p > 0 and n > 0 and all_p > p and all_n > n").select("fold", "p", "n")


def hard_negatives(df: DataFrame, prob: str, target: str, least: float = 0.5, top: float = 0.1, weight: float = 3.0) -> DataFrame:
    """Adds weight and reason: negatives whose out-of-fold probability reaches the least, or the quantile that leaves the top share."""
    share = min(max(top, 0.0), 1.0)
    negative = (F.col(target) == 0) & F.col(prob).isNotNull() & ~F.isnan(prob)
    cut = quantiles(df.where(negative), [prob], [1.0 - share])[prob][0]
    rows = df.withColumn("_cut", F.lit(cut).cast("double"))
    by_prob = negative & (F.col(prob) >= least)
    by_top = negative & F.coalesce(F.col(prob) >= F.col("_cut"), F.lit(False)) if share > 0 else F.lit(False)
    reason = F.when(by_prob & by_top, "probability_and_top_percentile").when(by_prob, "probability").when(by_top, "top_percentile")
    return rows.withColumn("reason", reason).withColumn("weight", F.when(F.col("reason").isNotNull(), F.lit(weight)).otherwise(F.lit(1.0))).drop("_cut")
