"""Ranking features: stability over folds, combined scores, limits by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stability(folds: DataFrame, features: DataFrame, top: int = 15) -> DataFrame:
    """freq, avg_importance, avg_rank, count of each feature over folds (fold, feature, importance); those in the first `top` of a fold count."""
    ranked = folds.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature"))).where(F.col("rank") <= top)
    runs = folds.agg(F.count_distinct("fold")).first()[0]
    summed = ranked.groupBy("feature").agg(F.count("*").alias("count"), F.avg("importance").alias("avg_importance"), F.avg("rank").alias("avg_rank"))
    joined = features.join(summed, "feature", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(*features.columns, zero("count"), zero("avg_importance"), zero("avg_rank"), (F.coalesce("count", F.lit(0)) / F.lit(max(1, runs))).alias("freq"))


def best_first(summary: DataFrame) -> list[Column]:
    return [F.col("freq").desc(), F.col("avg_importance").desc(), F.col("avg_rank").asc(), F.col("feature").asc()]


def combined(df: DataFrame, permuted: Column, shapley: Column, rho: float | None = None) -> DataFrame:
    """combined_score: both scores over their maxima, the second weighted 0.3 to 0.7 as it agrees with the first; without it, the first alone."""
    whole = Window.partitionBy()
    w = 0.5 if rho is None else 0.3 + 0.4 * abs(rho)

    def scaled(c: Column) -> Column:
        top = F.max(c).over(whole)
        return F.when(top > 1e-12, c / top).otherwise(c)

    a, b = scaled(permuted), scaled(F.coalesce(shapley, F.lit(0.0)))
    return df.withColumn("combined_score", F.when(shapley > 0, (1 - w) * a + w * b).otherwise(a))


def within_limits(df: DataFrame, order: Sequence[Column], limits: DataFrame | None = None, most: int = 15, default: int = 1) -> DataFrame:
    """The first `most` rows in order of those within the limit of their group (columns group, limit; 0 shuts a group out)."""
    rows = df
    limit = F.lit(default)
    if limits is not None:
        rows = rows.join(F.broadcast(limits), "group", "left")
        limit = F.coalesce(F.col("limit"), F.lit(default))
    place = F.row_number().over(Window.partitionBy("group").orderBy(*order))
    kept = rows.withColumn("place", place).where(F.col("place") <= limit)
    return kept.orderBy(*order).limit(most).drop("limit")


def supplemented(selected: list[str], ranked: list[tuple[str, str]], group: str, least: int, most: int, protected: Sequence[str] = ()) -> list[str]:
    """Raises a group to at least so many features; a full list gives up its last from other, unprotected groups. Lists are of features, so this runs on the driver."""
    groups = dict(ranked)
    out = list(selected)
    for name, g in ranked:
        if sum(groups.get(f) == group for f in out) >= least:
            break
        if g != group or name in out:
            continue
        if len(out) >= most:
            last = next((f for f in reversed(out) if groups.get(f) != group and groups.get(f) not in protected), None)
            if last is None:
                break
            out.remove(last)
        out.append(name)
    return out
