"""Decisions against targets: confusion counts, rates, threshold searches, rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelark.operators.grids import bin_number, each
from tidelark.operators.stats import finite


def confusion(pred: Column, target: Column) -> dict[str, Column]:
    cell = lambda p, t: F.count_if((pred == p) & (target == t))
    return {"tn": cell(0, 0), "fp": cell(1, 0), "fn": cell(0, 1), "tp": cell(1, 1)}


def ratio(top: Column, down: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(down > 0, top / down).otherwise(F.lit(0.0))


def fbeta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return ratio((1 + b) * precision * recall, b * precision + recall)


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"accuracy": ratio(tn + tp, tn + fp + fn + tp), "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def evaluated(df: DataFrame, pred: Column, target: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates, for all rows or each group."""
    cells = confusion(pred, target)
    counted = df.groupBy(*by).agg(*[c.alias(k) for k, c in cells.items()])
    return counted.select(*by, *cells, *[c.alias(k) for k, c in rates(*map(F.col, cells)).items()])


def rolled_up(df: DataFrame, pred: Column, target: Column, by: Sequence[str]) -> DataFrame:
    """The same for each prefix of the grouping, down to all rows; levels tells which columns are summed over."""
    cells = confusion(pred, target)
    counted = df.rollup(*by).agg(F.grouping_id().alias("level"), *[c.alias(k) for k, c in cells.items()])
    return counted.select(*by, F.col("level").cast("long").alias("level"), *cells, *[c.alias(k) for k, c in rates(*map(F.col, cells)).items()])


def thresholds(low: float = 0.05, high: float = 0.95, n: int = 100) -> list[float]:
    """Evenly spaced, both ends included."""
    return [low + i * ((high - low) / (n - 1)) for i in range(n)]


def swept(df: DataFrame, prob: str, target: str, at: Sequence[float]) -> DataFrame:
    """rank, threshold, counts and rates at each of the stated thresholds, in rising order.

    Rows are first reduced to counts by the number of thresholds they reach:
    one pass, whatever the number of thresholds, and a result no larger than theirs.
    """
    at = sorted(at)
    reached = F.coalesce(bin_number(F.col(prob), at), F.lit(0))
    binned = df.select(reached.alias("_reached"), F.col(target).alias("_target")).groupBy("_reached").agg(F.count_if(F.col("_target") == 1).alias("_p"), F.count_if(F.col("_target") == 0).alias("_n"))
    spread = each(binned, [{"rank": i, "threshold": float(t)} for i, t in enumerate(at)])
    hit = F.col("_reached") > F.col("rank")
    cells = {"tn": F.when(hit, 0).otherwise(F.col("_n")), "fp": F.when(hit, F.col("_n")).otherwise(0), "fn": F.when(hit, 0).otherwise(F.col("_p")), "tp": F.when(hit, F.col("_p")).otherwise(0)}
    counted = spread.groupBy("rank", "threshold").agg(*[F.sum(c).alias(k) for k, c in cells.items()])
    return counted.select("rank", "threshold", *cells, *[c.alias(k) for k, c in rates(*map(F.col, cells)).items()])


def best_threshold(sweep: DataFrame, objective: str = "f1", beta: float = 0.5, min_precision: float = 0.95) -> DataFrame:
    """The row of the highest objective, the lowest threshold at a tie."""
    p, r = F.col("precision"), F.col("recall")
    scores = {"f1": F.col("f1"), "precision": p, "recall": r, "fbeta": fbeta(p, r, beta), "precision_constrained": F.when(p >= min_precision, r).otherwise(p - 1)}
    scored = sweep.withColumn("score", scores.get(objective, scores["f1"])).withColumn("fbeta", fbeta(p, r, beta))
    return scored.orderBy(F.col("score").desc(), "rank").limit(1)


#: Rows of a feature in a range that ranks are summed in, about, and ranges at least.
RANGE_ROWS, RANGES = 250_000, 16


def ranked_auc(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """feature, auc, separation (auc or its complement), by rank sums with ties at their mean rank; null with one class.

    Values are counted first, so ranks are sums over distinct values. They are
    dealt into ranges of like numbers of values: ranks within a range come
    from its own rows, those of whole ranges from their totals, so no task
    sorts a feature alone.
    """
    # Values are a projection of their own, so that each comparison reads a column, not the expression behind it.
    rows = df.select(F.col(target).alias("_y"), *[finite(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(features)])
    ranges = max(RANGES, -(-rows.count() // RANGE_ROWS))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    row = rows.agg(*[F.percentile_approx(f"x{i}", shares, F.lit(max(1000, 4 * ranges))).alias(f"b{i}") for i in range(len(features))]).first()
    bounds = [sorted(set(row[f"b{i}"] or [])) for i in range(len(features))]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), bin_number(F.col(f"x{i}"), bounds[i]).alias("range"), F.col(f"x{i}").alias("x")) for i, c in enumerate(features)])
    long = rows.select("_y", F.explode(cells).alias("c")).select("c.*", "_y").where("x is not null")
    counted = long.groupBy("feature", "range", "x").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("n"))
    before = Window.partitionBy("feature", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    inner = counted.withColumn("under", F.coalesce(F.sum("n").over(before), F.lit(0)))
    summed = inner.groupBy("feature", "range").agg(F.sum(F.col("p").cast("double") * (F.col("under") + F.col("n") * F.lit(0.5))).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    below = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    wins = summed.withColumn("u", F.col("u") + F.col("p").cast("double") * F.coalesce(F.sum("n").over(below), F.lit(0)))
    sums = wins.groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p").cast("double") * F.col("n")))
    return sums.select("feature", auc.alias("auc"), F.greatest(auc, 1 - auc).alias("separation"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho of two columns of a small table (features with scores), ties at their mean rank."""

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) * F.lit(0.5)

    return df.select(mean_rank(a).alias("x"), mean_rank(b).alias("y")).agg(F.corr("x", "y").alias("rho"))


def topk_overlap(df: DataFrame, name: str, a: str, b: str, k: int = 10) -> DataFrame:
    """Share of the k largest by one column that are among the k largest by the other, and names high in the first alone."""
    ranks = df.select(name, F.row_number().over(Window.orderBy(F.col(a).desc(), name)).alias("ra"), F.row_number().over(Window.orderBy(F.col(b).desc(), name)).alias("rb"))
    return ranks.agg((F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)) / F.lit(float(k))).alias("overlap"), F.count_if((F.col("ra") <= k) & (F.col("rb") > 2 * k)).alias("n_suspicious"))
