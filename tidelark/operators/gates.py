"""Gates: cheap predicates on a window's level and variation, and the search for their thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelark.functions import arrays as A
from tidelark.operators.grids import bin_found, each
from tidelark.operators.stats import finite, quantiles
from tidelark.operators.windows import whole, windowed

def gate_features(df: DataFrame, key: str, idx: str, value: str, size: int, stride: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Level dc (least mean of neighbours), ac (median step) and their ratio, of every whole window of a long signal; extra aggregates by name.

    One exchange: the positions of a sample are numbered, lagged and grouped on the same key.
    """
    before = F.lag(value).over(Window.partitionBy(key, "window").orderBy(idx))
    pairs = windowed(df, idx, size, stride).withColumn("_before", before)
    grouped = pairs.groupBy(key, "window").agg(
        F.min((F.col("_before") + F.col(value)) / 2).alias("_dc"), F.percentile(F.abs(F.col(value) - F.col("_before")), F.lit(0.5)).alias("_ac"),
        F.avg(value).alias("_mean"), whole(size).alias("_whole"), *[c.alias(k) for k, c in (extra or {}).items()],
    )
    dc, ac = F.coalesce("_dc", "_mean"), F.coalesce("_ac", F.lit(0.0))
    return grouped.where("_whole").select(key, "window", (F.col("window") * stride).alias("start"), dc.alias("dc"), ac.alias("ac"), (ac / (F.abs(dc) + F.lit(1e-12))).alias("ac_dc_ratio"), *(extra or {}))


def gate_features_array(a: Column) -> dict[str, Column]:
    """The same of an array; shorter than two values: its mean, and no variation."""
    dc = F.when(F.size(a) >= 2, F.array_min(F.zip_with(A.lead(a), A.trail(a), lambda x, y: (x + y) / 2))).otherwise(A.mean(a))
    ac = F.when(F.size(a) >= 2, A.median(F.transform(A.diff(a), lambda x: F.abs(x)))).otherwise(F.lit(0.0))
    return {"dc": dc, "ac": ac, "ac_dc_ratio": ac / (F.abs(dc) + F.lit(1e-12))}


def passes(dc_above: float | Column, ratio_below: float | Column, dc: str = "dc", ratio: str = "ac_dc_ratio") -> Column:
    return (F.col(dc) > dc_above) & (F.col(ratio) < ratio_below)


def any_window(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Samples with a window that passes."""
    return df.groupBy(key).agg(F.bool_or(flag).alias("passed"), F.count("*").alias("n_windows"), F.count_if(flag).alias("n_passed"))


def gated(prob: Column, flag: Column) -> Column:
    """0 where the gate is shut or unknown."""
    return F.when(F.coalesce(flag, F.lit(False)), prob).otherwise(F.lit(0.0))


def consecutive(df: DataFrame, key: str, order: Sequence[str], flag: Column, k: int = 3) -> DataFrame:
    """Opens after k passes in a row, and shuts after k failures in a row.

    The state is that of the last run of k alike, which a window function finds without a fold.
    """
    by = Window.partitionBy(key).orderBy(*order)
    frame = by.rowsBetween(1 - k, 0)
    n = F.count(F.lit(1)).over(frame)
    up = F.sum(F.when(flag, 1).otherwise(0)).over(frame)
    turn = F.when((n == k) & (up == k), 1).when((n == k) & (up == 0), 0)
    return df.withColumn("_turn", turn).withColumn("open", F.coalesce(F.last("_turn", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_turn")


RATES = ["window_target1_pass_rate", "window_target0_pass_rate", "sample_target1_pass_rate", "sample_target0_pass_rate"]


def evaluate(df: DataFrame, thresholds: Sequence[tuple[float, float]], key: str = "sample") -> DataFrame:
    """Pass rates of windows and samples by target (columns key, target, dc, ac_dc_ratio), for each pair of thresholds.

    A sample passes if any of its windows does; rates without members are 0.
    The product with the stated pairs is summed up by sample before its exchange.
    """
    rows = each(df, [{"dc_threshold": float(d), "ac_dc_threshold": float(r)} for d, r in thresholds])
    ok = passes(F.col("dc_threshold"), F.col("ac_dc_threshold"))
    samples = rows.groupBy("dc_threshold", "ac_dc_threshold", key, "target").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))

    def rate(top: Column, down: Column) -> Column:
        return F.when(down > 0, top / down).otherwise(F.lit(0.0))

    def windows(t: int) -> Column:
        return rate(F.sum(F.when(F.col("target") == t, F.col("ok")).otherwise(0)), F.sum(F.when(F.col("target") == t, F.col("n")).otherwise(0)))

    def whole_samples(t: int) -> Column:
        return rate(F.count_if((F.col("target") == t) & (F.col("ok") > 0)), F.count_if(F.col("target") == t))

    return samples.groupBy("dc_threshold", "ac_dc_threshold").agg(
        windows(1).alias(RATES[0]), windows(0).alias(RATES[1]), (1 - windows(0)).alias("window_target0_reject_rate"), whole_samples(1).alias(RATES[2]), whole_samples(0).alias(RATES[3]),
        (1 - whole_samples(0)).alias("sample_target0_reject_rate"), F.sum("n").alias("num_windows"), F.count("*").alias("num_samples"),
    )


def best(evaluated: DataFrame) -> DataFrame:
    """The best pair: most samples of target 1 pass, most of target 0 are rejected, most windows of target 0 are, then the lower level and the higher ratio."""
    near = lambda c: F.round(F.col(c), 12)  # noqa: E731  smaller differences don't decide
    return evaluated.orderBy(F.col("sample_target1_pass_rate").desc(), near("sample_target0_reject_rate").desc(), near("window_target0_reject_rate").desc(), near("dc_threshold").asc(), near("ac_dc_threshold").desc()).limit(1)


def grid(df: DataFrame, dc_points: int = 5, ratio_points: int = 5) -> list[tuple[float, float]]:
    """Candidate pairs: quantiles of the windows' features, distinct."""
    shares = lambda n: [(i + 1) / (n + 1) for i in range(n)]
    found = quantiles(df, ["dc", "ac_dc_ratio"], list(dict.fromkeys(shares(dc_points) + shares(ratio_points))))
    at = {q: i for i, q in enumerate(dict.fromkeys(shares(dc_points) + shares(ratio_points)))}
    d, r = [found["dc"][at[q]] for q in shares(dc_points)], [found["ac_dc_ratio"][at[q]] for q in shares(ratio_points)]
    return [(x, y) for x in dict.fromkeys(d) for y in dict.fromkeys(r) if x is not None and y is not None]


def axes(df: DataFrame, n: int) -> tuple[list[float], list[float]]:
    """Rising levels and ratios to try: n quantiles and n even steps of each, a little beyond the values seen, and ratios that are always tried."""
    found = quantiles(df, ["dc", "ac_dc_ratio"], np.linspace(0, 1, n).tolist())
    d, r = ([x for x in found[c] if x is not None] for c in ("dc", "ac_dc_ratio"))
    if not d or not r:
        return [], []
    wide, wide_r = max(d[-1] - d[0], 1.0), max(r[-1] - r[0], 1e-6)
    levels = np.concatenate([d, np.linspace(d[0] - 0.1 * wide, d[-1], n)])
    ratios = np.concatenate([r, np.linspace(max(0.0, r[0] - 0.05 * wide_r), r[-1] + 0.2 * wide_r, n), np.linspace(0.01, 1.5, max(n - 100, 100))])
    return np.unique(levels).tolist(), np.unique(ratios).tolist()


def tabulated(df: DataFrame, levels: Sequence[float], ratios: Sequence[float], key: str = "sample") -> dict[str, np.ndarray]:
    """The rates of `evaluate` for every level with every ratio, as tables (levels x ratios), both rising.

    Windows are counted by the levels and ratios that let them pass, samples by
    the first ratio that lets a window pass at each level: two aggregations,
    however many pairs there are, and what reaches the driver is as large as
    the tables. Values that aren't finite never pass.
    """
    over = bin_found(finite("dc"), np.nextafter(np.array(levels, float), np.inf).tolist())
    first = bin_found(finite("ac_dc_ratio"), list(ratios))
    shape = (len(levels) + 1, len(ratios) + 1)
    rows = df.select(key, "target", F.coalesce(over, F.lit(0)).alias("i"), F.coalesce(first, F.lit(len(ratios))).alias("j"))
    windows = {t: np.zeros(shape) for t in (0, 1)}
    for x in rows.where("target in (0, 1)").groupBy("target", "i", "j").count().collect():
        windows[x["target"]][x["i"], x["j"]] += x["count"]
    down = Window.partitionBy(key, "target").orderBy(F.col("i").desc())
    least = rows.groupBy(key, "target", "i").agg(F.min("j").alias("j"))
    runs = least.select("target", "i", F.min("j").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("j"), F.lead("i", 1, 0).over(down).alias("low"), (F.row_number().over(down) == 1).alias("top"))
    counted = runs.where("target in (0, 1)").groupBy("target", "i", "low", "j").agg(F.count("*").alias("n"), F.count_if("top").alias("samples")).collect()
    samples, total = {t: np.zeros(shape) for t in (0, 1)}, {0: 0, 1: 0}
    for x in counted:
        samples[x["target"]][x["low"] : x["i"], x["j"]] += x["n"]
        total[x["target"]] += x["samples"]

    def rate(passed: np.ndarray, all_: float) -> np.ndarray:
        return passed / all_ if all_ else np.zeros_like(passed)

    out = {}
    for t in (1, 0):
        over_level = windows[t][::-1].cumsum(axis=0)[::-1][1:].cumsum(axis=1)[:, :-1]
        out[f"window_target{t}_pass_rate"] = rate(over_level, windows[t].sum())
        out[f"sample_target{t}_pass_rate"] = rate(samples[t][:-1].cumsum(axis=1)[:, :-1], total[t])
    return out


def best_pair(levels: Sequence[float], ratios: Sequence[float], rates: dict[str, np.ndarray], least: float = 1.0) -> dict[str, float] | None:
    """The pair that `best` takes among those that let so large a share of samples of target 1 pass; None without any."""
    ok = np.argwhere(rates["sample_target1_pass_rate"] + 1e-12 >= least)
    if not len(ok):
        return None
    at = lambda name: rates[name][ok[:, 0], ok[:, 1]]
    order = np.lexsort((-ok[:, 1], ok[:, 0], at("window_target0_pass_rate").round(12), at("sample_target0_pass_rate").round(12), -at("sample_target1_pass_rate")))
    i, k = ok[order[0]]
    return {"dc_threshold": float(levels[i]), "ac_dc_threshold": float(ratios[k])} | {c: float(rates[c][i, k]) for c in RATES}


def searched(df: DataFrame, least: float = 1.0, coarse: int = 50, fine: int = 30, key: str = "sample") -> list[dict]:
    """The best pair of a coarse grid, and of a fine one a fifth around it; the last is the one to take. Empty if no pair lets enough samples pass.

    `df` (columns key, target, dc, ac_dc_ratio) is read several times: a staged table serves best.
    """
    found = None
    for n in (coarse, min(coarse, 30)):
        levels, ratios = axes(df, n)
        if levels and (found := best_pair(levels, ratios, tabulated(df, levels, ratios, key), least)):
            break
    if not found:
        return []
    near = [np.unique(np.linspace(found[c] * 0.8, found[c] * 1.2, fine)).tolist() for c in ("dc_threshold", "ac_dc_threshold")]
    close = best_pair(*near, tabulated(df, *near, key), least)
    rank = lambda x: (-x["sample_target1_pass_rate"], round(x["sample_target0_pass_rate"], 12), round(x["window_target0_pass_rate"], 12), x["dc_threshold"], -x["ac_dc_threshold"])
    return [found | {"stage": "coarse"}] + ([close | {"stage": "fine"}] if close and rank(close) < rank(found) else [])


def train_thresholds(dc: float, ratio: float) -> tuple[float, float]:
    """The relaxed gate used while training."""
    return dc * 0.9, ratio + 0.1
