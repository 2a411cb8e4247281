"""From a sample's window probabilities to its decision: recentring, gate, causal median, hysteresis, votes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelark.operators.grids import each
from tidelark.operators.metrics import evaluated, ratio
from tidelark.session import ship

#: Steps since the last flip at the start: no cooldown holds back the first one.
LONG_AGO = 999


@dataclass(frozen=True)
class Hysteresis:
    """On after k_on high smoothed scores, off after k_off low ones; counts leak by one for each step on the other side."""

    alpha: float = 0.4
    t_on: float = 0.75
    t_off: float = 0.35
    k_on: int = 5
    k_off: int = 5
    cooldown: float = 5.0
    stride: float = 1.0

    @property
    def cooldown_steps(self) -> int:
        return int(self.cooldown / self.stride) if self.stride > 0 else int(self.cooldown)


def recentred(prob: Column, threshold: float | Column, offset: float | Column = 0.0) -> Column:
    """Shifts the decision from the threshold (moved by the offset, within [0.02, 0.98]) to a half."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    moved = F.least(F.greatest(threshold + offset, F.lit(0.02)), F.lit(0.98))
    return F.least(F.greatest(prob - moved + 0.5, F.lit(0.0)), F.lit(1.0))


def causal_median(value: str, key: str, order: Sequence[str], k: int) -> Column:
    """Median of the last k values; of those there are, at the start."""
    if k <= 1:
        return F.col(value)
    return F.percentile(value, F.lit(0.5)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - k, 0))


def _let(value: Column, body) -> Column:
    """Binds a value for a lambda's body, so it isn't computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(steps: Column, alpha: Column, t_on: Column, t_off: Column, k_on: Column, k_off: Column, cooldown_steps: Column) -> Column:
    """state and score after an ordered array of struct(p, q): an aggregation over the array that stays in the JVM."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0.0).alias("score"), F.lit(0).alias("on"), F.lit(0).alias("off"), F.lit(LONG_AGO).alias("since"))

    def step(a: Column, x: Column) -> Column:
        rate = alpha * x["q"]
        return _let(
            F.struct((rate * x["p"] + (1 - rate) * a["score"]).alias("score"), (a["since"] + 1).alias("since")),
            lambda s: _let(
                F.struct(
                    F.when(a["state"] == 0, F.when(s["score"] > t_on, a["on"] + 1).otherwise(F.greatest(a["on"] - 1, F.lit(0)))).otherwise(a["on"]).alias("on"),
                    F.when(a["state"] == 1, F.when(s["score"] < t_off, a["off"] + 1).otherwise(F.greatest(a["off"] - 1, F.lit(0)))).otherwise(a["off"]).alias("off"),
                ),
                lambda c: _let(
                    (s["since"] >= cooldown_steps) & F.when(a["state"] == 0, c["on"] >= k_on).otherwise(c["off"] >= k_off),
                    lambda flips: F.struct(
                        F.when(flips, 1 - a["state"]).otherwise(a["state"]).alias("state"), s["score"].alias("score"),
                        F.when(flips, F.lit(0)).otherwise(c["on"]).alias("on"), F.when(flips, F.lit(0)).otherwise(c["off"]).alias("off"), F.when(flips, F.lit(0)).otherwise(s["since"]).alias("since"),
                    ),
                ),
            ),
        )

    return F.aggregate(steps, start, step)


def final_states(df: DataFrame, key: str, order: Sequence[str], prob: str, quality: str | None = None, params: Sequence[dict] | None = None, machine: Hysteresis | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """key, keep, state, score after a sample's last window; with params (alpha, t_on, t_off, k_on, k_off, cooldown), for each set.

    A sample's windows meet once, as an array of two doubles each, and all
    parameter sets fold over that array; many of them in Arrow batches. A
    missing probability counts as 0, as behind a closed gate, a missing
    quality as 1. Samples are recordings: bounded.
    """
    q = F.col(quality) if quality else F.lit(1.0)
    item = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(prob).cast("double"), F.lit(0.0)).alias("p"), F.coalesce(q.cast("double"), F.lit(1.0)).alias("q"))
    grouped = df.groupBy(key, *keep).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    steps = F.transform("_all", lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q")))
    grouped = grouped.select(key, *keep, steps.alias("_steps"))
    m = machine or Hysteresis()
    if params and len(params) > MANY:
        return _walked(grouped, [key, *keep], params, m.stride)
    if params:
        rows = each(grouped, params)
        args = [F.col(c) for c in ("alpha", "t_on", "t_off", "k_on", "k_off")] + [F.floor(F.col("cooldown") / F.lit(float(m.stride))).cast("int")]
        names = list(params[0])
    else:
        rows, names = grouped, []
        args = [F.lit(m.alpha), F.lit(m.t_on), F.lit(m.t_off), F.lit(m.k_on), F.lit(m.k_off), F.lit(m.cooldown_steps)]
    return rows.withColumn("_end", fold(F.col("_steps"), *args)).select(key, *keep, *names, F.col("_end.state").alias("state"), F.col("_end.score").alias("score"))


#: From so many parameter sets on, the fold over arrays, which the engine interprets, is slower than arrays of all sets at once.
MANY = 64
#: Samples that step together with all sets.
TOGETHER = 64


def _walked(grouped: DataFrame, names: Sequence[str], params: Sequence[dict], stride: float) -> DataFrame:
    """The ends of fold() for many sets: samples step together, each with every set, in Arrow batches."""
    ship(grouped.sparkSession)
    fields = list(params[0])
    alpha, t_on, t_off, k_on, k_off = (np.array([p[c] for p in params])[None, :] for c in ("alpha", "t_on", "t_off", "k_on", "k_off"))
    wait = np.array([int(np.floor(p["cooldown"] / float(stride))) for p in params])[None, :]
    columns = {c: np.array([p[c] for p in params]) for c in fields}
    kinds = {c: "int" if all(type(p[c]) is int for p in params) else "double" for c in fields}

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[first : first + TOGETHER]
                steps = [[(s["p"], s["q"]) for s in x] for x in pdf["_steps"]]
                shape = (len(pdf), len(params))
                state, on, off, since = (np.full(shape, v, np.int32) for v in (0, 0, 0, LONG_AGO))
                score = np.zeros(shape)
                for t in range(max(map(len, steps))):
                    here = np.array([t < len(x) for x in steps])[:, None]
                    p, q = (np.array([[x[t][k] if t < len(x) else 0.0] for x in steps]) for k in (0, 1))
                    rate = alpha * q
                    score = np.where(here, rate * p + (1 - rate) * score, score)
                    since = since + here
                    high, low = ~(score <= t_on), score < t_off  # NaN is above every number
                    on = np.where(here & (state == 0), np.where(high, on + 1, np.maximum(on - 1, 0)), on)
                    off = np.where(here & (state == 1), np.where(low, off + 1, np.maximum(off - 1, 0)), off)
                    flips = here & (since >= wait) & np.where(state == 0, on >= k_on, off >= k_off)
                    state, on, off, since = np.where(flips, 1 - state, state), np.where(flips, 0, on), np.where(flips, 0, off), np.where(flips, 0, since)
                out = pdf[names].loc[pdf.index.repeat(len(params))].reset_index(drop=True)
                for c, v in columns.items():
                    out[c] = np.tile(v, len(pdf))
                out["state"], out["score"] = state.ravel(), score.ravel()
                yield out

    own = {f.name: f.dataType.simpleString() for f in grouped.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in ({c: own[c] for c in names} | kinds | {"state": "int", "score": "double"}).items())
    return grouped.mapInPandas(run, schema).withColumn("score", F.coalesce("score", F.lit(float("nan"))))  # NaN becomes null on the way back


def walk(probs, qualities, m: Hysteresis, state=(0, 0.0, 0, 0, LONG_AGO)):
    """States and scores step by step, and what to go on from: one loop serves the batch trace and the stream."""
    now, score, on, off, since = state
    states, scores = [], []
    for p, q in zip(probs, qualities):
        rate = m.alpha * q
        score = rate * p + (1 - rate) * score
        since += 1
        if now == 0:
            on = on + 1 if score > m.t_on else max(0, on - 1)
            flips = on >= m.k_on
        else:
            off = off + 1 if score < m.t_off else max(0, off - 1)
            flips = off >= m.k_off
        if flips and since >= m.cooldown_steps:
            now, on, off, since = 1 - now, 0, 0, 0
        states.append(now)
        scores.append(score)
    return states, scores, (now, score, on, off, since)


def trace(df: DataFrame, key: str, order: Sequence[str], prob: str, quality: str | None = None, machine: Hysteresis | None = None) -> DataFrame:
    """Adds state and score to every window. Each step rests on the one before, so a sample is one Arrow group and one loop."""
    ship(df.sparkSession)
    m = machine or Hysteresis()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        q = pdf[quality] if quality else [1.0] * len(pdf)
        states, scores, _ = walk(pdf[prob].to_numpy(float).tolist(), list(q), m)
        return pdf.assign(state=pd.array(states, "int32"), score=scores)

    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.groupBy(key).applyInPandas(run, f"{fields}, state int, score double")


def votes(df: DataFrame, key: str, prob: str, threshold: float, keep: Sequence[str] = ()) -> DataFrame:
    """mean_vote: at least half of the windows reach the threshold; prob_mean: their mean does."""
    share = F.avg((F.col(prob) >= threshold).cast("double"))
    return df.groupBy(key, *keep).agg((share >= 0.5).cast("int").alias("mean_vote"), (F.avg(prob) >= threshold).cast("int").alias("prob_mean"))


def sample_status(df: DataFrame, key: str, samples: DataFrame, pred: Column, target: str = "target") -> DataFrame:
    """all_correct, hard or no_windows for each sample, windows or not."""
    checked = df.groupBy(key).agg(F.bool_and(pred == F.col(target)).alias("_right"))
    status = F.when(F.col("_right").isNull(), "no_windows").when(F.col("_right"), "all_correct").otherwise("hard")
    return samples.join(checked, key, "left").select(*samples.columns, status.alias("status"))


def sample_metrics(samples: DataFrame, decisions: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates over all samples; those without a decision count as 0."""
    joined = samples.join(decisions, key, "left").withColumn("_pred", F.coalesce("state", F.lit(0)))
    return evaluated(joined, F.col("_pred"), F.col("target"), by)


def swept(df: DataFrame, key: str, order: Sequence[str], raw: str, flag: Column, threshold: float, grid: Sequence[dict], fp_cost: float = 1.5, quality: str | None = None) -> DataFrame:
    """Metrics and score of each parameter set over samples (column target): accuracy, recall, final windows and false positives.

    Series are made once for each pair of offset and median width, folded once for each set, and summed up.
    """
    pairs = list(dict.fromkeys((p["threshold_offset"], p["median_k"]) for p in grid))
    names = list(grid[0])
    parts = []
    for offset, k in pairs:
        own = [p for p in grid if (p["threshold_offset"], p["median_k"]) == (offset, k)]
        shifted = df.withColumn("_p", F.when(F.coalesce(flag, F.lit(False)), recentred(F.col(raw), float(threshold), float(offset))).otherwise(F.lit(0.0)))
        smooth = shifted.withColumn("_p", causal_median("_p", key, order, k))
        parts.append(final_states(smooth, key, order, "_p", quality, params=own, keep=["target"]))
    ends = parts[0]
    for p in parts[1:]:
        ends = ends.unionByName(p)
    scored = evaluated(ends, F.col("state"), F.col("target"), names).withColumn("fp_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
    return scored.withColumn("objective", F.col("accuracy") + 0.35 * F.col("recall") - fp_cost * F.col("fp_rate"))


def constrained(scored: DataFrame, order: Sequence[str], least_recall: float = 0.95) -> DataFrame:
    """The highest F1 among sets whose recall suffices; if none does, the highest recall, then F1. The first in order at a tie."""
    enough = (F.col("recall") >= least_recall).cast("int")
    return scored.orderBy(enough.desc(), F.when(enough == 1, F.col("f1")).otherwise(F.col("recall")).desc(), F.col("f1").desc(), *order).limit(1)


def refused(df: DataFrame, split: str = "split", name: str = "test") -> DataFrame:
    """The frame, or an error if it holds rows that nothing may be tuned on."""
    if split in df.columns and df.where(F.col(split) == name).head(1):
        raise ValueError(f"the {name} split must not be tuned on")
    return df


def tagged(df: DataFrame, pred: Column, target: Column, enabled: Column, quality: Column, ood: Column) -> DataFrame:
    """Adds diagnostic_tag and is_error: what stands behind a wrong window, gate first, then drift, then quality."""
    side = lambda what: F.concat(F.lit(what), F.when(pred == 1, "_fp").otherwise("_fn"))
    tag = F.when(~enabled, "stage1_blocked").when(pred == target, "correct").when(ood >= 0.3, side("high_ood")).when(quality < 0.5, side("low_quality")).otherwise(side("model"))
    return df.withColumn("diagnostic_tag", tag).withColumn("is_error", (pred != target).cast("int"))


def tag_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("diagnostic_tag").agg(F.count("*").alias("n"), F.sum("is_error").alias("errors"))
