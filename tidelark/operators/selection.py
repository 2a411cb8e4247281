"""Choosing features and models: importances over folds, group limits, candidates in grouped cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import product
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelark.operators import folds, metrics, ranking, stats, trees
from tidelark.operators.trees import Boosting, Ensemble, Leaf, Tree
from tidelark.session import ship


def preselected(df: DataFrame, groups: dict[str, str], limits: dict[str, int], target: str = "target", most: int = 4, small: int = 3, p: Boosting | None = None) -> list[str]:
    """From each group the features of most gain in a small model of the group alone; small groups pass whole, those of limit 0 not at all."""
    p = p or Boosting(rounds=5, depth=3, ridge=10.0, min_child_weight=5.0)
    out = []
    for g in dict.fromkeys(groups.values()):
        own = [f for f, k in groups.items() if k == g]
        limit = min(most, limits.get(g, 1) + 2)
        if limits.get(g, 1) <= 0:
            continue
        if len(own) <= small:
            out += own
            continue
        gains = trees.fit(df, own, target, p).gains()
        out += sorted(own, key=lambda f: (-gains.get(f, 0.0), own.index(f)))[:limit]
    return out


def permuted(df: DataFrame, model: Ensemble, features: Sequence[str], target: str, seed: int, repeats: int = 5) -> dict[str, float]:
    """Mean loss of AUC when a feature's values are dealt anew.

    Values are shifted along a hashed order, a permutation that takes one sort
    and no collection; repeats differ in the seed and the shift.
    """
    base = _auc(trees.scored(df, model), target)
    used = [f for f in features if f in model.gains()]
    out = dict.fromkeys(features, 0.0)
    if base is None or not used:
        return out
    for r in range(repeats):
        order = F.xxhash64(F.lit(seed), F.lit(r), *[F.col(c) for c in used], F.col(target))
        for f in used:
            block = _block(order)
            shuffled = df.withColumn(f, F.coalesce(F.lead(f, 1 + r).over(block), F.first(f).over(block)))
            a = _auc(trees.scored(shuffled, model), target)
            out[f] += (base - (a if a is not None else base)) / repeats
    return out


def _block(order: Column) -> Window:
    """Order within hashed blocks: a window without a key would take all rows to one task."""
    return Window.partitionBy(F.pmod(order, F.lit(64))).orderBy(order)


def _auc(scored: DataFrame, target: str) -> float | None:
    return metrics.ranked_auc(scored.withColumn("_m", F.round("margin", 6)), ["_m"], target).first()["auc"]


def stability(df: DataFrame, features: Sequence[str], group: str, target: str = "target", n_folds: int = 4, seeds: Sequence[int] = (42, 7, 123), least_auc: float = 0.55, top: int = 15, p: Boosting | None = None, repeats: int = 5) -> DataFrame:
    """Summary over folds of importances in held-out rows; folds whose AUC is too low don't count."""
    p = p or Boosting(rounds=10, depth=3, ridge=10.0, min_child_weight=5.0)
    spark, rows = df.sparkSession, []
    for seed in seeds:
        dealt = folds.hashed(df, group, n_folds, seed)
        for k in [r["fold"] for r in folds.legal(dealt, target).collect()]:
            model = trees.fit(dealt.where(F.col("fold") != k), features, target, p)
            valid = dealt.where(F.col("fold") == k)
            auc = _auc(trees.scored(valid, model), target)
            if auc is not None and auc >= least_auc:
                rows += [(f"{seed}-{k}", f, float(v)) for f, v in permuted(valid, model, features, target, seed, repeats).items()]
    listed = spark.createDataFrame([(f,) for f in features], "feature string")
    return ranking.stability(spark.createDataFrame(rows, "fold string, feature string, importance double"), listed, top)


def attributions(tree: Tree, x: dict[str, float | np.ndarray], names: Sequence[str]) -> dict[str, float | np.ndarray]:
    """Shapley values of one row in one tree, or of all rows of columns, over expectations weighted by cover: exact, by the paths to leaves.

    A leaf's path asks for some features; its value is shared among them by
    whether the row, and what share of the cover, goes that way.
    """
    out = dict.fromkeys(names, 0.0)
    values = {f: np.asarray(x[f], dtype=np.float32) for f in {n.feature for n in tree.nodes if not isinstance(n, Leaf)}}

    def walk(at: int, asked: dict[str, tuple[float | np.ndarray, float]]) -> None:
        n = tree.nodes[at]
        if isinstance(n, Leaf):
            items = list(asked.items())
            m = len(items)
            for i, (f, (one, zero)) in enumerate(items):
                others = [v for j, (_, v) in enumerate(items) if j != i]
                for mask in product((0, 1), repeat=m - 1):
                    s = sum(mask)
                    weight = factorial(s) * factorial(m - s - 1) / factorial(m)
                    out[f] += n.value * weight * prod(o if k else z for k, (o, z) in zip(mask, others)) * (one - zero)
            return
        v = values[n.feature]
        goes = np.where(np.isfinite(v), np.where(v < np.float32(n.threshold), n.yes, n.no), n.missing)
        total = tree.nodes[n.yes].cover + tree.nodes[n.no].cover
        for child in (n.yes, n.no):
            one, zero = asked.get(n.feature, (1.0, 1.0))
            share = tree.nodes[child].cover / total if total else 0.5
            walk(child, asked | {n.feature: (one * (goes == child), zero * share)})

    walk(0, {})
    return out


def shapley(df: DataFrame, model: Ensemble, features: Sequence[str]) -> DataFrame:
    """feature, importance: mean size of the attributions over all rows, a batch of them at a time."""
    ship(df.sparkSession)
    names = list(features)

    def run(batches):
        for pdf in batches:
            columns = {f: pdf[f].to_numpy(float) for f in names}
            sums = {f: np.zeros(len(pdf)) for f in names}
            for t in model.trees:
                for f, v in attributions(t, columns, names).items():
                    sums[f] += v
            yield pd.DataFrame({"feature": names, "total": [float(np.abs(sums[f]).sum()) for f in names], "n": len(pdf)})

    parts = df.select(*[F.col(f).cast("double") for f in names]).mapInPandas(run, "feature string, total double, n long")
    return parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))


def agreement(train: DataFrame, valid: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rank correlation, and overlap of the first k with names high in the first alone, of two importance tables."""
    both = train.select("feature", F.col("importance").alias("a")).join(valid.select("feature", F.col("importance").alias("b")), "feature")
    return metrics.spearman(both, "a", "b"), metrics.topk_overlap(both, "feature", "a", "b", k)


def candidates(axes: dict[str, Sequence], budget: int | None = None, seed: int = 42, default: Boosting | None = None) -> list[Boosting]:
    """The default, then points of the product of axes: all, or as many as the budget, drawn by number without listing the product."""
    default = default or Boosting()
    sizes = [len(v) for v in axes.values()]
    n = prod(sizes)
    picks = range(n) if not budget or budget >= n else np.random.default_rng(seed).choice(n, budget, replace=False) if n < 1 << 24 else np.random.default_rng(seed).integers(0, n, budget)
    out = [default]
    for i in map(int, picks):
        point = {}
        for name, values in reversed(axes.items()):
            i, at = divmod(i, len(values))
            point[name] = values[at]
        p = replace(default, **point)
        if p not in out:
            out.append(p)
    return out


def cross_validated(df: DataFrame, features: Sequence[str], group: str, params: Sequence[Boosting], target: str = "target", n_folds: int = 3, repeats: int = 1, seed: int = 42, threshold: float = 0.5, keys: Sequence[str] = ()) -> pd.DataFrame:
    """accuracy, std, fp_rate and nodes of each candidate over grouped folds, best first: accuracy, then steadiness, fewer false positives, smaller models, order.

    With keys of a row, folds that hold one class give way to stratified ones, and those to halves; without, they are left out.
    """
    out = []
    dealings = []
    for r in range(repeats):
        dealt, kind = folds.with_fallback(df, group, list(keys), target, n_folds, seed + r) if keys else (folds.hashed(df, group, n_folds, seed + r), group)
        dealings.append((dealt, kind, [x["fold"] for x in folds.legal(dealt, target).orderBy("fold").collect()]))
    for rank, p in enumerate(params):
        scores = []
        for dealt, _, legal in dealings:
            for k in legal:
                model = trees.fit(dealt.where(F.col("fold") != k), features, target, p)
                row = metrics.evaluated(trees.scored(dealt.where(F.col("fold") == k), model), (F.col("prob") >= threshold).cast("int"), F.col(target)).first()
                scores.append((row["accuracy"], row["fp"] / max(1, row["fp"] + row["tn"]), model.n_nodes))
        a = np.array(scores, float).reshape(-1, 3)
        out.append({"rank": rank, "accuracy": a[:, 0].mean() if len(a) else 0.0, "std": a[:, 0].std() if len(a) else 0.0, "fp_rate": a[:, 1].mean() if len(a) else 1.0, "nodes": a[:, 2].mean() if len(a) else 0.0, "n_splits": len(a), "folds": dealings[0][1]})
    return pd.DataFrame(out).sort_values(["accuracy", "std", "fp_rate", "nodes", "rank"], ascending=[False, True, True, True, True], ignore_index=True)


def searched(df: DataFrame, features: Sequence[str], group: str, params: Sequence[Boosting], target: str = "target", keep: int = 3, n_folds: int = 3, repeats: int = 2, keys: Sequence[str] = ()) -> tuple[Boosting, pd.DataFrame]:
    """All candidates on one repeat, the best of them and the default on all; another than the default is taken only if it is strictly more accurate."""
    first = cross_validated(df, features, group, params, target, n_folds, 1, keys=keys)
    finalists = list(dict.fromkeys([0, *first["rank"].head(keep)]))
    second = cross_validated(df, features, group, [params[i] for i in finalists], target, n_folds, repeats, keys=keys)
    best, default = second.iloc[0], second[second["rank"] == 0].iloc[0]
    chosen = finalists[int(best["rank"])] if best["accuracy"] > default["accuracy"] else finalists[0]
    return params[chosen], second


def out_of_fold(df: DataFrame, features: Sequence[str], group: str, p: Boosting, target: str = "target", n_folds: int = 3, seed: int = 42) -> DataFrame:
    """Adds prob of the model that hasn't seen the row's group; null in folds without both classes."""
    dealt = folds.hashed(df, group, n_folds, seed)
    legal = [r["fold"] for r in folds.legal(dealt, target).collect()]
    prob = F.lit(None).cast("double")
    for k in legal:
        model = trees.fit(dealt.where(F.col("fold") != k), features, target, p)
        margin = sum((trees.expression(t) for t in model.trees), F.lit(model.margin))
        prob = F.when(F.col("fold") == k, 1 / (1 + F.exp(-margin))).otherwise(prob)
    return dealt.withColumn("prob", prob)


def counted(df: DataFrame, ranked: Sequence[str], counts: Sequence[int], group: str, p: Boosting, target: str = "target", n_folds: int = 3, keys: Sequence[str] = ()) -> pd.DataFrame:
    """Cross-validated records of the first features of a ranking, for each count; best first, fewer at a tie."""
    out = []
    for n in dict.fromkeys(min(c, len(ranked)) for c in counts):
        out.append(cross_validated(df, ranked[:n], group, [p], target, n_folds, keys=keys).iloc[0].to_dict() | {"count": n})
    return pd.DataFrame(out).sort_values(["accuracy", "std", "fp_rate", "count"], ascending=[False, True, True, True], ignore_index=True)


def class_weight(df: DataFrame, target: str = "target") -> float:
    """Weight of positives that evens out the classes."""
    row = df.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")).first()
    return row["n"] / row["p"] if row["p"] else 1.0


def prepared(train: DataFrame, others: Sequence[DataFrame], features: Sequence[str]) -> tuple[list[DataFrame], dict[str, float], dict[str, tuple[float, float]]]:
    """All frames filled and clipped by what the first one teaches."""
    fills = stats.median_fill(train, features)
    bounds = stats.clip_bounds(stats.filled(train, fills), features)
    return [stats.clipped(stats.filled(df, fills), bounds) for df in (train, *others)], fills, bounds
