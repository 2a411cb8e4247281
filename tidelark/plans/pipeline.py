"""The whole run from windows to a tuned decision, as steps of one application.

Steps share a context of DataFrames and learned values; what one writes the
next reads, in the shared folder, so that lost executors cost a step at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.functions.features import GROUP_LIMITS, REGISTRY
from tidelark.operators import folds, gates, grids, metrics, postprocess, ranking, selection, split, stats, trees
from tidelark.operators.trees import Boosting
from tidelark.operators.windows import after_warmup
from tidelark.session import staged
from tidelark.sources.artifacts import Bundle, fingerprint

#: Parameter sets of the model search and of the postprocessing sweep; fixed values.
BUDGETS = {"fast": (150, 120), "balanced": (300, 240), "accuracy": (600, 720)}
AXES = {
    "rounds": [40, 45, 50, 55, 60, 65, 70, 75, 80], "depth": [2, 3, 4], "rate": [0.025, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10], "min_child_weight": [10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0],
    "ridge": [5.0, 8.0, 10.0, 12.0, 16.0, 20.0, 30.0], "alpha": [0.0, 0.5, 1.0, 1.5, 2.0, 3.0], "subsample": [0.70, 0.75, 0.80, 0.85, 0.90], "columns": [0.70, 0.75, 0.80, 0.85, 0.90],
}
DEFAULT = Boosting(rounds=40, depth=3, rate=0.05, ridge=10.0, min_child_weight=20.0, alpha=1.0, subsample=0.8, columns=0.8)
#: Features that a group has at least.
LEAST = {"acc_features": 1, "anti_spoof": 3}


@dataclass
class Settings:
    key: str = "sample"
    order: Sequence[str] = ("window",)
    target: str = "target"
    valid: float = 0.15
    test: float = 0.15
    seed: int = 42
    dc: float = 0.0
    ratio: float = 1.0
    most_features: int = 15
    model_budget: int = 4
    sweep_budget: int = 12
    boosting: Boosting = DEFAULT
    objective: str = "fbeta"
    hard_negative_weight: float = 3.0
    warmup: int = 3
    fp_cost: float = 1.5
    n_folds: int = 3
    axes: dict[str, Sequence] = field(default_factory=lambda: dict(AXES))
    #: Whether thresholds of the gate are searched on train rows rather than stated.
    search_gate: bool = False
    #: Whether attributions, and how far they agree on valid rows, count for the choice of features.
    shap: bool = True
    least: dict[str, int] = field(default_factory=lambda: dict(LEAST))
    #: Numbers of features to try; none: those that were chosen.
    feature_counts: Sequence[int] = ()
    #: none or balanced.
    class_weight: str = "none"
    learn_quality: bool = True

    def with_budget(self, name: str) -> Settings:
        model, sweep = BUDGETS[name]
        return replace(self, model_budget=model, sweep_budget=sweep)


@dataclass
class Run:
    """windows: key, order, target, dc, ac_dc_ratio and a column for each feature."""

    windows: DataFrame
    features: list[str]
    settings: Settings = field(default_factory=Settings)
    groups: dict[str, str] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=lambda: dict(GROUP_LIMITS))
    state: dict[str, Any] = field(default_factory=dict)
    reports: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.windows.sparkSession

    def part(self, name: str) -> DataFrame:
        return self.state["split"].where(F.col("split") == name)

    def group_of(self, f: str) -> str:
        return self.groups.get(f) or (REGISTRY[f].group if f in REGISTRY else "other")


def split_step(run: Run) -> None:
    """train, valid, test by a hash of the sample; the same gate for all but a relaxed one while training."""
    s = run.settings
    score = split.fraction_sha256(F.col(s.key).cast("string"), s.seed)
    run.state["split"] = staged(run.windows.withColumn("split", split.split_name(score, s.valid, s.test)), "split")
    samples = run.state["split"].groupBy(s.key, "split").agg(F.first(s.target).alias("target"))
    run.reports["split"] = split.split_summary(samples)


def gate_step(run: Run) -> None:
    s = run.settings
    train = run.part("train").withColumnRenamed(s.key, "sample").withColumn("target", F.col(s.target))
    dc, ratio = s.dc, s.ratio
    if s.search_gate and (found := gates.searched(staged(train.select("sample", "target", "dc", "ac_dc_ratio"), "gate"))):
        dc, ratio = found[-1]["dc_threshold"], found[-1]["ac_dc_threshold"]
    relaxed = gates.train_thresholds(dc, ratio)
    run.reports["gate"] = gates.evaluate(train, [(dc, ratio), relaxed])
    run.state["gate"], run.state["train_gate"] = (dc, ratio), relaxed
    run.state["train"] = run.part("train").where(gates.passes(*relaxed))


def select_step(run: Run) -> None:
    """Cleaning, pre-selection by group, stability over folds joined by attributions, limits and least numbers by group."""
    s, train = run.settings, run.state["train"]
    kept, gone, _ = stats.cleaned(train, run.features, s.target)
    (ready, valid), _, _ = selection.prepared(train, [run.part("valid").where(gates.passes(*run.state["train_gate"]))], kept)
    ready, valid = staged(ready, "ready"), staged(valid, "ready-valid")
    pre = selection.preselected(ready, {f: run.group_of(f) for f in kept}, run.limits, s.target)
    summary = selection.stability(ready, pre, s.key, s.target, s.n_folds, (s.seed,), 0.5, s.most_features, s.boosting, 1)
    groups = run.spark.createDataFrame([(f, run.group_of(f)) for f in pre], "feature string, group string")
    limits = run.spark.createDataFrame(list(run.limits.items()), "group string, limit int")
    ranked, order = summary.join(groups, "feature"), ranking.best_first(summary)
    if s.shap and pre:
        model = trees.fit(ready, pre, s.target, s.boosting)
        seen, unseen = (staged(selection.shapley(x, model, pre), "shapley") for x in (ready, valid))
        rho, overlap = (x.first() for x in selection.agreement(seen, unseen))
        run.state["agreement"] = rho.asDict() | overlap.asDict()
        joined = ranked.join(seen.withColumnRenamed("importance", "shap"), "feature", "left")
        ranked = ranking.combined(joined, F.col("freq") * F.col("avg_importance"), F.col("shap"), rho["rho"] or 0.0)
        order = [F.col("combined_score").desc(), *order]
    ranked = staged(ranked, "ranked")
    chosen = [r["feature"] for r in ranking.within_limits(ranked, order, limits, s.most_features).collect()] or pre[: s.most_features]
    listed = [(r["feature"], r["group"]) for r in ranked.orderBy(*order).select("feature", "group").collect()]
    for group, least in s.least.items():
        if run.limits.get(group, 1) > 0:
            chosen = ranking.supplemented(chosen, listed, group, least, s.most_features, list(s.least))
    run.state["features"], run.state["removed"] = chosen, gone
    run.reports["ranked"] = ranked


def train_step(run: Run) -> None:
    """Number of features and model by search in grouped folds, hard negatives, threshold on valid rows, quality thresholds."""
    s, features = run.settings, run.state["features"]
    keys = [s.key, *s.order]
    (train, valid), fills, clips = selection.prepared(run.state["train"], [run.part("valid").where(gates.passes(*run.state["train_gate"]))], features)
    train, valid = staged(train, "train"), staged(valid, "valid")
    default = replace(s.boosting, positive_weight=selection.class_weight(train, s.target)) if s.class_weight == "balanced" else s.boosting
    if s.feature_counts:
        run.state["counts"] = selection.counted(train, features, s.feature_counts, s.key, default, s.target, s.n_folds, keys)
        features = features[: int(run.state["counts"].iloc[0]["count"])]
        fills, clips = ({c: v for c, v in x.items() if c in features} for x in (fills, clips))
    params, record = selection.searched(train, features, s.key, selection.candidates(s.axes, s.model_budget, s.seed, default), s.target, n_folds=s.n_folds, repeats=1, keys=keys)
    weighted = staged(folds.hard_negatives(selection.out_of_fold(train, features, s.key, params, s.target, s.n_folds, s.seed), "prob", s.target, weight=s.hard_negative_weight).drop("prob", "fold"), "weighted")
    plain, hard = trees.fit(train, features, s.target, params), trees.fit(weighted, features, s.target, params, "weight")
    scores = []
    for model in (plain, hard):
        sweep = metrics.swept(trees.scored(valid, model), "prob", s.target, metrics.thresholds())
        best = metrics.best_threshold(sweep, s.objective).first()
        scores.append((best["accuracy"], best["f1"], best["precision"], best["recall"], best["threshold"]))
    take_hard = scores[1][:4] > scores[0][:4]
    quality = {r["feature"]: (r["type"], r["thr"]) for r in stats.quality_thresholds(train, features).collect()} if s.learn_quality else {}
    run.state["bundle"] = Bundle(features, fills, clips, hard if take_hard else plain, scores[take_hard][4], stats.quantile_bands(train, features), quality, {}, fingerprint(run.spark))
    run.state["search"] = record
    run.reports["hard_negatives"] = weighted.where("reason is not null")


def score_step(run: Run) -> None:
    """Probabilities, gate flags and drift of all windows."""
    b: Bundle = run.state["bundle"]
    rows = stats.clipped(stats.filled(run.state["split"], b.fills), b.clips)
    scored = trees.scored(rows, b.model).withColumn("flag", gates.passes(*run.state["gate"])).withColumn("ood", stats.ood_score(b.bands))
    run.state["scored"] = staged(scored.withColumn("quality", stats.quality(b.quality)), "scored")
    run.reports["ood"] = stats.ood_summary(run.state["scored"], run.settings.key)


def sweep_step(run: Run) -> None:
    """The best postprocessing on valid samples; test ones are refused."""
    s, b = run.settings, run.state["bundle"]
    grid = grids.budgeted(grids.postprocess_grid((-0.05, 0.0, 0.05)), s.sweep_budget)
    valid = run.state["scored"].where(F.col("split") == "valid").withColumn("target", F.col(s.target))
    found = postprocess.swept(postprocess.refused(valid), s.key, list(s.order), "prob", F.col("flag"), b.threshold, grid, s.fp_cost, "quality")
    run.reports["sweep"] = staged(found, "sweep")
    best = run.reports["sweep"].orderBy(F.col("objective").desc(), *[F.col(k) for k in grid[0]]).first()
    b.postprocess = {k: best[k] for k in grid[0]}


def evaluate_step(run: Run) -> None:
    """Decisions of every split's samples, windows after the warm-up, and errors."""
    s, b = run.settings, run.state["bundle"]
    p = b.postprocess or {"threshold_offset": 0.0, "median_k": 1, "alpha": 0.4, "t_on": 0.75, "t_off": 0.35, "k_on": 5, "k_off": 5, "cooldown": 5}
    w = run.state["scored"].withColumn("target", F.col(s.target))
    shifted = w.withColumn("_p", gates.gated(postprocess.recentred(F.col("prob"), float(b.threshold), float(p["threshold_offset"])), F.col("flag")))
    shifted = shifted.withColumn("_p", postprocess.causal_median("_p", s.key, list(s.order), p["median_k"]))
    machine = postprocess.Hysteresis(p["alpha"], p["t_on"], p["t_off"], p["k_on"], p["k_off"], p["cooldown"])
    ends = postprocess.final_states(shifted, s.key, list(s.order), "_p", "quality", machine=machine, keep=["split", "target"])
    run.reports["samples"] = metrics.evaluated(ends, F.col("state"), F.col("target"), ["split"])
    pred = ((F.col("prob") >= b.threshold) & F.col("flag")).cast("int")
    run.reports["windows"] = metrics.evaluated(after_warmup(w, s.key, list(s.order), s.warmup), pred, F.col("target"), ["split"])
    run.reports["errors"] = postprocess.tag_summary(postprocess.tagged(w, pred, F.col("target"), F.col("flag"), F.col("quality"), F.coalesce("ood", F.lit(0.0))))


STEPS: dict[str, Callable[[Run], None]] = {"split": split_step, "gate": gate_step, "select": select_step, "train": train_step, "score": score_step, "sweep": sweep_step, "evaluate": evaluate_step}


def execute(run: Run, skip: Sequence[str] = (), stop_after: str | None = None, dry_run: bool = False) -> list[str]:
    """Runs the steps in order; returns the names of those run, or that would be."""
    for name in (*skip, *([stop_after] if stop_after else [])):
        if name not in STEPS:
            raise ValueError(f"no step {name}; there are {', '.join(STEPS)}")
    done = []
    for name, step in STEPS.items():
        if name not in skip:
            done.append(name)
            if not dry_run:
                step(run)
        if name == stop_after:
            break
    return done
