"""Trees, selection, cleaning, folds and the whole run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelark.operators import folds, metrics, ranking, selection, stats, trees
from tidelark.operators.trees import Boosting, Ensemble, Leaf, Split, Tree
from tidelark.plans import pipeline
from tidelark.sources.artifacts import Bundle

DUMP = "0:[f0<39.0625] yes=1,no=2,missing=2,gain=6.7,cover=20\n\t1:leaf=-0.1,cover=8\n\t2:[f1<0.28] yes=3,no=4,missing=3,gain=1.5,cover=12\n\t\t3:leaf=0.05,cover=5\n\t\t4:leaf=0.2,cover=7\n"


def test_dumps_become_tables_and_models():
    rows = trees.parsed_dump([DUMP], ["first", "second"])
    assert [r["FeatureName"] for r in rows] == ["first", "Leaf", "second", "Leaf", "Leaf"] and rows[0]["Gain"] == 6.7
    model = trees.from_rows(rows)
    x = {"first": np.array([1.0, 50, np.nan, 50, 39.0625]), "second": np.array([0, 0.1, 0.9, np.nan, 0.28])}
    assert trees.predict(model, x).tolist() == pytest.approx([-0.1, 0.05, 0.2, 0.05, 0.2])
    assert Ensemble.from_json(model.to_json()) == model


def test_expressions_equal_predictions(spark):
    rng = np.random.default_rng(1)
    model = Ensemble([Tree([Split("a", 0.1, 1, 2, 1), Leaf(-0.3), Split("b", -0.2, 3, 4, 4), Leaf(0.2), Leaf(0.9)]), Tree([Leaf(0.1)])], 0.3)
    a, b = rng.normal(size=300).round(1), rng.normal(size=300)
    a[:20], b[10:30], a[40] = np.nan, np.nan, np.inf
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i int, a double, b double")
    got = [r.margin for r in trees.scored(df, model).orderBy("i").collect()]
    assert got == pytest.approx(trees.predict(model, {"a": a, "b": b}).tolist())


@pytest.fixture(scope="module")
def learnable(spark):
    rng = random.Random(3)
    rows = []
    for s in range(40):
        for w in range(12):
            t = s % 2
            rows.append((f"s{s}", w, t, rng.gauss(1.5 * t, 1), rng.gauss(0, 1), rng.gauss(t, 2) if rng.random() > 0.1 else None, 5.0, 0.1))
    return spark.createDataFrame(rows, "sample string, window int, target int, strong double, noise double, weak double, dc double, ac_dc_ratio double").cache()


def test_training_finds_the_signal(learnable):
    model = trees.fit(learnable, ["noise", "strong", "weak"], "target", Boosting(rounds=6, depth=2, bins=16))
    gains = model.gains()
    assert max(gains, key=gains.get) == "strong" and len(model.trees) == 6
    auc = metrics.ranked_auc(trees.scored(learnable, model), ["margin"], "target").first()["auc"]
    assert auc > 0.85
    twice = trees.fit(learnable, ["noise", "strong", "weak"], "target", Boosting(rounds=6, depth=2, bins=16))
    assert [len(t.nodes) for t in twice.trees] == [len(t.nodes) for t in model.trees]


def test_written_margins_change_nothing(learnable, monkeypatch):
    p = Boosting(rounds=5, depth=2, bins=8)
    whole = trees.fit(learnable, ["strong", "weak"], "target", p)
    monkeypatch.setattr(trees, "WRITTEN", 2)
    parts = trees.fit(learnable, ["strong", "weak"], "target", p)
    shape = lambda m: [[(n.feature, n.threshold) if isinstance(n, Split) else round(n.value, 9) for n in t.nodes] for t in m.trees]
    assert shape(whole) == shape(parts)


def test_first_leaf_is_the_newton_step(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "x double, y int")
    model = trees.fit(df, ["x"], "y", Boosting(rounds=1, depth=1, rate=1.0, ridge=0.0, min_child_weight=0.0))
    split = model.trees[0].nodes[0]
    assert split.threshold == 5.0 and [n.value for n in model.trees[0].nodes[1:]] == pytest.approx([-2.0, 2.0])


def test_attributions_sum_to_the_margin():
    model = trees.from_rows(trees.parsed_dump([DUMP], ["first", "second"]))
    tree = model.trees[0]
    expected = (8 * -0.1 + 12 * (5 * 0.05 + 7 * 0.2) / 12) / 20
    for x in ({"first": 1.0, "second": 0.0}, {"first": 50.0, "second": 0.5}, {"first": float("nan"), "second": float("nan")}):
        margin = trees.predict(model, {k: np.array([v]) for k, v in x.items()})[0]
        assert sum(selection.attributions(tree, x, ["first", "second"]).values()) == pytest.approx(margin - expected)


def test_vif_drops_collinear_columns(spark):
    rng = np.random.default_rng(123)
    a, c = rng.normal(size=200), rng.normal(size=200)
    b = 1.01 * a + 0.01 * rng.normal(size=200)
    d = rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, d)], "x0 double, x1 double, x2 double, x3 double")
    v = stats.vif(stats.correlation_matrix(df, ["x0", "x1", "x2"]))
    assert v[0] > 10 and v[1] > 10 and v[2] < 2
    assert stats.pruned_by_vif(df, ["x0", "x1", "x2", "x3"]) == ["x2", "x3"]
    assert stats.pruned_by_correlation(df.withColumn("t", F.col("x1")), ["x0", "x1", "x2"], "t", 0.9) == ["x1", "x2"]


def test_cleaning_of_nulls_constants_and_infinities(spark):
    df = spark.createDataFrame([(float(i % 7), None, 1.0, float("inf") if i == 3 else float(i), i % 2) for i in range(50)], "a double, empty double, flat double, wild double, target int")
    kept, gone, fills = stats.cleaned(df, ["a", "empty", "flat", "wild"], "target")
    assert kept == ["a", "wild"] and gone["missing"] == ["empty"] and gone["low_variance"] == ["flat"] and np.isfinite(fills["wild"])


def test_hard_negatives(spark):
    df = spark.createDataFrame([("a", 0, 0.93), ("b", 0, 0.20), ("c", 1, 0.99), ("d", 0, 0.91), ("e", 0, None)], "s string, target int, p double")
    got = {r.s: (r.weight, r.reason) for r in folds.hard_negatives(df, "p", "target", 0.9, 0.5).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 3.0, "b": 1.0, "c": 1.0, "d": 3.0, "e": 1.0}
    assert got["a"][1] == "probability_and_top_percentile" and got["b"][1] is None


def test_folds(spark):
    df = spark.createDataFrame([(f"g{i % 11}", i % 2) for i in range(110)], "g string, target int")
    for dealt in (folds.round_robin(df, "g", 3), folds.hashed(df, "g", 3)):
        assert dealt.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and dealt.count() == 110
    assert folds.balanced({"a": 5, "b": 4, "c": 3, "d": 2}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_group_supplement():
    ranked = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "z")]
    assert ranking.supplemented(["a", "b", "c"], ranked, "z", 2, 4) == ["a", "b", "d", "e"]
    assert ranking.supplemented(["a", "d"], ranked, "z", 1, 2) == ["a", "d"]


def test_candidates_and_counts(learnable):
    axes = {"rounds": list(range(100)), "depth": list(range(100)), "rate": [0.1] * 200}
    drawn = selection.candidates(axes, 10, 1)
    assert drawn[0] == Boosting() and 2 <= len(drawn) <= 11 and drawn == selection.candidates(axes, 10, 1)
    record = selection.cross_validated(learnable, ["strong", "noise"], "sample", [Boosting(rounds=2, depth=2, bins=8), Boosting(rounds=1, depth=1, bins=4)])
    assert len(record) == 2 and record["accuracy"].max() > 0.6 and (record["n_splits"] >= 2).all()


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (2.0, 0), (3.0, 1)], "x double, target int")
    assert metrics.ranked_auc(df, ["x"], "target").first()["auc"] == pytest.approx(4 / 6)
    assert metrics.ranked_auc(df.where("target = 1"), ["x"], "target").first()["auc"] is None


def test_sweep_counts(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1), (None, 1)], "p double, y int")
    got = {round(r.threshold, 2): (r.tn, r.fp, r.fn, r.tp) for r in metrics.swept(df, "p", "y", [0.95, 0.5, 0.0]).collect()}
    assert got == {0.0: (0, 2, 1, 2), 0.5: (1, 1, 1, 2), 0.95: (2, 0, 3, 0)}
    best = metrics.best_threshold(metrics.swept(df.where("p is not null"), "p", "y", [0.2, 0.3, 0.6]), "f1").first()
    assert best.threshold == pytest.approx(0.2)


def test_whole_run(learnable):
    run = pipeline.Run(learnable, ["strong", "noise", "weak"], pipeline.Settings(model_budget=1, sweep_budget=3, boosting=Boosting(rounds=2, depth=2, bins=8), valid=0.25, test=0.2, n_folds=2, axes={"rounds": [1, 3], "depth": [1]}, least={"emg_activity": 1}, feature_counts=[1], class_weight="balanced"), groups={"strong": "emg_contact", "noise": "emg_activity", "weak": "emg_frequency"})
    assert pipeline.execute(run, dry_run=True, stop_after="train") == ["split", "gate", "select", "train"]
    with pytest.raises(ValueError):
        pipeline.execute(run, skip=["nothing"])
    assert pipeline.execute(run) == list(pipeline.STEPS)
    bundle = run.state["bundle"]
    assert "strong" in bundle.features and Bundle.from_json(bundle.to_json()) == bundle
    got = {r.split: r.accuracy for r in run.reports["samples"].collect()}
    assert set(got) == {"train", "valid", "test"} and got["train"] > 0.5
    assert run.reports["errors"].count() and run.reports["ood"].count() == 40
    # Each switch shows in its result.
    windows = lambda: sum(x.tn + x.fp + x.fn + x.tp for x in run.reports["windows"].collect())
    assert windows() == 480 - 40 * 3
    run.settings.warmup = 0
    pipeline.evaluate_step(run)
    assert windows() == 480
    assert "combined_score" in run.reports["ranked"].columns and set(run.state["agreement"]) == {"rho", "overlap", "n_suspicious"}
    assert "noise" in run.state["features"] and len(bundle.features) == 1 < len(run.state["features"])
    assert bundle.quality and run.state["scored"].where("quality < 1").count() > 0
    gate = run.state["gate"]
    run.settings.search_gate = True
    pipeline.gate_step(run)
    assert run.state["gate"] != gate
    assert selection.class_weight(learnable.where("target = 1 or window < 3")) == pytest.approx(0.25)
    with pytest.raises(ValueError):
        Bundle.from_json("{}")


@pytest.mark.parametrize("taken", [50_000, 7])
def test_quantiles_are_exact(spark, monkeypatch, taken):
    """Also where brackets must be narrowed again and again."""
    monkeypatch.setattr(stats, "TAKEN", taken)
    rng = np.random.default_rng(5)
    a, b = rng.lognormal(0, 3, 4000), rng.integers(0, 3, 4000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None, float("nan")) for x, y in zip(a, b)], "a double, b double, none double, nan double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    got = stats.quantiles(df, ["a", "b", "none", "nan"], shares)
    assert got["a"] == pytest.approx(np.quantile(a, shares).tolist()) and got["b"] == pytest.approx(np.quantile(b, shares).tolist())
    assert got["none"] == got["nan"] == [None] * 6


def test_auc_over_ranges(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 3000)
    x = np.where(rng.random(3000) < 0.3, 1.0, rng.normal(y * 0.7, 1).round(2))
    df = spark.createDataFrame([(float(v), int(t)) for v, t in zip(x, y)], "x double, y int")
    pos, neg = x[y == 1], x[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.ranked_auc(df, ["x"], "y").first()["auc"] == pytest.approx(want)


def test_fold_fallbacks(spark):
    rows = [(f"g{i % 4}", i, int(i % 4 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, target int")
    assert folds.with_fallback(df, "g", ["g", "i"], n_folds=2)[1] == "stratified_fallback"
    spread = spark.createDataFrame([(f"g{i % 8}", i, i % 3 % 2) for i in range(80)], "g string, i int, target int")
    assert folds.with_fallback(spread, "g", ["g", "i"], n_folds=2)[1] == "g"
    assert folds.with_fallback(df.where("target = 0"), "g", ["g", "i"])[1] == "simple_fallback"


def test_nothing_is_tuned_on_test_rows(spark):
    from tidelark.operators import postprocess

    df = spark.createDataFrame([("valid",), ("test",)], "split string")
    assert postprocess.refused(df.where("split = 'valid'")).count() == 1
    with pytest.raises(ValueError):
        postprocess.refused(df)


def test_leaves_under_an_l1_penalty(spark):
    """By hand: five rows a side, each with gradient 0.5 and hessian 0.25; 2.5 less 0.5 over 1.25 and a ridge of 0.75."""
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "x double, y int")
    model = trees.fit(df, ["x"], "y", Boosting(rounds=1, depth=1, rate=1.0, ridge=0.75, min_child_weight=0.0, alpha=0.5))
    assert [n.value for n in model.trees[0].nodes[1:]] == pytest.approx([-1.0, 1.0]) and model.trees[0].nodes[0].gain == pytest.approx((4 / 2 + 4 / 2) / 2)
    flat = trees.fit(df, ["x"], "y", Boosting(rounds=1, depth=1, rate=1.0, ridge=0.0, min_child_weight=0.0, alpha=3.0))
    assert len(flat.trees[0].nodes) == 1 and flat.trees[0].nodes[0].value == 0


def test_rows_and_columns_of_a_tree_are_drawn_repeatably(learnable):
    p = Boosting(rounds=4, depth=1, bins=8, subsample=0.5, columns=0.5)
    names = ["strong", "noise", "weak", "dc"]
    models = [trees.fit(df, names, "target", p) for df in (learnable, learnable.repartition(7))]
    shape = lambda m: [[(n.feature, n.threshold) if isinstance(n, Split) else (round(n.value, 9), round(n.cover, 6)) for n in t.nodes] for t in m.trees]
    assert shape(models[0]) == shape(models[1])
    covers = [sum(n.cover for n in t.nodes if isinstance(n, Leaf)) for t in models[0].trees]
    assert all(0.35 * 480 * 0.25 < c < 0.65 * 480 * 0.25 for c in covers) and len(set(covers)) > 1
    first = {t.nodes[0].feature for t in models[0].trees if isinstance(t.nodes[0], Split)}
    assert first - {"strong"}  # where that column wasn't drawn


def test_search_space_is_the_whole_product():
    assert np.prod([len(v) for v in pipeline.AXES.values()]) == 1_389_150


def test_tabulated_rates_are_those_of_each_pair(spark):
    from tidelark.operators import gates

    rng = np.random.default_rng(8)
    rows = [(f"s{i % 17}", i % 17 % 2, float(rng.integers(0, 9)), float(rng.integers(0, 9)) / 8) for i in range(400)] + [("s0", 0, None, 0.1), ("s1", 1, float("nan"), 0.1), ("s2", 0, 100.0, float("inf"))]
    df = spark.createDataFrame(rows, "sample string, target int, dc double, ac_dc_ratio double")
    levels, ratios = [-1.0, 0.0, 2.5, 3.0, 8.0, 9.0], [0.0, 0.125, 0.5, 0.51, 2.0]
    got = gates.tabulated(df, levels, ratios)
    for d, dc in enumerate(levels):
        for k, r in enumerate(ratios):
            passed = [(s, t) for s, t, x, y in rows if x is not None and np.isfinite(x) and np.isfinite(y) and x > dc and y < r]
            for t in (0, 1):
                windows, samples = [x for x in rows if x[1] == t], {x[0] for x in rows if x[1] == t}
                assert got[f"window_target{t}_pass_rate"][d, k] == pytest.approx(sum(x[1] == t for x in passed) / len(windows))
                assert got[f"sample_target{t}_pass_rate"][d, k] == pytest.approx(len({x[0] for x in passed if x[1] == t}) / len(samples))
    found = gates.searched(df.where("dc is not null and not isnan(dc)"), 0.5, 12, 8)
    assert found and found[-1]["sample_target1_pass_rate"] >= 0.5 and gates.searched(df.where("false")) == []


def test_searches_fall_back_to_other_folds(spark):
    df = spark.createDataFrame([(f"g{i % 2}", i, i % 2, float(i % 2) + i / 100) for i in range(60)], "g string, i int, target int, x double")
    record = selection.cross_validated(df, ["x"], "g", [Boosting(rounds=1, depth=1, bins=4)], n_folds=2, keys=["g", "i"])
    assert record.iloc[0]["folds"] == "stratified_fallback" and record.iloc[0]["n_splits"] == 2
    assert selection.cross_validated(df, ["x"], "g", [Boosting(rounds=1, depth=1, bins=4)], n_folds=2).iloc[0]["n_splits"] == 0


def test_grids_and_scales():
    from tidelark.functions import features
    from tidelark.operators import grids

    assert len(grids.state_machine_grid()) == 2520
    assert features.by_scale(["PPG_mean", "EMG0_ZC"]) == (["PPG_mean"], ["EMG0_ZC"]) and features.deployable(["PPG_mean", "x"]) == (["PPG_mean"], ["x"])
    assert features.SCALE_DEPENDENT <= set(features.NAMES)


def test_correlations_of_many_features(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) * [1, 10, 1e-3, 1, 1] + [0, 1e7, 5, 0, 3]
    x[:, 3] += 2 * x[:, 0]
    rows = [[None if rng.random() < 0.2 and j != 1 else float(v) for j, v in enumerate(r)] + [7.1, float("inf") if i == 3 else 1.0 * i, None] for i, r in enumerate(x)]
    names = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    want = {(r["feature_a"], r["feature_b"]): r["r"] for r in stats.correlations(df, names).collect()}
    monkeypatch.setattr(stats, "WIDE", 2)
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in stats.correlations(df, names).collect()}
    assert got.keys() == want.keys() and len(got) == 28
    for k, r in want.items():
        if r is None or r != r:
            assert got[k] is None or got[k] != got[k], k
        else:
            assert got[k] == pytest.approx(r, abs=1e-9), k
    assert [r["r"] for r in stats.correlations(df.where("x0 > 1e9"), names).collect()] == [None] * 28


def test_correlations_of_241_features(spark):
    names = [f"c{i}" for i in range(241)]
    df = spark.range(300).select(*[(F.hash(F.col("id"), F.lit(i // 2)) + F.lit(i % 2)).cast("double").alias(c) for i, c in enumerate(names)])
    m = stats.correlation_matrix(df, names)
    assert m[0, 1] == pytest.approx(1.0) and abs(m[0, 2]) < 0.3 and m.shape == (241, 241)
    assert stats.correlations(df, names).count() == 241 * 240 // 2


def test_attributions_of_columns_are_those_of_rows():
    tree = trees.from_rows(trees.parsed_dump([DUMP], ["first", "second"])).trees[0]
    x = {"first": np.array([1.0, 50.0, float("nan"), float("inf"), 4.9]), "second": np.array([0.0, 0.5, float("nan"), 0.1, float("nan")])}
    whole = selection.attributions(tree, x, ["first", "second"])
    for i in range(5):
        one = selection.attributions(tree, {k: float(v[i]) for k, v in x.items()}, ["first", "second"])
        assert all(whole[f][i] == pytest.approx(float(one[f])) for f in one)
