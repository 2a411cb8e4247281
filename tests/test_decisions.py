"""Golden traces of the decision chain, and batch against stream."""

import random

import pytest
from pyspark.sql import functions as F

from tidelark.operators import gates, grids, postprocess, windows
from tidelark.operators.postprocess import Hysteresis, walk

SHARP = Hysteresis(alpha=1.0, t_on=0.5, t_off=0.2, k_on=1, k_off=1, cooldown=0.0)


def frame(spark, probs, gate=None, sample="a"):
    gate = gate or [True] * len(probs)
    return spark.createDataFrame([(sample, i, float(p), g) for i, (p, g) in enumerate(zip(probs, gate))], "sample string, i int, p double, open boolean")


@pytest.mark.parametrize(
    ("probs", "gate", "k", "states", "scores"),
    [([0.99] * 3, [False] * 3, 1, [0, 0, 0], [0.0] * 3), ([0.9, 0.8, 0.7], [True, False, True], 1, [1, 0, 1], [0.9, 0.0, 0.7]), ([0.0, 1.0, 0.0], None, 3, [0, 0, 0], [0.0, 0.5, 0.0])],
)
def test_golden_traces(spark, probs, gate, k, states, scores):
    df = frame(spark, probs, gate).withColumn("p", gates.gated(F.col("p"), F.col("open")))
    df = df.withColumn("p", postprocess.causal_median("p", "sample", ["i"], k))
    rows = postprocess.trace(df, "sample", ["i"], "p", None, SHARP).orderBy("i").collect()
    assert [r.state for r in rows] == states and [r.score for r in rows] == pytest.approx(scores)
    assert postprocess.final_states(df, "sample", ["i"], "p", machine=SHARP).first().state == states[-1]


def test_quality_slows_the_score(spark):
    df = frame(spark, [1.0]).withColumn("q", F.lit(0.25))
    row = postprocess.final_states(df, "sample", ["i"], "p", "q", machine=Hysteresis(1.0, 0.9, 0.2, 1, 1, 0.0)).first()
    assert row.score == 0.25 and row.state == 0


@pytest.mark.parametrize(("threshold", "want"), [(0.5, 0.65), (0.8, 0.35)])
def test_recentring(spark, threshold, want):
    df = frame(spark, [0.65]).select(postprocess.recentred(F.col("p"), threshold).alias("p"))
    assert df.first().p == pytest.approx(want)


def test_shut_gates_outvote(spark):
    df = frame(spark, [0.9] * 3, [False] * 3).withColumn("p", gates.gated(F.col("p"), F.col("open")))
    row = postprocess.votes(df, "sample", "p", 0.5).first()
    assert (row.mean_vote, row.prob_mean) == (0, 0)


def test_fold_equals_walk_on_random_series(spark):
    rng = random.Random(3)
    params = [{"alpha": rng.choice([0.25, 0.4, 1.0]), "t_on": rng.choice([0.5, 0.6]), "t_off": rng.choice([0.3, 0.45]), "k_on": rng.randint(1, 3), "k_off": rng.randint(1, 3), "cooldown": rng.choice([0, 2, 5])} for _ in range(12)]
    series = {f"s{k}": [rng.random() for _ in range(rng.randint(1, 40))] for k in range(8)}
    df = spark.createDataFrame([(s, i, p) for s, ps in series.items() for i, p in enumerate(ps)], "sample string, i int, p double")
    for r in postprocess.final_states(df, "sample", ["i"], "p", params=params).collect():
        m = Hysteresis(r.alpha, r.t_on, r.t_off, r.k_on, r.k_off, r.cooldown)
        states, scores, _ = walk(series[r["sample"]], [1.0] * 99, m)
        assert (r.state, r.score) == (states[-1], pytest.approx(scores[-1]))


def test_sample_status(spark):
    df = spark.createDataFrame([("a", 0.8, 1), ("a", 0.7, 1), ("b", 0.8, 1), ("b", 0.2, 1)], "sample string, p double, target int")
    samples = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "sample string, target int")
    got = {r["sample"]: r.status for r in postprocess.sample_status(df, "sample", samples, (F.col("p") >= 0.5).cast("int")).collect()}
    assert got == {"a": "all_correct", "b": "hard", "c": "no_windows"}


def test_budgets_keep_the_ends():
    grid = grids.postprocess_grid((-0.05, 0.0, 0.05))
    assert len(grids.postprocess_grid([0.0] * 9)) == 34_992
    few = grids.budgeted(grid, 12)
    assert len(few) == 12 and all(p in few for p in (grid[0], grid[len(grid) // 2], grid[-1])) and len({tuple(p.values()) for p in few}) == 12
    assert grids.budgeted(grid, None) == grid


def test_windows_of_short_and_gapped_signals(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "sample string, idx int")
    got = windows.windowed(df, "idx", 4, 3).groupBy("sample", "window").agg(windows.whole(4).alias("w")).where("w").collect()
    assert sorted((r["sample"], r.window) for r in got) == [("a", 0), ("a", 1), ("a", 2)]
    got = windows.windowed(df, "idx", 2, 5).groupBy("sample", "window").agg(windows.whole(2).alias("w")).where("w").collect()
    assert sorted((r["sample"], r.window) for r in got) == [("a", 0), ("a", 1), ("b", 0)]


def test_constant_window_has_no_variation(spark):
    from tidelark.operators.gates import gate_features_array

    a = F.array(*[F.lit(10.0)] * 300)
    row = spark.range(1).select(*[c.alias(k) for k, c in gate_features_array(a).items()]).first()
    assert (row.dc, row.ac, row.ac_dc_ratio) == (10.0, 0.0, 0.0)


def test_stream_goes_on_from_its_state(spark, tmp_path):
    from tidelark.streaming import decisions

    rng = random.Random(5)
    series = {s: [rng.random() for _ in range(60)] for s in ("a", "b")}
    schema = "sample string, i int, p double"
    for part in range(3):  # three files: three micro-batches
        rows = [(s, i, series[s][i]) for s in series for i in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = decisions.table_stream(spark, str(tmp_path / "in"))
    m = Hysteresis(0.6, 0.5, 0.4, 2, 2, 1.0)
    got = {(r["sample"], r.i): (r.state, r.score) for r in decisions.drained(decisions.traced(stream, "sample", ["i"], "p", m), "test").collect()}
    for s, ps in series.items():
        states, scores, _ = walk(ps, [1.0] * 60, m)
        assert [got[s, i][0] for i in range(60)] == states and [got[s, i][1] for i in range(60)] == pytest.approx(scores)


def test_search_takes_the_best_of_the_whole_grid(spark):
    """Against a walk of each set over each sample."""
    from tidelark.operators import grids
    from tidelark.plans.decisions import state_machine_search
    from tidelark.plans.roles import THRESHOLD, window_features

    sf = "/root/testdata/sf0.001"
    w = window_features(spark, sf).withColumn("p", postprocess.recentred(F.col("prob"), THRESHOLD)).select("sample", "target", "window", "p").collect()
    samples = {}
    for r in sorted(w, key=lambda r: (r["sample"], r["window"])):
        samples.setdefault((r["sample"], r["target"]), []).append(r["p"])
    grid, best = grids.state_machine_grid(), None
    assert len(grid) == 2520
    for p in grid:
        m = Hysteresis(p["alpha"], p["t_on"], p["t_off"], p["k_on"], p["k_off"], p["cooldown"])
        cells = {(a, b): 0 for a in (0, 1) for b in (0, 1)}
        for (_, target), probs in samples.items():
            cells[postprocess.walk(probs, [1.0] * len(probs), m)[2][0], target] += 1
        tp, fp, fn = cells[1, 1], cells[1, 0], cells[0, 1]
        recall, f1 = tp / (tp + fn) if tp + fn else 0.0, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        rank = (-(recall >= 0.9), -(f1 if recall >= 0.9 else recall), -f1, *p.values())
        best = min(best, rank) if best else rank
    got = state_machine_search(spark, sf).collect()
    assert [tuple(r[k] for k in grid[0]) for r in got] == [best[3:]]


def test_many_sets_end_as_few_do(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(s, i, None if (s, i) == (1, 4) else float("nan") if (s, i) == (2, 3) else rng.random(), rng.choice([0.5, 1.0])) for s in range(9) for i in range(1 + 5 * s)]
    df = spark.createDataFrame(rows, "sample int, i int, p double, q double")
    params = grids.state_machine_grid()[::97]
    ends = lambda: {tuple(r)[:7]: (r["state"], repr(r["score"])) for r in postprocess.final_states(df, "sample", ["i"], "p", "q", params=params).collect()}
    few = ends()
    monkeypatch.setattr(postprocess, "MANY", 1)
    monkeypatch.setattr(postprocess, "TOGETHER", 4)
    assert ends() == few and len(few) == 9 * len(params)
