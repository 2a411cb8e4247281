"""Queries from window probabilities to decisions: postprocessing, evaluation, sweeps, error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators import gates, grids, metrics, postprocess, windows
from tidelark.operators.postprocess import Hysteresis
from tidelark.plans.columns import CELLS, PREDICTED, RATES, rounded_rates
from tidelark.plans.registry import query
from tidelark.plans.roles import DC, RATIO, SIG, THRESHOLD, WINDOWS, signal, window_features
from tidelark.plans.signals import r6

MACHINE = Hysteresis(alpha=0.4, t_on=0.45, t_off=0.35, k_on=2, k_off=2, cooldown=2.0)
OFFSET, MEDIAN = 0.02, 3


def machine_sql(steps: str, m: Hysteresis = MACHINE, name: str = "sm") -> str:
    """Recursive walk of the state machine over rows (sample, n from 1, p, q)."""
    return f"""{name}(sample, n, state, score, on_c, off_c, since) AS (
  SELECT DISTINCT sample, CAST(0 AS BIGINT), 0, CAST(0 AS DOUBLE), 0, 0, 999 FROM {steps}
  UNION ALL
  SELECT sample, n, CASE WHEN flips THEN 1 - state ELSE state END, score, CASE WHEN flips THEN 0 ELSE on_c END, CASE WHEN flips THEN 0 ELSE off_c END, CASE WHEN flips THEN 0 ELSE since END FROM (
    SELECT *, since >= {m.cooldown_steps} AND CASE WHEN state = 0 THEN on_c >= {m.k_on} ELSE off_c >= {m.k_off} END AS flips FROM (
      SELECT sample, n, state, score, since, CASE WHEN state = 0 THEN CASE WHEN score > {m.t_on} THEN on_c + 1 ELSE greatest(on_c - 1, 0) END ELSE on_c END AS on_c,
        CASE WHEN state = 1 THEN CASE WHEN score < {m.t_off} THEN off_c + 1 ELSE greatest(off_c - 1, 0) END ELSE off_c END AS off_c FROM (
          SELECT s.sample, x.n, s.state, {m.alpha} * x.q * x.p + (1 - {m.alpha} * x.q) * s.score AS score, s.since + 1 AS since, s.on_c, s.off_c FROM {name} s JOIN {steps} x ON x.sample = s.sample AND x.n = s.n + 1))))"""


def recentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with shifted, gated and smoothed probabilities."""
    w = window_features(spark, sf_dir).withColumn("flag", gates.passes(DC, RATIO))
    w = w.withColumn("shifted", postprocess.recentred(F.col("prob"), THRESHOLD, OFFSET)).withColumn("gated", gates.gated(F.col("shifted"), F.col("flag")))
    return w.withColumn("smooth", postprocess.causal_median("gated", "sample", ["window"], MEDIAN)).withColumn("quality", F.when(F.col("ac_dc_ratio") > 2, 0.5).otherwise(1.0))


CHAIN = f"""{WINDOWS}, g AS (SELECT *, dc > {DC} AND ac_dc_ratio < {RATIO} AS flag, least(greatest(prob - least(greatest({THRESHOLD} + {OFFSET}, 0.02), 0.98) + 0.5, 0), 1) AS shifted FROM win),
gg AS (SELECT *, CASE WHEN flag THEN shifted ELSE 0.0 END AS gated, CASE WHEN ac_dc_ratio > 2 THEN 0.5 ELSE 1.0 END AS q FROM g),
sw AS (SELECT *, quantile_cont(gated, 0.5) OVER (PARTITION BY sample ORDER BY win ROWS {MEDIAN - 1} PRECEDING) AS p, row_number() OVER (PARTITION BY sample ORDER BY win) AS n FROM gg)"""
WALK = f"RECURSIVE {CHAIN}, {machine_sql('sw')}"
ENDS = f"{WALK}, ends AS (SELECT sample, CAST(sample % 2 AS INT) AS target, state AS pred, score FROM sm WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n DESC) = 1), everyone AS (SELECT DISTINCT user_id AS sample, CAST(user_id % 2 AS INT) AS target FROM events)"


@query(f"WITH {CHAIN} SELECT sample, win AS \"window\", round(shifted, 6) AS shifted FROM sw")
def prob_recentering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recentred(spark, sf_dir).select("sample", "window", r6("shifted").alias("shifted"))


@query(f"WITH {CHAIN} SELECT sample, win AS \"window\", round(gated, 6) AS gated FROM sw")
def prob_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recentred(spark, sf_dir).select("sample", "window", r6("gated").alias("gated"))


@query(f"WITH {CHAIN} SELECT sample, win AS \"window\", round(p, 6) AS smooth FROM sw")
def causal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recentred(spark, sf_dir).select("sample", "window", r6("smooth").alias("smooth"))


@query(f"WITH {ENDS} SELECT sample, target, pred AS state, round(score, 6) AS score FROM ends")
def state_machine_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = postprocess.final_states(recentred(spark, sf_dir), "sample", ["window"], "smooth", "quality", machine=MACHINE, keep=["target"])
    return ends.select("sample", "target", "state", r6("score").alias("score"))


@query(f"WITH {WALK} SELECT s.sample, x.win AS \"window\", s.state, round(s.score, 6) AS score FROM sm s JOIN sw x ON x.sample = s.sample AND x.n = s.n")
def state_machine_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = postprocess.trace(recentred(spark, sf_dir).select("sample", "window", "smooth", "quality"), "sample", ["window"], "smooth", "quality", MACHINE)
    return t.select("sample", "window", "state", r6("score").alias("score"))


EVENT_STEPS = f"{SIG}, ev AS (SELECT sample, idx + 1 AS n, v / (v + 20) AS p, 1.0 AS q FROM sig)"


@query(f"WITH RECURSIVE {EVENT_STEPS}, {machine_sql('ev')} SELECT sample, n - 1 AS idx, state, round(score, 6) AS score FROM sm WHERE n > 0")
def state_machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).select("sample", F.col("idx").cast("long").alias("idx"), (F.col("v") / (F.col("v") + 20)).alias("p"))
    return postprocess.trace(s, "sample", ["idx"], "p", None, MACHINE).select("sample", "idx", "state", r6("score").alias("score"))


@query(f"WITH {WINDOWS} SELECT sample, CAST(avg(CASE WHEN prob >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) >= 0.5 AS INT) AS mean_vote, CAST(avg(prob) >= {THRESHOLD} AS INT) AS prob_mean FROM win GROUP BY sample")
def mean_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.votes(window_features(spark, sf_dir), "sample", "prob", THRESHOLD)


@query(f"WITH {ENDS}, c AS (SELECT e.target, coalesce(pred, 0) AS pred FROM everyone e LEFT JOIN ends USING (sample)), k AS (SELECT {CELLS} FROM c) SELECT tn, fp, fn, tp, {RATES} FROM k")
def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from raw positions to the evaluation of samples' decisions."""
    samples = signal(spark, sf_dir).select("sample", "target").distinct()
    ends = postprocess.final_states(recentred(spark, sf_dir), "sample", ["window"], "smooth", "quality", machine=MACHINE)
    return rounded_rates(postprocess.sample_metrics(samples, ends, "sample"))


WARM = 2


@query(f"WITH {WALK}, c AS (SELECT CAST(sample % 2 AS INT) AS target, state AS pred FROM sm WHERE n > {WARM}), k AS (SELECT {CELLS} FROM c) SELECT tn, fp, fn, tp, {RATES} FROM k")
def window_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = postprocess.trace(recentred(spark, sf_dir).select("sample", "target", "window", "smooth", "quality"), "sample", ["window"], "smooth", "quality", MACHINE)
    return rounded_rates(metrics.evaluated(windows.after_warmup(t, "sample", ["window"], WARM), F.col("state"), F.col("target")))


@query(f"WITH {PREDICTED}, d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sample ORDER BY win) > {WARM}), k AS (SELECT {CELLS} FROM d) SELECT tn, fp, fn, tp, {RATES} FROM k")
def window_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.after_warmup(window_features(spark, sf_dir), "sample", ["window"], WARM)
    return rounded_rates(metrics.evaluated(w, (F.col("prob") >= THRESHOLD).cast("int"), F.col("target")))


GRID = [
    {"threshold_offset": 0.0, "median_k": 1, "alpha": 0.4, "t_on": 0.5, "t_off": 0.35, "k_on": 1, "k_off": 2, "cooldown": 0},
    {"threshold_offset": 0.0, "median_k": 1, "alpha": 0.6, "t_on": 0.45, "t_off": 0.3, "k_on": 2, "k_off": 1, "cooldown": 2},
    {"threshold_offset": -0.05, "median_k": 3, "alpha": 0.4, "t_on": 0.45, "t_off": 0.35, "k_on": 1, "k_off": 3, "cooldown": 0},
    {"threshold_offset": -0.05, "median_k": 3, "alpha": 0.25, "t_on": 0.4, "t_off": 0.2, "k_on": 1, "k_off": 1, "cooldown": 5},
]


def _sweep_sql() -> str:
    parts, ends = [], []
    for i, p in enumerate(GRID):
        shifted = f"least(greatest(prob - least(greatest({THRESHOLD} + ({p['threshold_offset']}), 0.02), 0.98) + 0.5, 0), 1)"
        m = Hysteresis(p["alpha"], p["t_on"], p["t_off"], p["k_on"], p["k_off"], p["cooldown"])
        parts.append(f"""b{i} AS (SELECT sample, win, CASE WHEN dc > {DC} AND ac_dc_ratio < {RATIO} THEN {shifted} ELSE 0.0 END AS g, 1.0 AS q FROM win),
s{i} AS (SELECT *, quantile_cont(g, 0.5) OVER (PARTITION BY sample ORDER BY win ROWS {p['median_k'] - 1} PRECEDING) AS p, row_number() OVER (PARTITION BY sample ORDER BY win) AS n FROM b{i}), {machine_sql(f's{i}', m, f'm{i}')}""")
        ends.append(f"SELECT {i} AS i, CAST(sample % 2 AS INT) AS target, state AS pred FROM m{i} WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n DESC) = 1")
    listed = ", ".join(f"({i}, {p['threshold_offset']}::DOUBLE, {p['median_k']}::INT, {p['alpha']}::DOUBLE, {p['t_on']}::DOUBLE)" for i, p in enumerate(GRID))
    return f"""WITH RECURSIVE {WINDOWS}, {', '.join(parts)}, e AS ({' UNION ALL '.join(f'({x})' for x in ends)}), k AS (SELECT i, {CELLS} FROM e GROUP BY i), pr(i, threshold_offset, median_k, alpha, t_on) AS (VALUES {listed})
SELECT threshold_offset, median_k, alpha, t_on, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp) + 0.35 * CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END - 1.5 * CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS objective FROM k JOIN pr USING (i)"""


@query(_sweep_sql())
def postprocess_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = postprocess.swept(window_features(spark, sf_dir), "sample", ["window"], "prob", gates.passes(DC, RATIO), THRESHOLD, GRID)
    return s.select("threshold_offset", "median_k", "alpha", "t_on", "tn", "fp", "fn", "tp", r6("objective").alias("objective"))


EVERYONE = "everyone AS (SELECT DISTINCT user_id AS sample, CAST(user_id % 2 AS INT) AS target FROM events)"
HARD = """h AS (SELECT sample, bool_and(CAST(prob >= 0.2 AND dc > 0.5 AS INT) = target) AS ok FROM win GROUP BY sample),
status AS (SELECT e.sample, e.target, CASE WHEN ok IS NULL THEN 'no_windows' WHEN ok THEN 'all_correct' ELSE 'hard' END AS status FROM everyone e LEFT JOIN h USING (sample))"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = signal(spark, sf_dir).select("sample", "target").distinct()
    return postprocess.sample_status(window_features(spark, sf_dir), "sample", samples, ((F.col("prob") >= 0.2) & (F.col("dc") > 0.5)).cast("int"))


@query(f"WITH {WINDOWS}, {EVERYONE}, {HARD} SELECT sample, target, status FROM status")
def hard_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f"WITH {ENDS}, {HARD} SELECT count(*) FILTER (status <> 'hard') AS not_hard, count(*) FILTER (status <> 'hard' AND coalesce(pred, 0) <> status.target) AS regressed FROM status LEFT JOIN ends USING (sample)")
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = postprocess.final_states(recentred(spark, sf_dir), "sample", ["window"], "smooth", "quality", machine=MACHINE)
    joined = _status(spark, sf_dir).join(ends, "sample", "left")
    easy = F.col("status") != "hard"
    return joined.agg(F.count_if(easy).alias("not_hard"), F.count_if(easy & (F.coalesce("state", F.lit(0)) != F.col("target"))).alias("regressed"))


TAGS = f"""{WINDOWS}, t AS (SELECT sample, win, target, CAST(prob >= {THRESHOLD} AND dc > 1.0 AS INT) AS pred, dc > 1.0 AS en, CASE WHEN ac_dc_ratio > 3 THEN 0.4 ELSE 1.0 END AS q, least(ac / 60, 1.0) AS o FROM win),
tag AS (SELECT *, CASE WHEN NOT en THEN 'stage1_blocked' WHEN pred = target THEN 'correct' WHEN o >= 0.3 THEN CASE WHEN pred = 1 THEN 'high_ood_fp' ELSE 'high_ood_fn' END WHEN q < 0.5 THEN CASE WHEN pred = 1 THEN 'low_quality_fp' ELSE 'low_quality_fn' END
 WHEN pred = 1 THEN 'model_fp' ELSE 'model_fn' END AS diagnostic_tag, CAST(pred <> target AS INT) AS is_error FROM t)"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_features(spark, sf_dir).withColumn("pred", ((F.col("prob") >= THRESHOLD) & (F.col("dc") > 1.0)).cast("int"))
    return postprocess.tagged(w, F.col("pred"), F.col("target"), F.col("dc") > 1.0, F.when(F.col("ac_dc_ratio") > 3, 0.4).otherwise(1.0), F.least(F.col("ac") / 60, F.lit(1.0)))


@query(f"WITH {TAGS} SELECT sample, win AS \"window\", target, pred, diagnostic_tag, is_error FROM tag")
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).select("sample", "window", "target", "pred", "diagnostic_tag", "is_error")


@query(f"WITH {TAGS} SELECT diagnostic_tag, count(*) AS n, sum(is_error)::BIGINT AS errors FROM tag GROUP BY diagnostic_tag")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.tag_summary(_tags(spark, sf_dir))


def _listed(values, kind: str) -> str:
    return f"unnest([{', '.join(map(str, values))}]::{kind}[])"


@query(f"""WITH g AS (SELECT o.v AS threshold_offset, a.v AS alpha, t.v AS t_on, f.v AS t_off, k.v AS k_on, l.v AS k_off, c.v AS cooldown, m.v AS median_k, row_number() OVER (ORDER BY o.v, a.v, t.v, f.v, k.v, l.v, c.v, m.v) - 1 AS i, count(*) OVER () AS n
 FROM (SELECT {_listed([-0.05, 0.0, 0.05], 'DOUBLE')} AS v) o, (SELECT {_listed([0.25, 0.4, 0.6], 'DOUBLE')} AS v) a, (SELECT {_listed([0.55, 0.65, 0.75], 'DOUBLE')} AS v) t, (SELECT {_listed([0.20, 0.35, 0.45], 'DOUBLE')} AS v) f,
 (SELECT {_listed([1, 2, 3, 5], 'INT')} AS v) k, (SELECT {_listed([1, 2, 3, 5], 'INT')} AS v) l, (SELECT {_listed([0, 2, 5], 'INT')} AS v) c, (SELECT {_listed([1, 3, 5], 'INT')} AS v) m WHERE f.v < t.v),
r AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = n // 2 THEN 1 WHEN i = n - 1 THEN 2 ELSE 3 END AS first FROM g),
p AS (SELECT *, row_number() OVER (ORDER BY first, abs(threshold_offset), k_on, -k_off, t_on - t_off, median_k, cooldown, alpha, i) - 1 AS place FROM r)
SELECT CAST(place AS INT) AS place, threshold_offset, alpha, t_on, t_off, k_on, k_off, cooldown, median_k FROM p WHERE place < 120""")
def postprocess_grid_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated grid and the order a budget takes it in; reads no table."""
    chosen = grids.budgeted(grids.postprocess_grid((-0.05, 0.0, 0.05)), 120)
    return spark.createDataFrame([(i, *p.values()) for i, p in enumerate(chosen)], "place int, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in chosen[0].items()))


@query(f"WITH {WINDOWS} SELECT sample, target, count(*) AS total_windows, count(*) FILTER (CAST(prob >= {THRESHOLD} AS INT) = target) AS correct_windows FROM win GROUP BY sample, target")
def per_sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_features(spark, sf_dir)
    return w.groupBy("sample", "target").agg(F.count("*").alias("total_windows"), F.count_if((F.col("prob") >= THRESHOLD).cast("int") == F.col("target")).alias("correct_windows"))


@query(f"""WITH RECURSIVE {WINDOWS}, x AS (SELECT sample, least(greatest(prob - {THRESHOLD} + 0.5, 0), 1) AS p, row_number() OVER (PARTITION BY sample ORDER BY win) AS n FROM win),
g AS (SELECT a.v AS alpha, t.v AS t_on, f.v AS t_off, k.v AS k_on, l.v AS k_off, c.v AS cooldown FROM (SELECT {_listed([0.2, 0.3, 0.4, 0.5, 0.6], 'DOUBLE')} AS v) a, (SELECT {_listed([0.5, 0.6, 0.7, 0.8], 'DOUBLE')} AS v) t, (SELECT {_listed([0.2, 0.3, 0.4], 'DOUBLE')} AS v) f,
 (SELECT {_listed([3, 5, 7, 10, 15], 'INT')} AS v) k, (SELECT {_listed([3, 5, 7, 10], 'INT')} AS v) l, (SELECT {_listed([2, 5, 10], 'INT')} AS v) c WHERE f.v < t.v AND k.v >= l.v),
m(sample, n, alpha, t_on, t_off, k_on, k_off, cooldown, state, score, on_c, off_c, since) AS (
 SELECT sample, CAST(0 AS BIGINT), alpha, t_on, t_off, k_on, k_off, cooldown, 0, CAST(0 AS DOUBLE), 0, 0, 999 FROM (SELECT DISTINCT sample FROM x), g
 UNION ALL
 SELECT sample, n, alpha, t_on, t_off, k_on, k_off, cooldown, CASE WHEN flips THEN 1 - state ELSE state END, score, CASE WHEN flips THEN 0 ELSE on_c END, CASE WHEN flips THEN 0 ELSE off_c END, CASE WHEN flips THEN 0 ELSE since END FROM (
  SELECT *, since >= cooldown AND CASE WHEN state = 0 THEN on_c >= k_on ELSE off_c >= k_off END AS flips FROM (
   SELECT * REPLACE (CASE WHEN state = 0 THEN CASE WHEN score > t_on THEN on_c + 1 ELSE greatest(on_c - 1, 0) END ELSE on_c END AS on_c, CASE WHEN state = 1 THEN CASE WHEN score < t_off THEN off_c + 1 ELSE greatest(off_c - 1, 0) END ELSE off_c END AS off_c) FROM (
    SELECT s.sample, x.n, s.alpha, s.t_on, s.t_off, s.k_on, s.k_off, s.cooldown, s.state, s.alpha * x.p + (1 - s.alpha) * s.score AS score, s.on_c, s.off_c, s.since + 1 AS since FROM m s JOIN x ON x.sample = s.sample AND x.n = s.n + 1)))),
e AS (SELECT m.*, CAST(sample % 2 AS INT) AS target, state AS pred FROM m JOIN (SELECT sample, max(n) AS n FROM x GROUP BY sample) USING (sample, n)),
c AS (SELECT alpha, t_on, t_off, k_on, k_off, cooldown, {CELLS} FROM e GROUP BY alpha, t_on, t_off, k_on, k_off, cooldown), r AS (SELECT *, {RATES} FROM c)
SELECT alpha, t_on, t_off, k_on, k_off, cooldown, tn, fp, fn, tp, accuracy, precision, recall, f1 FROM r
ORDER BY recall >= 0.9 DESC, CASE WHEN recall >= 0.9 THEN f1 ELSE recall END DESC, f1 DESC, alpha, t_on, t_off, k_on, k_off, cooldown LIMIT 1""")
def state_machine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine's own grid, whole: the highest F1 among sets of sufficient recall."""
    grid = grids.state_machine_grid()
    w = window_features(spark, sf_dir).withColumn("p", postprocess.recentred(F.col("prob"), THRESHOLD))
    ends = postprocess.final_states(w, "sample", ["window"], "p", params=grid, keep=["target"])
    names = list(grid[0])
    return rounded_rates(postprocess.constrained(metrics.evaluated(ends, F.col("state"), F.col("target"), names), names, 0.9), *names)
