"""Queries over feature columns: cleaning, clipping, drift, metrics, ranks, folds, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.operators import folds, metrics, ranking, sampling, stats, trees
from tidelark.plans.registry import query
from tidelark.plans.roles import FEATURES, LINES, LONG, WINDOWS, lines, table, window_features
from tidelark.plans.signals import r6
from tidelark.session import staged

NAMES = ", ".join(FEATURES)
WITH_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM lines" for c in FEATURES)


@query(f"""WITH {LINES} SELECT line, CASE WHEN l_discount * l_tax = 0 THEN 0.0 ELSE round(l_quantity / l_discount, 6) END AS a, coalesce(round(gap, 6), 0.0) AS gap,
 (CASE WHEN l_discount * l_tax = 0 THEN 1 ELSE 0 END) + (CASE WHEN gap IS NULL THEN 1 ELSE 0 END)::BIGINT AS "TOTAL_INVALID_COUNT" FROM lines""")
def invalid_count_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("l_discount") * F.col("l_tax") == 0, F.when(F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide("l_quantity", "l_discount"))
    rows = lines(spark, sf_dir).select("line", r6(bad).alias("a"), r6("gap").alias("gap"))
    return stats.sanitised(rows, ["a", "gap"])


@query(f"WITH {LINES} SELECT feature, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM ({WITH_NULLS}) GROUP BY feature")
def missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.missing_rates(lines(spark, sf_dir), FEATURES).select("feature", r6("missing_rate").alias("missing_rate"))


@query(f"WITH {LINES}, m AS (SELECT quantile_cont(gap, 0.5) AS q FROM lines) SELECT line, round(coalesce(gap, q), 6) AS gap FROM lines, m")
def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return stats.filled(rows, stats.median_fill(rows, ["gap"])).select("line", r6("gap").alias("gap"))


@query(f"WITH {LINES}, {LONG} SELECT feature, round(var_samp(x), 4) AS variance, var_samp(x) > 0.001 AS kept FROM long GROUP BY feature")
def low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.low_variance(lines(spark, sf_dir), FEATURES, 0.001).select("feature", F.round("variance", 4).alias("variance"), "kept")


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM lines" for a, b in PAIRS)


@query(f"WITH {LINES} SELECT feature_a, feature_b, round(r, 6) AS r FROM ({CORR_SQL})")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(lines(spark, sf_dir), FEATURES).select("feature_a", "feature_b", r6("r").alias("r"))


@query(f"WITH {LINES} SELECT feature_a, feature_b, round(greatest(1.0, 1 / (1 - r * r)), 4) AS vif FROM ({CORR_SQL})")
def vif_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vif_of_pairs(lines(spark, sf_dir), FEATURES).select("feature_a", "feature_b", F.round("vif", 4).alias("vif"))


@query(f"""WITH {LINES}, c AS (SELECT abs(corr(l_extendedprice, net)) AS r, abs(corr(l_extendedprice, target)) AS a, abs(corr(net, target)) AS b, abs(corr(l_quantity, gap)) AS r2, abs(corr(l_quantity, target)) AS a2, abs(corr(gap, target)) AS b2 FROM lines)
SELECT unnest(list_filter(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'net', 'gap'], lambda f: NOT (f = CASE WHEN r > 0.9 THEN CASE WHEN b >= a THEN 'l_extendedprice' ELSE 'net' END ELSE '' END) AND NOT (f = CASE WHEN r2 > 0.9 THEN CASE WHEN b2 >= a2 THEN 'l_quantity' ELSE 'gap' END ELSE '' END))) AS feature FROM c""")
def corr_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stats.pruned_by_correlation(lines(spark, sf_dir), FEATURES, "target", 0.9)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query()
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    kept, gone, fills = stats.cleaned(rows, FEATURES, "target", missing=0.5, alike=0.999)
    reason = {c: k for k, cs in gone.items() for c in cs}
    return spark.createDataFrame([(c, reason.get(c, "kept"), fills.get(c)) for c in FEATURES], "feature string, reason string, fill double")


@query(f"""WITH {LINES}, b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS lo, quantile_cont(l_extendedprice, 0.75) AS hi FROM lines)
SELECT line, round(least(greatest(l_extendedprice, lo - 0.2 * (hi - lo)), hi + 0.2 * (hi - lo)), 6) AS l_extendedprice FROM lines, b""")
def iqr_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return stats.clipped(rows, stats.clip_bounds(rows, ["l_extendedprice"], 0.2)).select("line", r6("l_extendedprice").alias("l_extendedprice"))


@query(f"WITH {LINES}, {LONG} SELECT feature, round(quantile_cont(x, 0.05), 6) AS q_low, round(quantile_cont(x, 0.95), 6) AS q_high FROM long GROUP BY feature")
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = stats.quantile_bands(lines(spark, sf_dir), FEATURES)
    return spark.createDataFrame([(c, *b) for c, b in bands.items()], "feature string, q_low double, q_high double").select("feature", r6("q_low").alias("q_low"), r6("q_high").alias("q_high"))


@query(f"""WITH {LINES}, x AS (SELECT l_quantity AS a_mean, net AS b_std FROM lines)
SELECT 'a_mean' AS feature, 'low' AS type, round(quantile_cont(abs(a_mean), 0.01), 6) AS thr FROM x UNION ALL SELECT 'b_std', 'high', round(quantile_cont(b_std, 0.99), 6) FROM x""")
def quality_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("l_quantity").alias("a_mean"), F.col("net").alias("b_std"))
    return stats.quality_thresholds(rows, ["a_mean", "b_std"]).select("feature", "type", r6("thr").alias("thr"))


@query(f"""WITH {LINES}, t AS (SELECT quantile_cont(net, 0.99) AS hi, quantile_cont(abs(l_quantity), 0.01) AS lo FROM lines),
s AS (SELECT line, greatest(0.5, 1 - 0.5 * least(greatest((net - hi) / abs(hi), 0), 1)) AS a, greatest(0.5, 1 - 0.5 * least(greatest((lo - abs(l_quantity)) / abs(lo), 0), 1)) AS b FROM lines, t) SELECT line, round(a * b, 6) AS quality FROM s""")
def quality_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    q = stats.quantiles(rows, ["net"], [0.99])["net"][0], stats.quantiles(rows.select(F.abs("l_quantity").alias("x")), ["x"], [0.01])["x"][0]
    return rows.select("line", r6(stats.quality({"net": ("high", q[0]), "l_quantity": ("low", q[1])})).alias("quality"))


OOD = f"""{LINES}, b AS (SELECT quantile_cont(l_quantity, 0.05) AS ql, quantile_cont(l_quantity, 0.95) AS qh, quantile_cont(net, 0.05) AS nl, quantile_cont(net, 0.95) AS nh, quantile_cont(gap, 0.05) AS gl, quantile_cont(gap, 0.95) AS gh FROM lines),
o AS (SELECT line, sample, (CASE WHEN l_quantity < ql OR l_quantity > qh THEN 1 ELSE 0 END + CASE WHEN net < nl OR net > nh THEN 1 ELSE 0 END + CASE WHEN gap < gl OR gap > gh THEN 1 ELSE 0 END) / (CASE WHEN gap IS NULL THEN 2 ELSE 3 END) AS ood FROM lines, b)"""


def _ood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return rows.select("line", "sample", stats.ood_score(stats.quantile_bands(rows, ["l_quantity", "net", "gap"])).alias("ood"))


@query(f"WITH {OOD} SELECT line, round(ood, 6) AS ood FROM o")
def ood_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ood(spark, sf_dir).select("line", r6("ood").alias("ood"))


@query(f"WITH {OOD} SELECT sample, round(avg(ood), 6) AS ood_mean, round(avg(CASE WHEN ood > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS ood_window_alert_rate, count(ood) AS n_windows, avg(ood) > 0.3 AS alerts FROM o GROUP BY sample")
def ood_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.ood_summary(_ood(spark, sf_dir), "sample")
    return s.select("sample", r6("ood_mean").alias("ood_mean"), r6("ood_window_alert_rate").alias("ood_window_alert_rate"), "n_windows", "alerts")


@query(f"WITH {LINES} SELECT feature, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std FROM ({WITH_NULLS}) GROUP BY feature")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.feature_summary(lines(spark, sf_dir), FEATURES).select("feature", r6("missing_rate").alias("missing_rate"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(f"""WITH {LINES}, f AS (SELECT line, l_quantity, coalesce(gap, (SELECT quantile_cont(gap, 0.5) FROM lines)) AS gap FROM lines), s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(gap) AS mg, stddev_pop(gap) AS sg FROM f)
SELECT line, round(least(greatest((l_quantity - mq) / sq, -1.5), 1.5), 6) AS l_quantity, round(least(greatest((gap - mg) / sg, -1.5), 1.5), 6) AS gap FROM f, s""")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.standardised(lines(spark, sf_dir).select("line", "l_quantity", "gap"), ["l_quantity", "gap"], 1.5)
    return rows.select("line", r6("l_quantity").alias("l_quantity"), r6("gap").alias("gap"))


RATES = "round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
CELLS = "count(*) FILTER (pred = 0 AND target = 0) AS tn, count(*) FILTER (pred = 1 AND target = 0) AS fp, count(*) FILTER (pred = 0 AND target = 1) AS fn, count(*) FILTER (pred = 1 AND target = 1) AS tp"
PREDICTED = f"{WINDOWS}, c AS (SELECT *, CAST(prob >= 0.3 AS INT) AS pred FROM win)"
RATE_NAMES = ("accuracy", "precision", "recall", "f1")


def rounded_rates(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "tn", "fp", "fn", "tp", *[r6(c).alias(c) for c in RATE_NAMES])


@query(f"WITH {PREDICTED}, k AS (SELECT {CELLS} FROM c) SELECT tn, fp, fn, tp, {RATES} FROM k")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_features(spark, sf_dir)
    return rounded_rates(metrics.evaluated(w, (F.col("prob") >= 0.3).cast("int"), F.col("target")))


@query(f"WITH {PREDICTED}, k AS (SELECT CAST(sample % 3 AS INT) AS part, target AS side, GROUPING(sample % 3, target)::BIGINT AS level, {CELLS} FROM (SELECT * FROM c) GROUP BY ROLLUP (sample % 3, target)) SELECT part, side, level, tn, fp, fn, tp, {RATES} FROM k".replace("CAST(sample % 3 AS INT) AS part", "(sample % 3)::INT AS part"))
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_features(spark, sf_dir).withColumn("part", (F.col("sample") % 3).cast("int")).withColumn("side", F.col("target"))
    return rounded_rates(metrics.rolled_up(w, (F.col("prob") >= 0.3).cast("int"), F.col("target"), ["part", "side"]), "part", "side", "level")


SWEEP = f"""{WINDOWS}, th AS (SELECT CAST(range AS INT) AS rank, 0.05 + range * (0.9 / 99) AS threshold FROM range(100)),
k AS (SELECT rank, threshold, count(*) FILTER (prob < threshold AND target = 0) AS tn, count(*) FILTER (prob >= threshold AND target = 0) AS fp, count(*) FILTER (prob < threshold AND target = 1) AS fn, count(*) FILTER (prob >= threshold AND target = 1) AS tp FROM win, th GROUP BY rank, threshold),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM k), mb AS (SELECT *, CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END AS fb FROM m)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.swept(window_features(spark, sf_dir), "prob", "target", metrics.thresholds())


@query(f"WITH {SWEEP} SELECT rank, tn, fp, fn, tp, {RATES} FROM k")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_rates(_sweep(spark, sf_dir), "rank")


@query(f"WITH {SWEEP} SELECT rank, round(fb, 6) AS score FROM mb ORDER BY round(fb, 12) DESC, rank LIMIT 1")
def fbeta_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_sweep(spark, sf_dir), "fbeta").select("rank", r6("score").alias("score"))


@query(f"WITH {SWEEP} SELECT rank, round(CASE WHEN p >= 0.55 THEN r ELSE p - 1 END, 6) AS score FROM mb ORDER BY CASE WHEN p >= 0.55 THEN r ELSE p - 1 END DESC, rank LIMIT 1")
def precision_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(_sweep(spark, sf_dir), "precision_constrained", min_precision=0.55).select("rank", r6("score").alias("score"))


AUC = f"""{LINES}, {LONG}, rk AS (SELECT feature, target, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rk FROM long),
au AS (SELECT feature, (sum(rk) FILTER (target = 1) - count(*) FILTER (target = 1)::DOUBLE * (count(*) FILTER (target = 1) + 1) / 2) / (count(*) FILTER (target = 1)::DOUBLE * count(*) FILTER (target = 0)) AS auc FROM rk GROUP BY feature)"""


@query(f"WITH {AUC} SELECT feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS separation FROM au")
def auc_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked_auc(lines(spark, sf_dir), FEATURES, "target").select("feature", r6("auc").alias("auc"), r6("separation").alias("separation"))


BRANDS = "parts AS (SELECT p_partkey AS feature, p_brand AS \"group\", p_retailprice AS imp, p_size AS rk FROM part), brands AS (SELECT p_brand AS brand, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY p_brand)"


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))


@query(f"WITH {BRANDS}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM brands) SELECT round(corr(x, y), 6) AS rho FROM r")
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(_brands(spark, sf_dir), "a", "b").select(r6("rho").alias("rho"))


@query(f"WITH {BRANDS}, r AS (SELECT row_number() OVER (ORDER BY a DESC, brand) AS ra, row_number() OVER (ORDER BY b DESC, brand) AS rb FROM brands) SELECT round(count(*) FILTER (ra <= 5 AND rb <= 5) / 5.0, 6) AS overlap, count(*) FILTER (ra <= 5 AND rb > 10) AS n_suspicious FROM r")
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topk_overlap(_brands(spark, sf_dir), "brand", "a", "b", 5).select(r6("overlap").alias("overlap"), "n_suspicious")


FOLD = "fo AS (SELECT sample, CAST((row_number() OVER (ORDER BY sha256('42::' || sample)) - 1) % 5 AS INT) AS fold FROM (SELECT DISTINCT user_id AS sample FROM events))"


@query(f"WITH {WINDOWS}, {FOLD} SELECT fold, count(*) AS n_windows, count(DISTINCT sample) AS n_samples, count(*) FILTER (target = 1) AS n_target1 FROM win JOIN fo USING (sample) GROUP BY fold")
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = folds.round_robin(table(spark, sf_dir, "events").select(F.col("user_id").alias("sample")).distinct(), "sample", 5)
    return window_features(spark, sf_dir).join(users, "sample").groupBy("fold").agg(F.count("*").alias("n_windows"), F.count_distinct("sample").alias("n_samples"), F.count_if(F.col("target") == 1).alias("n_target1"))


@query(f"WITH {PREDICTED}, fo AS (SELECT DISTINCT sample, CAST(CAST(('0x' || substr(sha256('42::' || sample), 1, 8)) AS BIGINT) % 4 AS INT) AS fold FROM win), k AS (SELECT fold, {CELLS} FROM c JOIN fo USING (sample) GROUP BY fold) SELECT fold, tn, fp, fn, tp, {RATES} FROM k")
def group_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = folds.hashed(window_features(spark, sf_dir), "sample", 4)
    return rounded_rates(metrics.evaluated(w, (F.col("prob") >= 0.3).cast("int"), F.col("target"), ["fold"]), "fold")


@query(f"WITH {BRANDS}, p AS (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY imp DESC, feature) AS place FROM parts) SELECT feature, \"group\", imp, CAST(place AS INT) AS place FROM p WHERE place <= CASE WHEN \"group\" = 'Brand#1' THEN 0 WHEN \"group\" = 'Brand#2' THEN 4 ELSE 2 END ORDER BY imp DESC, feature LIMIT 15")
def group_capped_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("group"), F.col("p_retailprice").alias("imp"))
    limits = spark.createDataFrame([("Brand#1", 0), ("Brand#2", 4)], "group string, limit int")
    return ranking.within_limits(parts, [F.col("imp").desc(), F.col("feature").asc()], limits, 15, 2).select("feature", "group", "imp", "place")


STABILITY = """f AS (SELECT l_suppkey % 6 AS fold, l_returnflag || l_linestatus || (l_linenumber % 5) AS feature, avg(l_quantity) AS importance FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rank FROM f),
s AS (SELECT feature, count(*) AS n, avg(importance) AS imp, avg(rank) AS rk FROM r WHERE rank <= 8 GROUP BY feature), st AS (SELECT a.feature, coalesce(n, 0)::BIGINT AS count, coalesce(imp, 0) AS avg_importance, coalesce(rk, 0) AS avg_rank, coalesce(n, 0) / 6 AS freq FROM (SELECT DISTINCT feature FROM f) a LEFT JOIN s USING (feature))"""


def _stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy((F.col("l_suppkey") % 6).alias("fold"), F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 5).cast("string")).alias("feature")).agg(F.avg("l_quantity").alias("importance"))
    return ranking.stability(f, f.select("feature").distinct(), 8)


@query(f"WITH {STABILITY} SELECT feature, count, round(avg_importance, 6) AS avg_importance, round(avg_rank, 6) AS avg_rank, round(freq, 6) AS freq FROM st")
def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stability(spark, sf_dir).select("feature", "count", *[r6(c).alias(c) for c in ("avg_importance", "avg_rank", "freq")])


@query(f"WITH {STABILITY}, x AS (SELECT feature, freq * avg_importance AS a, CASE WHEN feature < 'N' THEN avg_importance ELSE 0 END AS b FROM st), m AS (SELECT max(a) AS ma, max(b) AS mb FROM x) SELECT feature, round(CASE WHEN b > 0 THEN 0.5 * a / ma + 0.5 * b / mb ELSE a / ma END, 6) AS combined_score FROM x, m")
def combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    shap = F.when(F.col("feature") < "N", F.col("avg_importance")).otherwise(F.lit(0.0))
    return ranking.combined(_stability(spark, sf_dir), F.col("freq") * F.col("avg_importance"), shap).select("feature", r6("combined_score").alias("combined_score"))


#: A small ensemble over two features; splits are 32-bit floats.
ENSEMBLE = trees.Ensemble(
    [
        trees.Tree([trees.Split("l_quantity", 25.5, 1, 2, 2), trees.Split("gap", 20.25, 3, 4, 4), trees.Leaf(-0.12), trees.Leaf(0.31), trees.Leaf(0.05)]),
        trees.Tree([trees.Split("gap", 10.1, 1, 2, 1), trees.Leaf(-0.2), trees.Split("l_quantity", 40.0, 3, 4, 3), trees.Leaf(0.17), trees.Leaf(-0.07)]),
        trees.Tree([trees.Leaf(0.03)]),
    ],
    base_score=0.4,
)


@query(f"""WITH {LINES}, m AS (SELECT line, ln(0.4 / 0.6) + CASE WHEN l_quantity < 25.5::FLOAT THEN CASE WHEN gap::FLOAT < 20.25::FLOAT THEN 0.31 ELSE 0.05 END ELSE -0.12 END
 + CASE WHEN gap IS NULL OR gap::FLOAT < 10.1::FLOAT THEN -0.2 WHEN l_quantity::FLOAT < 40.0::FLOAT THEN 0.17 ELSE -0.07 END + 0.03 AS z FROM lines) SELECT line, round(z, 6) AS margin, round(1 / (1 + exp(-z)), 6) AS prob, CAST(1 / (1 + exp(-z)) >= 0.45 AS INT) AS label FROM m""")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = trees.scored(lines(spark, sf_dir), ENSEMBLE)
    return scored.select("line", r6("margin").alias("margin"), r6("prob").alias("prob"), (F.col("prob") >= 0.45).cast("int").alias("label"))


@query(f"""WITH {WINDOWS}, cut AS (SELECT quantile_cont(prob, 0.9) AS cut FROM win WHERE target = 0), h AS (SELECT sample, win, prob, target = 0 AND prob >= 0.35 AS a, target = 0 AND prob >= cut AS b FROM win, cut)
SELECT sample, win AS "window", CASE WHEN a OR b THEN 3.0 ELSE 1.0 END AS weight, CASE WHEN a AND b THEN 'probability_and_top_percentile' WHEN a THEN 'probability' WHEN b THEN 'top_percentile' END AS reason FROM h""")
def hard_negative_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.hard_negatives(staged(window_features(spark, sf_dir), "windows"), "prob", "target", 0.35, 0.1).select("sample", "window", "weight", "reason")


@query("SELECT l_suppkey AS sample, avg(l_quantity) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, count(*) AS n FROM lineitem GROUP BY l_suppkey".replace("avg(l_quantity)", "round(avg(l_quantity), 6)"))
def per_sample_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(r6(F.avg("l_quantity")).alias("l_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("l_extendedprice"), F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


DRAWN = "row_number() OVER (PARTITION BY target ORDER BY substr(sha256('42::' || sample || '::' || win), 1, 13))"


#: A naturally unbalanced target: of a window's level against its gate.
LEVEL = "CASE WHEN dc > 3.0 THEN 1 ELSE 0 END"


@query(f"""WITH {WINDOWS}, s AS (SELECT sample, win, {LEVEL} AS target FROM win), n AS (SELECT count(*) FILTER (target = 0) AS k, count(*) FILTER (target = 1) AS p FROM s), r AS (SELECT sample, win, target, {DRAWN} AS n FROM s)
SELECT sample, win AS "window", target FROM r, n WHERE target = 0 OR k = 0 OR r.n <= k""")
def balanced_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = staged(window_features(spark, sf_dir).select("sample", "window", (F.col("dc") > 3.0).cast("int").alias("target")), "windows")
    return sampling.balanced(w, "target", ["sample", "window"]).select("sample", "window", "target")


@query(f"WITH {WINDOWS}, r AS (SELECT sample, win, row_number() OVER (ORDER BY substr(sha256('42::' || sample || '::' || win), 1, 13)) AS n FROM win) SELECT sample, win AS \"window\" FROM r WHERE n <= 100")
def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a hundred points, as a plot takes it."""
    return sampling.first(staged(window_features(spark, sf_dir), "windows"), ["sample", "window"], 100).select("sample", "window")


@query(f"WITH {LINES} SELECT 'l_quantity' AS feature, target, q AS share, round(quantile_cont(l_quantity, q), 6) AS value FROM lines, (SELECT unnest([0.05, 0.5, 0.95]) AS q) GROUP BY target, q".replace("quantile_cont(l_quantity, q)", "CASE q WHEN 0.05 THEN quantile_cont(l_quantity, 0.05) WHEN 0.5 THEN quantile_cont(l_quantity, 0.5) ELSE quantile_cont(l_quantity, 0.95) END").replace("q AS share", "q::DOUBLE AS share"))
def feature_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distributions(lines(spark, sf_dir), ["l_quantity"], "target", [0.05, 0.5, 0.95]).withColumn("value", r6("value"))


@query("""WITH m AS (SELECT l_suppkey AS sample, avg(l_quantity) AS a, avg(l_tax) AS b FROM lineitem GROUP BY l_suppkey), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM m)
SELECT sample, round(least(greatest((a - ma) / sa, -3), 3), 4) AS a, round(least(greatest((b - mb) / sb, -3), 3), 4) AS b FROM m, s""")
def per_sample_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.avg("l_quantity").alias("a"), F.avg("l_tax").alias("b"))
    return stats.standardised(m, ["a", "b"], 3.0).select("sample", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pca_scores(lines(spark, sf_dir).select("line", "l_quantity", "net", "l_tax"), ["l_quantity", "net", "l_tax"]).select("line", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


@query()
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pca_loadings(lines(spark, sf_dir), [f for f in FEATURES if f != "gap"])


@query("""WITH g AS (SELECT range AS i FROM range(60)) SELECT i AS index, (i // 20) % 3 AS a, [0.1, 0.2, 0.3, 0.5][(i // 5) % 4 + 1] AS b, (i % 5) * 10 AS c FROM g""".replace("(i // 20) % 3 AS a", "((i // 20) % 3)::INT AS a").replace("(i % 5) * 10 AS c", "((i % 5) * 10)::INT AS c"))
def grid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelark.operators import grids

    axes = {"a": [0, 1, 2], "b": [0.1, 0.2, 0.3, 0.5], "c": [0, 10, 20, 30, 40]}
    return spark.range(60).select(F.col("id").alias("index"), *[c.alias(k) for k, c in grids.decoded(F.col("id"), axes).items()])


@query()
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains a small ensemble on all rows and evaluates it on them."""
    rows = lines(spark, sf_dir)
    model = trees.fit(rows, ["l_quantity", "net", "gap"], "target", trees.Boosting(rounds=3, depth=2, bins=16))
    return metrics.evaluated(trees.scored(rows, model), (F.col("prob") >= 0.45).cast("int"), F.col("target"))


@query()
def shapley_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelark.operators import selection

    return selection.shapley(lines(spark, sf_dir), trees.fit(lines(spark, sf_dir), ["l_quantity", "net"], "target", trees.Boosting(rounds=2, depth=2, bins=8)), ["l_quantity", "net"])
