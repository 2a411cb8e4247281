"""Queries over signals: splits, windows, gates, array features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.functions import arrays as A
from tidelark.operators import gates, split, windows
from tidelark.plans.registry import query
from tidelark.plans.roles import DC, EMB, RATIO, SIG, SIZE, STRIDE, WINDOWS, WROWS, embedded, signal, table, window_features
from tidelark.session import staged


def r6(c) -> object:
    return F.round(c, 6)


USERS = "users AS (SELECT DISTINCT user_id AS sample FROM events)"
SCORED = USERS + ", scored AS (SELECT sample, CAST(('0x' || substr(sha256('42::events.h5::' || sample), 1, 13)) AS BIGINT) / 4503599627370496.0 AS score FROM users), parts AS (SELECT *, CASE WHEN score < 0.2 THEN 'test' WHEN score < 0.4 THEN 'valid' ELSE 'train' END AS split FROM scored)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample")).distinct()
    return users.withColumn("key", split.stable_key(F.lit("/data/events.h5"), F.col("sample").cast("string")))


@query(f"WITH {SCORED} SELECT sample, score, split FROM parts")
def split_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = split.fraction_sha256(F.col("key"))
    return _keys(spark, sf_dir).select("sample", score.alias("score"), split.split_name(score).alias("split"))


@query()
def split_hash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keys(spark, sf_dir).withColumn("score", split.fraction_blake2b(spark, F.col("key")))
    return rows.select("sample", "score", split.split_name(F.col("score")).alias("split"))


@query(f"WITH {SCORED} SELECT split, count(*) AS n, count(*) FILTER (sample % 2 = 1) AS n_target1, count(*) FILTER (sample % 2 = 0) AS n_target0 FROM parts GROUP BY split")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_summary(split_hash_sha256(spark, sf_dir).withColumn("target", F.col("sample") % 2))


@query("""WITH names AS (SELECT o_orderkey, o_orderpriority || '_w' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_' || (o_orderkey % 2) END AS name FROM orders)
SELECT o_orderkey, CASE WHEN ok THEN regexp_extract(name, '^(.+)_w(\\d+)_(-?\\d+)$', 1) END AS base, CASE WHEN ok THEN CAST(regexp_extract(name, '^(.+)_w(\\d+)_(-?\\d+)$', 2) AS BIGINT) END AS window_index,
  CASE WHEN ok THEN CAST(regexp_extract(name, '^(.+)_w(\\d+)_(-?\\d+)$', 3) AS BIGINT) END AS label FROM (SELECT *, regexp_matches(name, '^(.+)_w(\\d+)_(-?\\d+)$') AS ok FROM names)""")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat("o_orderpriority", F.lit("_w"), key.cast("string"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("_"), (key % 2).cast("string"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in split.parsed_name(name).items()])


@query("""WITH w AS (SELECT user_id AS sample, event_id AS window_index, CASE WHEN user_id % 5 = 0 THEN event_id % 2 ELSE user_id % 2 END AS label FROM events),
g AS (SELECT sample, min(label) AS target, max(label) AS other, list(window_index ORDER BY window_index)[4:] AS a FROM w GROUP BY sample)
SELECT sample, target, len(a) AS n_windows, a[1] AS first_index, list_sum(a)::BIGINT AS sum_index FROM g WHERE target = other AND len(a) > 0""")
def nested_scan_drop3(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("user_id") % 5 == 0, F.col("event_id") % 2).otherwise(F.col("user_id") % 2)
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("window_index"), label.alias("label"))
    a = F.col("window_indices")
    return split.nested_samples(w).select("sample", "target", F.size(a).cast("long").alias("n_windows"), F.get(a, F.lit(0)).alias("first_index"), F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_index"))


@query(f"WITH {SIG}, {WROWS} SELECT sample, win AS \"window\", win * {STRIDE} AS start, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM wrows GROUP BY sample, win HAVING count(*) = {SIZE}")
def sliding_windows_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.windowed(signal(spark, sf_dir), "idx", SIZE, STRIDE).groupBy("sample", "window")
    out = rows.agg(r6(F.avg("v")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), windows.whole(SIZE).alias("_whole")).where("_whole")
    return out.select("sample", F.col("window").cast("long").alias("window"), (F.col("window") * STRIDE).cast("long").alias("start"), "mean", "least", "most")


@query(f"""WITH {EMB}, w AS (SELECT sample, v, unnest(generate_series(greatest(CAST(ceil((idx - 15) / 8.0) AS BIGINT), 0), idx // 8)) AS win FROM emb)
SELECT sample, win AS "window", round(sum(v), 6) AS total, max(v) AS most FROM w GROUP BY sample, win HAVING count(*) = 16""")
def sliding_windows_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = embedded(spark, sf_dir).select("sample", F.posexplode(A.sliding(F.col("a"), 16, 8)).alias("window", "w"))
    return cut.select("sample", F.col("window").cast("long").alias("window"), r6(A.total(F.col("w"))).alias("total"), F.array_max("w").alias("most"))


@query(f"""WITH {EMB}, s AS (SELECT sample, idx // 16 AS sub, sqrt(avg(v * v)) AS rms, sum(abs(d)) AS wl FROM (SELECT *, v - lag(v) OVER (PARTITION BY sample, idx // 16 ORDER BY idx) AS d FROM emb) GROUP BY sample, idx // 16)
SELECT sample, round(stddev_pop(rms) / (avg(rms) + 1e-12), 6) AS rms_cv, round(quantile_cont(rms, 0.75) - quantile_cont(rms, 0.25), 6) AS rms_iqr, round(stddev_pop(wl) / (avg(wl) + 1e-12), 6) AS wl_cv FROM s GROUP BY sample""")
def tumbling_subwindows(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = A.sliding(F.col("a"), 16, 16)
    e = embedded(spark, sf_dir).select("sample", F.transform(subs, A.rms).alias("rms"), F.transform(subs, lambda w: A.total(F.transform(A.diff(w), F.abs))).alias("wl"))
    cv = lambda c: A.safe_div(A.std(F.col(c)), A.mean(F.col(c)))
    return e.select("sample", r6(cv("rms")).alias("rms_cv"), r6(A.iqr(F.col("rms"))).alias("rms_iqr"), r6(cv("wl")).alias("wl_cv"))


@query(f"""WITH {EMB}, w AS (SELECT sample, s AS start, round(avg(v), 6) AS fast_mean, count(*) AS n FROM emb JOIN (SELECT unnest([0, 3, 6, 9, 12, 15]) AS s) ON idx >= s * 4 AND idx < s * 4 + 20 GROUP BY sample, s)
SELECT sample, start, fast_mean, n FROM w""")
def align_multirate(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = embedded(spark, sf_dir).select("sample", "a", F.explode(F.array(*[F.lit(s) for s in (0, 3, 6, 9, 12, 15, 18)])).alias("start"))
    cut = starts.withColumn("fast", windows.aligned(F.col("a"), F.col("start"), 4, F.lit(5))).where("fast is not null")
    return cut.select("sample", "start", r6(A.mean(F.col("fast"))).alias("fast_mean"), F.size("fast").cast("long").alias("n"))


@query(f"WITH {WINDOWS} SELECT sample, win AS \"window\", start, round(dc, 6) AS dc, round(ac, 6) AS ac, round(ac_dc_ratio, 6) AS ac_dc_ratio FROM win")
def gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(spark, sf_dir).select("sample", "window", "start", *[r6(c).alias(c) for c in ("dc", "ac", "ac_dc_ratio")])


@query(f"""WITH {EMB}, p AS (SELECT *, lag(v) OVER (PARTITION BY sample ORDER BY idx) AS u FROM emb)
SELECT sample, round(min((u + v) / 2), 6) AS dc, round(quantile_cont(abs(v - u), 0.5), 6) AS ac FROM p GROUP BY sample""")
def gate_features_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gates.gate_features_array(F.col("a"))
    return embedded(spark, sf_dir).select("sample", r6(g["dc"]).alias("dc"), r6(g["ac"]).alias("ac"))


@query(f"WITH {WINDOWS} SELECT sample, win AS \"window\", dc > {DC} AND ac_dc_ratio < {RATIO} AS passed FROM win")
def gate_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_features(spark, sf_dir).select("sample", "window", gates.passes(DC, RATIO).alias("passed"))


@query(f"WITH {WINDOWS} SELECT sample, bool_or(dc > {DC} AND ac_dc_ratio < {RATIO}) AS passed, count(*) AS n_windows, count(*) FILTER (dc > {DC} AND ac_dc_ratio < {RATIO}) AS n_passed FROM win GROUP BY sample")
def gate_sample_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.any_window(window_features(spark, sf_dir), "sample", gates.passes(DC, RATIO))


@query(f"""WITH {WINDOWS} SELECT w.sample, w.win AS "window" FROM win w SEMI JOIN (SELECT sample FROM win WHERE dc > {DC} AND ac_dc_ratio < {RATIO}) p USING (sample)""")
def gate_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_features(spark, sf_dir)
    return w.join(w.where(gates.passes(DC, RATIO)).select("sample"), "sample", "left_semi").select("sample", "window")


@query(f"""WITH {SIG}, f AS (SELECT sample, idx, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM sig),
t AS (SELECT *, count(*) OVER w AS n, sum(ok) OVER w AS up FROM f WINDOW w AS (PARTITION BY sample ORDER BY idx ROWS 2 PRECEDING)),
u AS (SELECT *, CASE WHEN n = 3 AND up = 3 THEN 1 WHEN n = 3 AND up = 0 THEN 0 END AS turn FROM t)
SELECT sample, idx, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY sample ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS open FROM u""")
def gate_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return gates.consecutive(s, "sample", ["idx"], F.col("event_type") != "error").select("sample", F.col("idx").cast("long").alias("idx"), "open")


def _eval_sql(pairs: str) -> str:
    return f"""{WINDOWS}, pairs AS ({pairs}), s AS (SELECT d, r, sample, target, count(*) AS n, count(*) FILTER (dc > d AND ac_dc_ratio < r) AS ok FROM win, pairs GROUP BY d, r, sample, target),
ev AS (SELECT d AS dc_threshold, r AS ac_dc_threshold, coalesce(sum(ok) FILTER (target = 1) / sum(n) FILTER (target = 1), 0) AS window_target1_pass_rate, coalesce(sum(ok) FILTER (target = 0) / sum(n) FILTER (target = 0), 0) AS window_target0_pass_rate,
  count(*) FILTER (target = 1 AND ok > 0) / count(*) FILTER (target = 1) AS sample_target1_pass_rate, count(*) FILTER (target = 0 AND ok > 0) / count(*) FILTER (target = 0) AS sample_target0_pass_rate, sum(n)::BIGINT AS num_windows, count(*) AS num_samples FROM s GROUP BY d, r)"""


EV = ["window_target1_pass_rate", "window_target0_pass_rate", "sample_target1_pass_rate", "sample_target0_pass_rate"]
EV_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in EV)
FIXED = "SELECT * FROM (VALUES (0.0, 1.0), (3.0, 4.0), (6.0, 2.0), (1e9, 1.0)) v(d, r)"
QUANTS = "SELECT d, r FROM (SELECT unnest(list_distinct(quantile_cont(dc, [0.25, 0.5, 0.75]))) AS d FROM win), (SELECT unnest(list_distinct(quantile_cont(ac_dc_ratio, [0.25, 0.5, 0.75]))) AS r FROM win)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(r6("dc_threshold").alias("dc_threshold"), r6("ac_dc_threshold").alias("ac_dc_threshold"), *[r6(c).alias(c) for c in EV], "num_windows", "num_samples")


@query(f"WITH {_eval_sql(FIXED)} SELECT round(dc_threshold::DOUBLE, 6) AS dc_threshold, round(ac_dc_threshold::DOUBLE, 6) AS ac_dc_threshold, {EV_SQL}, num_windows, num_samples FROM ev")
def gate_threshold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gates.evaluate(window_features(spark, sf_dir), [(0.0, 1.0), (3.0, 4.0), (6.0, 2.0), (1e9, 1.0)]))


@query(f"WITH {_eval_sql(QUANTS)} SELECT round(dc_threshold, 6) AS dc_threshold, round(ac_dc_threshold, 6) AS ac_dc_threshold, {EV_SQL}, num_windows, num_samples FROM ev")
def gate_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return _rounded(gates.evaluate(w, gates.grid(w, 3, 3)))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, since a search reads them again and again."""
    return staged(window_features(spark, sf_dir).select("sample", "target", "dc", "ac_dc_ratio"), "windows")


def _best_sql(name: str, levels: str, ratios: str) -> str:
    """CTEs for the best of the pairs of two lists that lets every sample of target 1 pass."""
    return f"""{name}_pairs AS (SELECT d, r FROM (SELECT DISTINCT unnest({levels}) AS d), (SELECT DISTINCT unnest({ratios}) AS r)),
{name}_s AS (SELECT d, r, sample, target, count(*) AS n, count(*) FILTER (dc > d AND ac_dc_ratio < r) AS ok FROM win, {name}_pairs GROUP BY d, r, sample, target),
{name}_ev AS (SELECT d, r, sum(ok) FILTER (target = 1) / sum(n) FILTER (target = 1) AS w1, sum(ok) FILTER (target = 0) / sum(n) FILTER (target = 0) AS w0, count(*) FILTER (target = 1 AND ok > 0) / count(*) FILTER (target = 1) AS s1, count(*) FILTER (target = 0 AND ok > 0) / count(*) FILTER (target = 0) AS s0 FROM {name}_s GROUP BY d, r),
{name} AS (SELECT * FROM {name}_ev WHERE s1 + 1e-12 >= 1 ORDER BY s1 DESC, round(s0, 12), round(w0, 12), d, r DESC LIMIT 1)"""


COARSE, FINE = 50, 30
GRID_SHARES = f"[x / {COARSE - 1} FOR x IN range({COARSE})]"
SEARCH_SQL = f"""WITH {WINDOWS}, e AS (SELECT min(dc) AS a, max(dc) AS b, greatest(max(dc) - min(dc), 1.0) AS w, min(ac_dc_ratio) AS ra, max(ac_dc_ratio) AS rb, greatest(max(ac_dc_ratio) - min(ac_dc_ratio), 1e-6) AS rw FROM win),
g AS (SELECT list_concat((SELECT quantile_cont(dc, {GRID_SHARES}) FROM win), [a - 0.1 * w + x * ((b - (a - 0.1 * w)) / {COARSE - 1}) FOR x IN range({COARSE})]) AS levels,
  list_concat((SELECT quantile_cont(ac_dc_ratio, {GRID_SHARES}) FROM win), [greatest(0.0, ra - 0.05 * rw) + x * ((rb + 0.2 * rw - greatest(0.0, ra - 0.05 * rw)) / {COARSE - 1}) FOR x IN range({COARSE})], [0.01 + x * (1.49 / 99) FOR x IN range(100)]) AS ratios FROM e),
{_best_sql("coarse", "(SELECT levels FROM g)", "(SELECT ratios FROM g)")},
{_best_sql("fine", f"(SELECT [d * 0.8 + x * ((d * 1.2 - d * 0.8) / {FINE - 1}) FOR x IN range({FINE})] FROM coarse)", f"(SELECT [r * 0.8 + x * ((r * 1.2 - r * 0.8) / {FINE - 1}) FOR x IN range({FINE})] FROM coarse)")},
two AS (SELECT 'coarse' AS stage, * FROM coarse UNION ALL SELECT 'fine', f.* FROM fine f, coarse c WHERE (-f.s1, round(f.s0, 12), round(f.w0, 12), f.d, -f.r) < (-c.s1, round(c.s0, 12), round(c.w0, 12), c.d, -c.r))
SELECT stage, round(d, 6) AS dc_threshold, round(r, 6) AS ac_dc_threshold, round(w1, 6) AS window_target1_pass_rate, round(w0, 6) AS window_target0_pass_rate, round(s1, 6) AS sample_target1_pass_rate, round(s0, 6) AS sample_target0_pass_rate FROM two"""


@query(SEARCH_SQL)
def gate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse grid of quantiles and even steps, then a fine one around its best."""
    found = gates.searched(_windows(spark, sf_dir), 1.0, COARSE, FINE)
    names = ["dc_threshold", "ac_dc_threshold", *gates.RATES]
    rows = spark.createDataFrame([(x["stage"], *(x[c] for c in names)) for x in found], "stage string, " + ", ".join(f"{c} double" for c in names))
    return rows.select("stage", *[r6(c).alias(c) for c in names])


@query(f"""WITH {_eval_sql(QUANTS)} SELECT round(dc_threshold, 6) AS dc_threshold, round(ac_dc_threshold, 6) AS ac_dc_threshold, {EV_SQL}, num_windows, num_samples FROM ev
ORDER BY ev.sample_target1_pass_rate DESC, ev.sample_target0_pass_rate, ev.window_target0_pass_rate, ev.dc_threshold, ev.ac_dc_threshold DESC LIMIT 1""")
def gate_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    return _rounded(gates.best(gates.evaluate(w, gates.grid(w, 3, 3))))


@query(f"""WITH {EMB}, m AS (SELECT sample, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM emb GROUP BY sample)
SELECT sample, round(any_value(med), 6) AS median, round(quantile_cont(abs(v - med), 0.5), 6) AS mad, round(any_value(iqr), 6) AS iqr FROM emb JOIN m USING (sample) GROUP BY sample""")
def robust_mad_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return embedded(spark, sf_dir).select("sample", r6(A.median(a)).alias("median"), r6(A.mad(a)).alias("mad"), r6(A.iqr(a)).alias("iqr"))


HALVES = "h AS (SELECT x.sample, x.v AS p, y.v AS q FROM emb x JOIN emb y ON x.sample = y.sample AND y.idx = x.idx + 32 AND x.idx < 32)"


@query(f"""WITH {EMB}, {HALVES}, b AS (SELECT sample, quantile_cont(p, 0.05) AS pl, quantile_cont(p, 0.95) AS ph, quantile_cont(q, 0.05) AS ql, quantile_cont(q, 0.95) AS qh FROM h GROUP BY sample)
SELECT sample, round(corr(p, q), 6) AS plain, round(corr(least(greatest(p, pl), ph), least(greatest(q, ql), qh)), 6) AS winsorised FROM h JOIN b USING (sample) GROUP BY sample""")
def winsor_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.slice("a", 1, 32), F.slice("a", 33, 32)
    return embedded(spark, sf_dir).select("sample", r6(A.safe_corr(x, y)).alias("plain"), r6(A.safe_corr(x, y, True)).alias("winsorised"))


@query(f"WITH {EMB} SELECT sample, idx, round(sum(v) OVER (PARTITION BY sample ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS smooth FROM emb")
def moving_average_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("sample", F.posexplode(A.moving_average(F.col("a"), 3)).alias("idx", "x"))
    return e.select("sample", F.col("idx").cast("long").alias("idx"), r6("x").alias("smooth"))


DIFFS = "d AS (SELECT *, v - lag(v) OVER w AS step, lag(v) OVER w AS u, lead(v) OVER w AS t FROM emb WINDOW w AS (PARTITION BY sample ORDER BY idx)), dm AS (SELECT sample, quantile_cont(step, 0.5) AS med FROM d GROUP BY sample), lim AS (SELECT sample, quantile_cont(abs(step - med), 0.5) AS mad FROM d JOIN dm USING (sample) GROUP BY sample)"


@query(f"""WITH {EMB}, {DIFFS} SELECT sample, idx, round(CASE WHEN abs(v - u) > greatest(1.5 * mad, 1e-12) AND abs(t - v) > greatest(1.5 * mad, 1e-12) THEN (u + t) / 2 ELSE v END, 6) AS mended FROM d JOIN lim USING (sample)""")
def burr_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("sample", F.posexplode(A.remove_bursts(F.col("a"), 1.5)).alias("idx", "x"))
    return e.select("sample", F.col("idx").cast("long").alias("idx"), r6("x").alias("mended"))


@query(f"""WITH RECURSIVE {EMB}, {DIFFS}, s AS (SELECT sample, idx, v FROM emb WHERE idx = 0
UNION ALL SELECT e.sample, e.idx, CASE WHEN abs(e.v - s.v) > greatest(1.5 * l.mad, 1e-12) THEN s.v ELSE e.v END FROM s JOIN emb e ON e.sample = s.sample AND e.idx = s.idx + 1 JOIN lim l ON l.sample = s.sample)
SELECT sample, idx, round(v, 6) AS kept FROM s""")
def step_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("sample", F.posexplode(A.remove_steps(F.col("a"), 1.5)).alias("idx", "x"))
    return e.select("sample", F.col("idx").cast("long").alias("idx"), r6("x").alias("kept"))


STEPS = "st AS (SELECT *, v - lag(v) OVER w AS d1, lag(v) OVER w AS u FROM emb WINDOW w AS (PARTITION BY sample ORDER BY idx)), st2 AS (SELECT *, d1 - lag(d1) OVER w AS d2, lag(d1) OVER w AS e1 FROM st WINDOW w AS (PARTITION BY sample ORDER BY idx))"


@query(f"""WITH {EMB}, {STEPS} SELECT sample, round(avg(abs(v)), 6) AS mav, round(sqrt(avg(v * v)), 6) AS rms, round(sum(abs(d1)), 6) AS wl, count(*) FILTER (v * u < 0)::DOUBLE AS zc, count(*) FILTER (d1 * e1 < 0)::DOUBLE AS ssc,
 count(*) FILTER (abs(d1) > 0.1)::DOUBLE AS wamp, round(max(v) - min(v), 6) AS p2p, round(stddev_pop(abs(v)) / (avg(abs(v)) + 1e-12), 6) AS amp_cv FROM st2 GROUP BY sample""")
def time_domain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    size = F.transform(a, F.abs)
    d = A.diff(a)
    return embedded(spark, sf_dir).select(
        "sample", r6(A.mean(size)).alias("mav"), r6(A.rms(a)).alias("rms"), r6(A.total(F.transform(d, F.abs))).alias("wl"), A.zero_crossings(a).alias("zc"), A.slope_changes(a).alias("ssc"),
        A.count_true(F.transform(d, lambda x: F.abs(x) > 0.1)).alias("wamp"), r6(F.array_max(a) - F.array_min(a)).alias("p2p"), r6(A.safe_div(A.std(size), A.mean(size))).alias("amp_cv"),
    )


@query(f"""WITH {EMB}, {STEPS}, m AS (SELECT sample, max(abs(v)) AS top FROM emb GROUP BY sample)
SELECT sample, round(count(*) FILTER (abs(v) >= 0.9 * top) / count(*), 6) AS sat_frac, round(count(*) FILTER (abs(d1) > 0.2) / count(d1), 6) AS clip_rate, round(count(*) FILTER (abs(d1) < 0.01) / count(d1), 6) AS flatline_frac FROM st2 JOIN m USING (sample) GROUP BY sample""")
def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("sample", "a", F.array_max(F.transform("a", F.abs)).alias("top"), A.diff(F.col("a")).alias("d"))
    share = lambda c, f: r6(A.count_true(F.transform(c, f)) / F.size(c))
    return e.select("sample", share("a", lambda x: F.abs(x) >= F.col("top") * 0.9).alias("sat_frac"), share("d", lambda x: F.abs(x) > 0.2).alias("clip_rate"), share("d", lambda x: F.abs(x) < 0.01).alias("flatline_frac"))


@query(f"""WITH {EMB}, {STEPS} SELECT sample, round(avg(d1), 6) AS d1_mean, round(stddev_pop(d1), 6) AS d1_std, round(max(d1), 6) AS d1_max, round(min(d1), 6) AS d1_min, count(*) FILTER (d1 * e1 < 0)::DOUBLE AS d1_zc,
 round(avg(d2), 6) AS d2_mean, round(stddev_pop(d2), 6) AS d2_std FROM st2 GROUP BY sample""")
def derivative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("sample", A.diff(F.col("a")).alias("d1"), A.diff(A.diff(F.col("a"))).alias("d2"))
    d1, d2 = F.col("d1"), F.col("d2")
    return e.select("sample", r6(A.mean(d1)).alias("d1_mean"), r6(A.std(d1)).alias("d1_std"), r6(F.array_max(d1)).alias("d1_max"), r6(F.array_min(d1)).alias("d1_min"), A.zero_crossings(d1).alias("d1_zc"), r6(A.mean(d2)).alias("d2_mean"), r6(A.std(d2)).alias("d2_std"))


@query(f"""WITH {EMB}, {STEPS}, v AS (SELECT sample, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM st2 GROUP BY sample)
SELECT sample, round(v0, 6) AS activity, round(sqrt(v1 / (v0 + 1e-12)), 6) AS mobility, round(sqrt(v2 / (v1 + 1e-12)) / (sqrt(v1 / (v0 + 1e-12)) + 1e-12), 6) AS complexity FROM v""")
def hjorth(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity, mobility, complexity = A.hjorth(F.col("a"))
    return embedded(spark, sf_dir).select("sample", r6(activity).alias("activity"), r6(mobility).alias("mobility"), r6(complexity).alias("complexity"))


@query(f"""WITH {EMB}, m AS (SELECT sample, avg(v) AS mu FROM emb GROUP BY sample), c AS (SELECT sample, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM emb JOIN m USING (sample) GROUP BY sample)
SELECT sample, round(sqrt(m2), 6) AS std, round(m3 / (sqrt(m2) ** 3 + 1e-12), 6) AS skewness, round(m4 / (m2 ** 2 + 1e-12), 6) AS kurtosis FROM c""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    return embedded(spark, sf_dir).select("sample", r6(A.std(a)).alias("std"), r6(A.skewness(a)).alias("skewness"), r6(A.kurtosis(a)).alias("kurtosis"))


@query(f"WITH {EMB} SELECT sample, round(regr_slope(v, idx), 8) AS slope FROM emb GROUP BY sample")
def slope_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).select("sample", F.round(A.slope(F.col("a")), 8).alias("slope"))


@query(f"""WITH {SIG}, p AS (SELECT *, lag(v) OVER w AS u, lead(v) OVER w AS t FROM sig WINDOW w AS (PARTITION BY sample ORDER BY idx)), k AS (SELECT sample, idx, idx - lag(idx) OVER (PARTITION BY sample ORDER BY idx) AS rr FROM p WHERE v > u AND v > t),
d AS (SELECT *, rr - lag(rr) OVER (PARTITION BY sample ORDER BY idx) AS dr FROM k)
SELECT sample, count(*) AS peaks, round(sqrt(avg(dr * dr)), 6) AS rmssd, round(stddev_pop(rr) / (avg(rr) + 1e-12), 6) AS rr_cv, round(count(*) FILTER (abs(dr) > 1) / count(dr), 6) AS pnn FROM d GROUP BY sample""")
def hrv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("sample").orderBy("idx")
    peaks = signal(spark, sf_dir).withColumn("u", F.lag("v").over(w)).withColumn("t", F.lead("v").over(w)).where("v > u and v > t")
    rr = peaks.withColumn("rr", (F.col("idx") - F.lag("idx").over(w)).cast("double")).withColumn("dr", F.col("rr") - F.lag("rr").over(w))
    return rr.groupBy("sample").agg(
        F.count("*").alias("peaks"), r6(F.sqrt(F.avg(F.col("dr") * F.col("dr")))).alias("rmssd"), r6(F.stddev_pop("rr") / (F.avg("rr") + 1e-12)).alias("rr_cv"), r6(F.count_if(F.abs("dr") > 1) / F.count("dr")).alias("pnn")
    )


CH = "ch AS (SELECT sample, idx % 21 AS t, idx // 21 AS c, v FROM emb WHERE idx < 63), wide AS (SELECT sample, t, max(v) FILTER (c = 0) AS x, max(v) FILTER (c = 1) AS y, max(v) FILTER (c = 2) AS z FROM ch GROUP BY sample, t)"


@query(f"""WITH {EMB}, {CH}, f AS (SELECT sample, abs(x - (x + y + z) / 3) / (abs((x + y + z) / 3) + 1.0) AS imb, greatest(x, y, z) - least(x, y, z) AS rng, sqrt(x * x + y * y + z * z + 1e-12) AS mag FROM wide)
SELECT sample, round(avg(imb), 6) AS imbalance_mean, round(quantile_cont(imb, 0.9), 6) AS imbalance_p90, round(avg(rng), 6) AS range_mean, round(quantile_cont(rng, 0.9), 6) AS range_p90, round(avg(mag), 6) AS vmag_mean, round(quantile_cont(mag, 0.75) - quantile_cont(mag, 0.25), 6) AS vmag_iqr FROM f GROUP BY sample""")
def channel_spatial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(F.get("a", i).alias("x"), F.get("a", i + 21).alias("y"), F.get("a", i + 42).alias("z")))
    e = embedded(spark, sf_dir).select("sample", points.alias("p"))
    mean = lambda q: (q["x"] + q["y"] + q["z"]) / 3
    e = e.select(
        "sample", F.transform("p", lambda q: F.abs(q["x"] - mean(q)) / (F.abs(mean(q)) + 1.0)).alias("imb"), F.transform("p", lambda q: F.greatest(q["x"], q["y"], q["z"]) - F.least(q["x"], q["y"], q["z"])).alias("rng"),
        F.transform("p", lambda q: F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + A.EPS)).alias("mag"),
    )
    imb, rng, mag = F.col("imb"), F.col("rng"), F.col("mag")
    return e.select("sample", r6(A.mean(imb)).alias("imbalance_mean"), r6(A.quantile(imb, 0.9)).alias("imbalance_p90"), r6(A.mean(rng)).alias("range_mean"), r6(A.quantile(rng, 0.9)).alias("range_p90"), r6(A.mean(mag)).alias("vmag_mean"), r6(A.iqr(mag)).alias("vmag_iqr"))


@query(f"""WITH {EMB}, {HALVES}, f AS (SELECT sample, sqrt(avg(p * p)) AS ra, sqrt(avg(q * q)) AS rb, avg(abs(p)) AS ma, avg(abs(q)) AS mb, corr(p, q) AS c FROM h GROUP BY sample)
SELECT sample, round(least(greatest(ra / (rb + 1e-12), 0), 1000), 6) AS rms_ratio, round(abs(ma - mb) / (ma + mb + 1e-12), 6) AS mav_imbalance, round(abs(c), 6) AS cross_corr FROM f""")
def channel_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.slice("a", 1, 32), F.slice("a", 33, 32)
    ma, mb = A.mean(F.transform(x, F.abs)), A.mean(F.transform(y, F.abs))
    ratio = F.least(F.greatest(A.safe_div(A.rms(x), A.rms(y)), A.num(0)), A.num(1000))
    return embedded(spark, sf_dir).select("sample", r6(ratio).alias("rms_ratio"), r6(A.safe_div(F.abs(ma - mb), ma + mb)).alias("mav_imbalance"), r6(F.abs(A.safe_corr(x, y))).alias("cross_corr"))


@query(f"""WITH {EMB}, {HALVES}, f AS (SELECT sample, sqrt(avg(p * p)) AS a, sqrt(avg(q * q)) AS b FROM h GROUP BY sample)
SELECT sample, round(least(a, b), 6) AS rms_min, round(greatest(a, b), 6) AS rms_max, round(abs(a - b), 6) AS rms_range, round((abs(a - b) / 2) / (abs((a + b) / 2) + 1e-12), 6) AS rms_cv FROM f""")
def consensus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embedded(spark, sf_dir).select("sample", A.rms(F.slice("a", 1, 32)).alias("p"), A.rms(F.slice("a", 33, 32)).alias("q"))
    p, q = F.col("p"), F.col("q")
    return e.select("sample", r6(F.least(p, q)).alias("rms_min"), r6(F.greatest(p, q)).alias("rms_max"), r6(F.abs(p - q)).alias("rms_range"), r6(A.safe_div(F.abs(p - q) / 2, F.abs((p + q) / 2))).alias("rms_cv"))


@query(f"""WITH {EMB}, r AS (SELECT sample, 0.2 * stddev_pop(v) AS r FROM emb GROUP BY sample), t AS (SELECT sample, idx, v AS a, lead(v) OVER w AS b, lead(v, 2) OVER w AS c FROM emb WINDOW w AS (PARTITION BY sample ORDER BY idx)),
p AS (SELECT x.sample, count(*) FILTER (abs(x.a - y.a) <= r AND abs(x.b - y.b) <= r) AS m2, count(*) FILTER (x.c IS NOT NULL AND y.c IS NOT NULL AND abs(x.a - y.a) <= r AND abs(x.b - y.b) <= r AND abs(x.c - y.c) <= r) AS m3
  FROM t x JOIN t y ON x.sample = y.sample AND x.idx < y.idx AND x.b IS NOT NULL AND y.b IS NOT NULL JOIN r ON r.sample = x.sample GROUP BY x.sample)
SELECT sample, m2, m3, round(CASE WHEN m2 > 0 AND m3 > 0 THEN -ln(m3 / m2) ELSE 0 END, 6) AS sampen FROM p""")
def sample_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template pairs within an array: bounded by its length, and never joined across rows."""
    e = embedded(spark, sf_dir).select("sample", "a", (A.std(F.col("a")) * 0.2).alias("r"))
    a, r = F.col("a"), F.col("r")
    near = lambda i, j, k: F.abs(F.get(a, i + k) - F.get(a, j + k)) <= r

    def pairs(m: int):
        last = F.size(a) - m
        rows = F.transform(F.sequence(F.lit(0), last - 1), lambda i: A.count_true(F.transform(F.sequence(i + 1, last), lambda j: F.when(near(i, j, 0), near(i, j, 1) & (near(i, j, 2) if m == 3 else F.lit(True))).otherwise(F.lit(False)))))
        return A.total(rows).cast("long")

    e = e.select("sample", pairs(2).alias("m2"), pairs(3).alias("m3"))
    return e.select("sample", "m2", "m3", r6(F.when((F.col("m2") > 0) & (F.col("m3") > 0), -F.log(F.col("m3") / F.col("m2"))).otherwise(A.num(0))).alias("sampen"))


@query(f"""WITH {EMB}, m AS (SELECT sample, avg(v) AS mu FROM emb GROUP BY sample), k AS (SELECT unnest(range(1, 33)) AS k),
d AS (SELECT sample, k, sum((v - mu) * cos(2 * pi() * k * idx / 64)) AS re, sum((v - mu) * sin(2 * pi() * k * idx / 64)) AS im FROM emb JOIN m USING (sample), k GROUP BY sample, k), p AS (SELECT sample, k, re * re + im * im AS power FROM d)
SELECT sample, round(sum(power) FILTER (k <= 8) / sum(power), 6) AS low, round(sum(power) FILTER (k > 8 AND k <= 16) / sum(power), 6) AS middle, round(sum(power) FILTER (k > 16) / sum(power), 6) AS high, round(sum(k * power) / sum(power), 6) AS centroid FROM p GROUP BY sample""")
def dft_band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain transform by array functions: 32 frequencies of 64 points, their waves as literals."""
    import math

    e = embedded(spark, sf_dir).select("sample", A.demean(F.col("a")).alias("x"))

    def dot(f, k: int):
        wave = F.array(*[F.lit(f(2 * math.pi * k * i / 64)) for i in range(64)])
        return A.total(F.zip_with("x", wave, lambda p, q: p * q))

    power = F.array(*[F.struct(dot(math.cos, k).alias("re"), dot(math.sin, k).alias("im")) for k in range(1, 33)])
    e = e.select("sample", power.alias("c")).select("sample", F.transform("c", lambda z: z["re"] * z["re"] + z["im"] * z["im"]).alias("p"))
    p = F.col("p")
    share = lambda first, n: r6(A.total(F.slice(p, first, n)) / A.total(p))
    return e.select("sample", share(1, 8).alias("low"), share(9, 8).alias("middle"), share(17, 16).alias("high"), r6(A.total(F.transform(p, lambda x, i: x * (i + 1))) / A.total(p)).alias("centroid"))
