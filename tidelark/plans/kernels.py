"""Queries that run the signal kernels in Arrow batches: filters, spectra, peaks, the whole feature pool."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.functions import features
from tidelark.functions import kernels as K
from tidelark.plans.registry import query
from tidelark.plans.roles import EMB, embedded
from tidelark.plans.signals import r6
from tidelark.session import ship


def mapped(df: DataFrame, make: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """sample and columns made from arrays a of one length, a batch at a time."""
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"sample": pdf["sample"]} | make(np.stack(pdf["a"].to_numpy())))

    return df.select("sample", "a").mapInPandas(run, f"sample bigint, {schema}")


@query(f"""WITH {EMB}, mu AS (SELECT sample, avg(v) AS mu FROM emb GROUP BY sample), w AS (SELECT sample, idx, v - mu AS c, (v - mu) * (0.54 - 0.46 * cos(2 * pi() * idx / 63)) AS x FROM emb JOIN mu USING (sample)),
k AS (SELECT unnest(range(0, 129)) AS k), d AS (SELECT sample, k, sqrt(pow(sum(x * cos(2 * pi() * k * idx / 256)), 2) + pow(sum(x * sin(2 * pi() * k * idx / 256)), 2)) AS amp FROM w, k WHERE k * 100.0 / 256 BETWEEN 5 AND 40 GROUP BY sample, k),
f AS (SELECT sample, arg_max(k * 100.0 / 256, amp) AS dom_freq, max(amp) / (quantile_cont(amp, 0.5) + 1e-12) AS peak_ratio FROM d GROUP BY sample),
z AS (SELECT sample, sum(c * c) AS z FROM w GROUP BY sample), r AS (SELECT a.sample, b.idx - a.idx AS lag, sum(a.c * b.c) AS r FROM w a JOIN w b ON a.sample = b.sample AND b.idx - a.idx BETWEEN 4 AND 32 GROUP BY a.sample, b.idx - a.idx),
q AS (SELECT sample, max(CASE WHEN z < 1e-12 THEN 0.0 ELSE r / (z + 1e-12) END) AS periodicity FROM r JOIN z USING (sample) GROUP BY sample)
SELECT sample, CAST(round(dom_freq, 6) AS DOUBLE) AS dom_freq, round(peak_ratio, 6) AS peak_ratio, round(periodicity, 6) AS periodicity FROM f JOIN q USING (sample)""")
def fft_band_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x):
        freqs, amp = K.spectrum(x, 100.0)
        own = amp[:, (freqs >= 5) & (freqs <= 40)]
        return {"dom_freq": freqs[(freqs >= 5) & (freqs <= 40)][own.argmax(axis=1)], "peak_ratio": own.max(axis=1) / (np.median(own, axis=1) + K.EPS), "periodicity": K.autocorrelation(x)[:, 4:33].max(axis=1)}

    rows = mapped(embedded(spark, sf_dir), make, "dom_freq double, peak_ratio double, periodicity double")
    return rows.select("sample", *[r6(c).alias(c) for c in ("dom_freq", "peak_ratio", "periodicity")])


@query(f"""WITH {EMB}, seg AS (SELECT sample, s, idx - s * 16 AS t, v FROM emb, (SELECT unnest([0, 1, 2]) AS s) WHERE idx >= s * 16 AND idx < s * 16 + 32), mu AS (SELECT sample, s, avg(v) AS mu FROM seg GROUP BY sample, s),
w AS (SELECT sample, s, t, (v - mu) * (0.5 - 0.5 * cos(2 * pi() * t / 32)) AS x FROM seg JOIN mu USING (sample, s)), k AS (SELECT unnest(range(0, 17)) AS k),
d AS (SELECT sample, s, k, sum(x * cos(2 * pi() * k * t / 32)) AS re, sum(x * sin(2 * pi() * k * t / 32)) AS im FROM w, k GROUP BY sample, s, k),
p AS (SELECT sample, k, avg(re * re + im * im) / (100.0 * 12.0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS p FROM d GROUP BY sample, k)
SELECT sample, round(sum(p), 6) AS power, round(sum(p * k * 3.125) / sum(p), 4) AS mean_freq FROM p GROUP BY sample""")
def welch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x):
        freqs, p = K.welch(x, 100.0, 32)
        return {"power": p.sum(axis=1), "mean_freq": (p * freqs).sum(axis=1) / p.sum(axis=1)}

    rows = mapped(embedded(spark, sf_dir), make, "power double, mean_freq double")
    return rows.select("sample", r6("power").alias("power"), F.round("mean_freq", 4).alias("mean_freq"))


@query()
def filtered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x):
        return {"low": K.rms(K.band_pass(x, 100.0, 2.0, 10.0)), "high": K.rms(K.high_pass(x, 100.0, 20.0)), "stopped": K.rms(K.band_stop(x, 100.0, 9.0, 11.0)), "notched": K.rms(K.notched(x, 100.0, 25.0, 10.0)), "median": K.median_filter(x, 5).std(axis=1), "slow": K.rms(K.resampled(x, 25, 100))}

    return mapped(embedded(spark, sf_dir), make, "low double, high double, stopped double, notched double, median double, slow double")


@query(f"""WITH {EMB}, half AS (SELECT sample, idx // 32 AS side, idx % 32 AS t, v FROM emb), seg AS (SELECT sample, side, s, t - s * 8 AS t, v FROM half, (SELECT unnest([0, 1, 2]) AS s) WHERE t >= s * 8 AND t < s * 8 + 16),
mu AS (SELECT sample, side, s, avg(v) AS mu FROM seg GROUP BY sample, side, s), w AS (SELECT sample, side, s, t, (v - mu) * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS x FROM seg JOIN mu USING (sample, side, s)), k AS (SELECT unnest(range(0, 9)) AS k),
d AS (SELECT sample, side, s, k, sum(x * cos(2 * pi() * k * t / 16)) AS re, -sum(x * sin(2 * pi() * k * t / 16)) AS im FROM w, k GROUP BY sample, side, s, k),
c AS (SELECT sample, k, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im, avg(a.re * a.re + a.im * a.im) * avg(b.re * b.re + b.im * b.im) AS down FROM (SELECT * FROM d WHERE side = 0) a JOIN (SELECT * FROM d WHERE side = 1) b USING (sample, s, k) GROUP BY sample, k),
f AS (SELECT sample, k, CASE WHEN down > 0 THEN (re * re + im * im) / down ELSE 0.0 END AS c FROM c),
own AS (SELECT sample, side, avg(v) AS mu, stddev_pop(v) AS sd FROM half GROUP BY sample, side), x AS (SELECT sample, side, t, v - mu AS v FROM half JOIN own USING (sample, side)),
lagged AS (SELECT a.sample, a.t - b.t AS lag, abs(sum(a.v * b.v)) AS r FROM (SELECT * FROM x WHERE side = 0) a JOIN (SELECT * FROM x WHERE side = 1) b ON a.sample = b.sample AND a.t - b.t BETWEEN -8 AND 8 GROUP BY a.sample, a.t - b.t),
scale AS (SELECT sample, 32 * product(sd) AS sd FROM own GROUP BY sample), l AS (SELECT sample, CASE WHEN any_value(sd) > 1e-12 THEN max(r) / any_value(sd) ELSE 0.0 END AS largest FROM lagged JOIN scale USING (sample) GROUP BY sample)
SELECT sample, round(avg(c) FILTER (k <= 2), 6) AS low, round(avg(c) FILTER (k > 2), 6) AS high, round(any_value(largest), 6) AS largest_lagged FROM f JOIN l USING (sample) GROUP BY sample""")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x):
        freqs, c = K.coherence(x[:, :32], x[:, 32:], 100.0, 16)
        return {"low": c[:, freqs <= 12.5].mean(axis=1), "high": c[:, freqs > 12.5].mean(axis=1), "largest_lagged": K.largest_correlation(x[:, :32], x[:, 32:], 8)}

    rows = mapped(embedded(spark, sf_dir), make, "low double, high double, largest_lagged double")
    return rows.select("sample", *[r6(c).alias(c) for c in ("low", "high", "largest_lagged")])


@query(f"""WITH {EMB}, n AS (SELECT *, lag(v) OVER w AS u, lead(v) OVER w AS t FROM emb WINDOW w AS (PARTITION BY sample ORDER BY idx)) SELECT sample, count(*) FILTER (v > u AND v > t) AS peaks, round(avg(v) FILTER (v > u AND v > t), 6) AS height FROM n GROUP BY sample""")
def peak_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x):
        at = [K.peaks(v) for v in x]
        return {"peaks": [len(p) for p in at], "height": [float(v[p].mean()) if len(p) else 0.0 for v, p in zip(x, at)]}

    return mapped(embedded(spark, sf_dir), make, "peaks bigint, height double").select("sample", "peaks", r6("height").alias("height"))


@query()
def peak_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x):
        at = [K.spaced(v, K.peaks(v), 6) for v in x]
        return {"peaks": [len(p) for p in at], "prominence": [float(K.prominences(v, p).mean()) if len(p) else 0.0 for v, p in zip(x, at)]}

    return mapped(embedded(spark, sf_dir), make, "peaks bigint, prominence double")


def synthetic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seconds of each sensor, read off a stored vector at different paces: pulse 6 x 300, muscle 2 x 3000, motion 3 x 300."""

    def channel(n: int, pace: int, scale: float, level: float):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.get("a", F.floor(t * pace / 7).cast("int") % 64) * scale + level)

    make = lambda n, k, scale, level: F.array(*[channel(n, c + 2, scale, level * (1 + c / 50)) for c in range(k)])
    return embedded(spark, sf_dir).select("sample", make(300, 6, 4000.0, 50000.0).alias("ppg"), make(3000, 2, 20.0, 0.0).alias("emg"), make(300, 3, 0.2, 1.0).alias("acc"))


@query()
def feature_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 241 features and the count of invalid ones."""
    return features.extracted(synthetic_windows(spark, sf_dir), ["sample"])


@query()
def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f.name, f.group, f.meaning, features.GROUP_LIMITS.get(f.group, 1)) for f in features.REGISTRY.values()], "name string, group string, meaning string, group_limit int")
