"""Column statistics, learned on one frame and applied to others: cleaning, clipping, bands, drift."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.operators.grids import bin_found, bin_number
from tidelark.session import ship


def finite(c: str | Column) -> Column:
    """Null in place of NaN and infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sanitised(df: DataFrame, features: Sequence[str], count: str = "TOTAL_INVALID_COUNT") -> DataFrame:
    """Non-finite and null values become 0; their number is a column."""
    bad = sum((finite(c).isNull().cast("int") for c in features), F.lit(0))
    return df.select(*[c for c in df.columns if c not in features], *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in features], bad.cast("long").alias(count))


def unpivoted(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: keep, feature, x (double, null if not finite)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in features)
    return df.select(*keep, F.expr(f"stack({len(features)}, {pairs}) as (feature, x)")).withColumn("x", finite("x"))


def missing_rates(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return unpivoted(df, features).groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing_rate"))


#: Half the width, in ranks' share, of the bracket around a quantile; distinct values in a bracket that the driver takes.
BRACKET, TAKEN = 1 / 2000, 50_000
#: Ends of brackets that are compared in compiled code; more are searched.
CODED = 48


def quantiles(df: DataFrame, features: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, at any number of rows; null without a finite value.

    A sketch brackets each quantile. One pass counts what lies below and in the
    brackets; while a bracket holds too many distinct values, a sketch of it
    alone narrows it. The counts of what is left, a bounded number of values,
    give the order statistics. No task ever holds a column's values.
    """
    x = {c: finite(F.col(c).cast("double")) for c in features}
    listed = lambda qs: F.array(*[F.lit(min(max(q, 0.0), 1.0)) for q in qs])
    around = [q + d for q in shares for d in (-BRACKET, BRACKET)]
    first = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(features)], *[F.percentile_approx(x[c], listed(around), F.lit(10_000)).alias(f"b{i}") for i, c in enumerate(features)]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in features}
    open_ = []
    for i, c in enumerate(features):
        n = first[f"n{i}"]
        for j, q in enumerate(shares if n else []):
            at = (n - 1) * q
            at = float(round(at)) if abs(at - round(at)) < 1e-9 * n else at  # a rank that was meant to be whole
            low, high = first[f"b{i}"][2 * j : 2 * j + 2]
            open_.append({"c": c, "j": j, "at": at, "r": (int(at), min(int(at) + 1, n - 1)), "low": low, "high": high})
    while open_:
        # Each value goes to the bin of its column between two neighbouring ends of brackets.
        edges: dict[str, list[float]] = {}
        for k in open_:
            edges.setdefault(k["c"], []).extend((k["low"], float(np.nextafter(k["high"], np.inf))))
        edges = {c: sorted(set(e)) for c, e in edges.items()}
        binned = bin_number if sum(map(len, edges.values())) <= CODED else bin_found
        cells = F.array(*[F.struct(F.lit(i).alias("f"), binned(x[c], e).alias("b"), x[c].alias("x")) for i, (c, e) in enumerate(edges.items())])
        long = df.select(F.explode(cells).alias("h")).select("h.*").where("b is not null")
        places = {c: i for i, c in enumerate(edges)}
        sizes = {c: np.zeros(len(e) + 1, int) for c, e in edges.items()}
        distinct = {c: np.zeros(len(e) + 1, int) for c, e in edges.items()}
        names = list(edges)
        for r in long.groupBy("f", "b").agg(F.count("*").alias("n"), F.approx_count_distinct("x").alias("d")).collect():
            sizes[names[r["f"]]][r["b"]], distinct[names[r["f"]]][r["b"]] = r["n"], r["d"]
        ready, narrow, wanted = [], [], set()
        for k in open_:
            low, high = (bisect_left(edges[k["c"]], e) + 1 for e in (k["low"], float(np.nextafter(k["high"], np.inf))))
            k["under"], k["size"] = int(sizes[k["c"]][:low].sum()), int(sizes[k["c"]][low:high].sum())
            if k["under"] > k["r"][0]:
                k["low"] = -float("inf")  # the sketch was off
                narrow.append(k)
            elif k["r"][1] >= k["under"] + k["size"]:
                k["high"] = float("inf")
                narrow.append(k)
            elif distinct[k["c"]][low:high].sum() <= TAKEN:
                ready.append(k)
                wanted |= {(places[k["c"]], b) for b in range(low, high)}
            else:
                narrow.append(k)
        if ready:
            is_wanted = F.array_contains(F.array(*[F.lit((f << 32) + b) for f, b in sorted(wanted)]), F.shiftleft(F.col("f").cast("long"), 32) + F.col("b"))
            by: dict[str, list[tuple[float, int]]] = {}
            for r in long.where(is_wanted).groupBy("f", "x").count().collect():
                by.setdefault(names[r["f"]], []).append((r["x"], r["count"]))
            for c, values in by.items():
                values.sort()
                at = [v for v, _ in values]
                seen = np.concatenate([[0], np.cumsum([m for _, m in values])])
                for k in (k for k in ready if k["c"] == c):
                    first_, last_ = bisect_left(at, k["low"]), bisect_right(at, k["high"])
                    ranks = seen[first_ : last_ + 1] - seen[first_] + k["under"]
                    low, high = (at[first_ + int(np.searchsorted(ranks, r, "right")) - 1] for r in k["r"])
                    out[c][k["j"]] = low + (high - low) * (k["at"] - k["r"][0])
        sketched = [k for k in narrow if np.isfinite(k["low"]) and np.isfinite(k["high"])]
        if sketched:
            parts = []
            for i, k in enumerate(sketched):
                at = (k["r"][0] - k["under"]) / k["size"]
                parts.append(F.percentile_approx(F.when((x[k["c"]] >= k["low"]) & (x[k["c"]] <= k["high"]), x[k["c"]]), listed([at - BRACKET, at + BRACKET]), F.lit(10_000)).alias(f"b{i}"))
            row = df.agg(*parts).first()
            for i, k in enumerate(sketched):
                k["low"], k["high"] = row[f"b{i}"]
        for k in narrow:  # an open side is closed by a sketch of that side in the next round
            if not (np.isfinite(k["low"]) and np.isfinite(k["high"])):
                ends = df.agg(F.min(x[k["c"]]).alias("a"), F.max(x[k["c"]]).alias("b")).first()
                k["low"], k["high"] = max(k["low"], ends["a"]), min(k["high"], ends["b"])
        open_ = narrow
    return out


def median_fill(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Medians; 0 without a finite value."""
    return {c: q[0] if q[0] is not None else 0.0 for c, q in quantiles(train, features, [0.5]).items()}


def filled(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.select(*[F.coalesce(finite(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c) for c in df.columns])


def low_variance(df: DataFrame, features: Sequence[str], least: float = 1e-8) -> DataFrame:
    """Sample variance of each feature and whether it is kept."""
    stats = unpivoted(df, features).groupBy("feature").agg(F.var_samp("x").alias("variance"))
    return stats.withColumn("kept", F.coalesce(F.col("variance") > least, F.lit(False)))


#: Up to so many features each pair is an aggregate of the plan; beyond, code for all pairs would be too much and blocks of rows are multiplied.
WIDE = 32


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, r for each pair over rows that hold both, from one aggregation without a shuffle of rows.

    Null where a feature is constant or no row holds both, NaN where such a row isn't finite.
    """
    if len(features) > WIDE:
        return _multiplied(df, features)
    pairs = list(combinations(features, 2))

    def corr(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")  # F.corr fails on a constant
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))

    row = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    listed = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return row.select(F.expr(f"stack({len(pairs)}, {listed}) as (feature_a, feature_b, r)"))


def _multiplied(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same by products of blocks: a partition hands on its sums alone, one row for each feature and one place in it for each other."""
    ship(df.sparkSession)
    names, n = list(features), len(features)
    x = df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    # products of values far from 0 would lose the digits that tell them apart
    centre = x.agg(*[F.avg(finite(c)).alias(c) for c in x.columns]).first()
    middle = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in centre])

    def run(batches):
        sums = {k: np.zeros((n, n)) for k in ("n", "x", "xx", "xy", "bad")}
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            there = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).T.astype(float)
            a = np.array(rows).T
            fine = np.isfinite(a)
            bad, v = (there > 0) & ~fine, np.where(fine, a - middle, 0.0)
            sums["n"] += there.T @ there
            sums["x"] += v.T @ there
            sums["xx"] += (v * v).T @ there
            sums["xy"] += v.T @ v
            sums["bad"] += bad.T.astype(float) @ there
        yield pa.RecordBatch.from_pydict({"i": np.arange(n, dtype=np.int32)} | {k: list(m) for k, m in sums.items()})

    kinds = ("n", "x", "xx", "xy", "bad")
    none = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), *[F.array_repeat(F.lit(0.0), n).alias(k) for k in kinds])  # every pair is there without rows too
    parts = x.mapInArrow(run, "i int, " + ", ".join(f"`{k}` array<double>" for k in kinds)).union(none)
    each = parts.select("i", F.posexplode(F.arrays_zip(*kinds)).alias("j", "s")).groupBy("i", "j").agg(*[F.sum(f"s.{k}").alias(k) for k in kinds])
    other = each.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("x").alias("y"), F.col("xx").alias("yy"), F.col("bad").alias("worse"))
    both = each.where("i < j").join(other, ["i", "j"])
    var = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    # what rounding leaves of a constant's squares is no variation
    some = lambda s, ss: (F.col("n") > 0) & (var(s, ss) > 1e-12 * F.col(ss))
    r = F.when(F.col("bad") + F.col("worse") > 0, float("nan")).when(some("x", "xx") & some("y", "yy"), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(var("x", "xx") * var("y", "yy")))
    named = F.array(*[F.lit(c) for c in names])
    return both.select(F.get(named, "i").alias("feature_a"), F.get(named, "j").alias("feature_b"), r.alias("r"))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Of the features; 0 where one is constant. Its size is the number of features squared, whatever the rows."""
    out = np.eye(len(features))
    at = {c: i for i, c in enumerate(features)}
    if len(features) > 1:
        for r in correlations(df, features).collect():
            i, j = at[r["feature_a"]], at[r["feature_b"]]
            out[i, j] = out[j, i] = r["r"] if r["r"] is not None and np.isfinite(r["r"]) else 0.0
    return out


def pruned_by_correlation(df: DataFrame, features: Sequence[str], target: str, above: float = 0.9) -> list[str]:
    """Kept features: of a pair too alike, the one less correlated with the target goes, the earlier one at a tie."""
    m = np.abs(correlation_matrix(df, [*features, target]))
    gone: set[int] = set()
    n = len(features)
    for late in range(n):
        for early in range(late):
            if m[early, late] > above and not {early, late} & gone:
                gone.add(early if m[late, n] >= m[early, n] else late)
    return [c for i, c in enumerate(features) if i not in gone]


def vif(matrix: np.ndarray) -> np.ndarray:
    """Variance inflation of each column of a correlation matrix, 1 at least."""
    return np.clip(np.diag(np.linalg.pinv(matrix, hermitian=True)), 1.0, None) if len(matrix) > 1 else np.ones(len(matrix))


def pruned_by_vif(df: DataFrame, features: Sequence[str], above: float = 10.0) -> list[str]:
    """Rounds that drop every feature above the bound, until none is, two are left, or half as many rounds as features have passed.

    The correlation matrix is aggregated once; later rounds take its minors.
    """
    kept, matrix = list(range(len(features))), correlation_matrix(df, features)
    for _ in range(max(len(features) // 2, 1)):
        if len(kept) <= 2:
            break
        high = vif(matrix[np.ix_(kept, kept)]) > above
        if not high.any():
            break
        kept = [i for i, h in zip(kept, high) if not h]
    return [features[i] for i in kept]


def vif_of_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Infinite for a pair that is one line; 1 where a feature is constant."""
    r = F.col("r")
    return correlations(df, features).withColumn("vif", F.when(F.abs(r) >= 1, float("inf")).otherwise(F.greatest(F.lit(1.0), F.try_divide(F.lit(1.0), 1 - r * r))))


def cleaned(train: DataFrame, features: Sequence[str], target: str, missing: float = 0.3, variance: float = 1e-8, alike: float = 0.9, inflation: float = 10.0) -> tuple[list[str], dict[str, list[str]], dict[str, float]]:
    """Kept features, removed ones by reason, and fills, all learned on the train rows."""
    rates = {r["feature"]: r["missing_rate"] for r in missing_rates(train, features).collect()}
    a = [c for c in features if rates.get(c, 0.0) <= missing]
    fills = median_fill(train, a) if a else {}
    full = filled(train, fills)
    flat = {r["feature"] for r in low_variance(full, a, variance).where("not kept").collect()} if a else set()
    b = [c for c in a if c not in flat]
    c = pruned_by_correlation(full, b, target, alike) if len(b) > 1 else b
    d = pruned_by_vif(full, c, inflation) if len(c) > 2 else c
    gone = lambda x, y: [f for f in x if f not in set(y)]
    return d, {"missing": gone(features, a), "low_variance": gone(a, b), "high_corr": gone(b, c), "high_vif": gone(c, d)}, fills


def clip_bounds(train: DataFrame, features: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Quartiles less and plus k times their range; unbounded if that is 0."""
    out = {}
    for c, (low, high) in quantiles(train, features, [0.25, 0.75]).items():
        wide = low is not None and high - low > 1e-10
        out[c] = (low - k * (high - low), high + k * (high - low)) if wide else (-float("inf"), float("inf"))
    return out


def clipped(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[F.least(F.greatest(F.col(c), F.lit(float(bounds[c][0]))), F.lit(float(bounds[c][1]))).alias(c) if c in bounds else F.col(c) for c in df.columns])


def quantile_bands(train: DataFrame, features: Sequence[str], low: float = 0.05, high: float = 0.95) -> dict[str, tuple[float, float]]:
    return {c: (q[0], q[1]) for c, q in quantiles(train, features, [low, high]).items() if q[0] is not None}


def quality_thresholds(train: DataFrame, features: Sequence[str], high: float = 0.99, low: float = 0.01) -> DataFrame:
    """feature, type, thr: names ending in _std must not be too high, the size of others not too low."""
    up, down = [c for c in features if c.endswith("_std")], [c for c in features if not c.endswith("_std")]
    sizes = train.select(*[F.abs(F.col(c)).alias(c) for c in down]) if down else train
    rows = [(c, "high", q[0]) for c, q in quantiles(train, up, [high]).items()] if up else []
    rows += [(c, "low", q[0]) for c, q in quantiles(sizes, down, [low]).items()] if down else []
    return train.sparkSession.createDataFrame([r for r in rows if r[2] is not None], "feature string, type string, thr double")


def soft(violation: Column, floor: float = 0.5) -> Column:
    v = F.least(F.greatest(violation, F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.lit(floor), 1 - (1 - floor) * v)


def quality(thresholds: dict[str, tuple[str, float]]) -> Column:
    """Product over features of how far each is beyond its threshold, each at least a half."""
    out = F.lit(1.0)
    for c, (kind, thr) in thresholds.items():
        if thr:
            x = finite(c)
            beyond = (x - thr) / abs(thr) if kind == "high" else (thr - F.abs(x)) / abs(thr)
            out = out * F.coalesce(soft(beyond), F.lit(1.0))
    return out


def ood_score(bands: dict[str, tuple[float, float]]) -> Column:
    """Share of finite features outside their bands; null without any."""
    n = sum((finite(c).isNotNull().cast("int") for c in bands), F.lit(0))
    out = sum((F.coalesce((finite(c) < lo) | (finite(c) > hi), F.lit(False)).cast("int") for c, (lo, hi) in bands.items()), F.lit(0))
    return F.when(n > 0, out / n)


def ood_summary(scored: DataFrame, key: str, score: str = "ood", alert: float = 0.3) -> DataFrame:
    """Mean and share of alerts of each sample; the sample alerts if its mean does."""
    grouped = scored.groupBy(key).agg(F.avg(score).alias("ood_mean"), F.avg(F.when(F.col(score).isNotNull(), (F.col(score) > alert).cast("double"))).alias("ood_window_alert_rate"), F.count(score).alias("n_windows"))
    return grouped.withColumn("alerts", F.coalesce(F.col("ood_mean") > alert, F.lit(False)))


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return unpivoted(df, features).groupBy("feature").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing_rate"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def standardised(df: DataFrame, features: Sequence[str], limit: float | None = None) -> DataFrame:
    """Median-filled z-scores over population deviations, cut at the limit; one aggregation of one row."""
    full = filled(df, median_fill(df, features))
    row = full.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()

    def z(c: str) -> Column:
        out = (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0)
        return F.least(F.greatest(out, F.lit(-limit)), F.lit(limit)) if limit else out

    return full.select(*[z(c).alias(c) if c in features else F.col(c) for c in full.columns])


def pca_scores(df: DataFrame, features: Sequence[str], components: int = 2) -> DataFrame:
    """Adds pc1, pc2, ... : standardised features projected on the first components, each signed so that its largest loading is positive."""
    z = standardised(df, features)
    values, vectors = np.linalg.eigh(correlation_matrix(z, features))
    for k, i in enumerate(np.argsort(-values)[:components]):
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        z = z.withColumn(f"pc{k + 1}", sum((F.col(c) * F.lit(float(x)) for c, x in zip(features, v)), F.lit(0.0)))
    return z


def distributions(df: DataFrame, features: Sequence[str], target: str, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """feature, target, share, value: what a plot of distributions by target shows."""
    rows = []
    for t in sorted(r[0] for r in df.select(target).distinct().collect() if r[0] is not None):
        for c, values in quantiles(df.where(F.col(target) == t), features, shares).items():
            rows += [(c, int(t), float(q), v) for q, v in zip(shares, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, target int, share double, value double")


def pca_loadings(df: DataFrame, features: Sequence[str], components: int = 2) -> DataFrame:
    """feature, loading: summed sizes of the loadings on the first components of the standardised features.

    The correlation matrix is what rows are reduced to; its eigenvectors are found on the driver.
    """
    values, vectors = np.linalg.eigh(correlation_matrix(df, features))
    top = np.argsort(-values)[:components]
    size = np.abs(vectors[:, top]).sum(axis=1)
    return df.sparkSession.createDataFrame([(c, float(s)) for c, s in zip(features, size)], "feature string, loading double")
