"""Array functions as Column expressions: everything here runs in the JVM.

An array is one window of a signal. Empty arrays give 0 where a statistic has
no value, as features of missing channels are 0 rather than null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def num(x: float) -> Column:
    return F.lit(float(x))


def safe_div(a: Column, b: Column) -> Column:
    """a / (b + 1e-12)."""
    return a / (b + num(EPS))


def total(a: Column) -> Column:
    return F.aggregate(a, num(0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(num(0))


def demean(a: Column) -> Column:
    """Subtracts the mean; the mean is bound once per row by a one-element array."""
    return F.flatten(F.transform(F.array(mean(a)), lambda m: F.transform(a, lambda x: x - m)))


def moment(a: Column, k: int) -> Column:
    """Central moment of order k."""
    return mean(F.transform(demean(a), lambda x: F.pow(x, num(k)) if k != 2 else x * x))


def std(a: Column) -> Column:
    return F.sqrt(moment(a, 2))


def skewness(a: Column) -> Column:
    return moment(a, 3) / (F.pow(std(a), num(3)) + num(EPS))


def kurtosis(a: Column) -> Column:
    """Raw, not excess."""
    return moment(a, 4) / (F.pow(moment(a, 2), num(2)) + num(EPS))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    s, at = F.array_sort(a), (F.size(a) - 1) * num(q)
    low = F.floor(at).cast("int")
    first, second = F.get(s, low), F.get(s, F.least(low + 1, F.size(a) - 1))
    return F.when(F.size(a) > 0, first + (second - first) * (at - low)).otherwise(num(0))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def mad(a: Column) -> Column:
    """Median distance from the median, unscaled."""
    return median(F.flatten(F.transform(F.array(median(a)), lambda m: F.transform(a, lambda x: F.abs(x - m)))))


def iqr(a: Column) -> Column:
    return quantile(a, 0.75) - quantile(a, 0.25)


def lead(a: Column, by: int = 1) -> Column:
    return F.when(F.size(a) > by, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))).otherwise(F.slice(a, 1, 0))


def trail(a: Column, by: int = 1) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0)))


def diff(a: Column) -> Column:
    return F.zip_with(lead(a), trail(a), lambda x, y: x - y)


def count_true(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda n, x: n + x.cast("int")).cast("double")


def rms(a: Column) -> Column:
    return F.sqrt(mean(F.transform(a, lambda x: x * x)))


def corr(a: Column, b: Column) -> Column:
    """Pearson's; 0 if either is constant."""
    x, y = demean(a), demean(b)
    top = total(F.zip_with(x, y, lambda p, q: p * q))
    down = F.sqrt(total(F.transform(x, lambda p: p * p)) * total(F.transform(y, lambda p: p * p)))
    return F.when(down > num(EPS), top / down).otherwise(num(0))


def winsorised(a: Column, low: float = 0.05, high: float = 0.95) -> Column:
    return F.flatten(F.transform(F.array(F.struct(quantile(a, low).alias("lo"), quantile(a, high).alias("hi"))), lambda b: F.transform(a, lambda x: F.least(F.greatest(x, b["lo"]), b["hi"]))))


def safe_corr(a: Column, b: Column, winsorise: bool = False) -> Column:
    """Over the common length; 0 below eight values or without variation."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    return F.when(n >= 8, corr(winsorised(x), winsorised(y)) if winsorise else corr(x, y)).otherwise(num(0))


def moving_average(a: Column, k: int = 3) -> Column:
    """Centred mean of k values over zero-padded edges, so the ends shrink."""
    half = k // 2
    padded = F.concat(F.array_repeat(num(0), half), a, F.array_repeat(num(0), half))
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: total(F.slice(padded, i, k)) / k)


def remove_bursts(a: Column, k: float = 6.0) -> Column:
    """A value that jumps by more than k MADs of the differences from both neighbours gives way to their mean."""
    limit = F.greatest(mad(diff(a)) * k, num(EPS))
    n = F.size(a)

    def mended(x: Column, i: Column, t: Column) -> Column:
        before, after = F.get(a, i - 1), F.get(a, i + 1)
        return F.when((i > 0) & (i < n - 1) & (F.abs(x - before) > t) & (F.abs(after - x) > t), (before + after) / 2).otherwise(x)

    return F.flatten(F.transform(F.array(limit), lambda t: F.transform(a, lambda x, i: mended(x, i, t))))


def remove_steps(a: Column, k: float = 10.0) -> Column:
    """Left to right, a value further than k MADs of the differences from the value kept before it becomes that value."""
    limit = F.greatest(mad(diff(a)) * k, num(EPS))
    start = F.slice(a, 1, 1)
    return F.flatten(
        F.transform(F.array(limit), lambda t: F.aggregate(lead(a), start, lambda out, x: F.concat(out, F.array(F.when(F.abs(x - F.element_at(out, -1)) > t, F.element_at(out, -1)).otherwise(x)))))
    )


def slope(a: Column) -> Column:
    """Least-squares slope over the positions."""
    n = F.size(a).cast("double")
    at = F.transform(a, lambda _, i: i.cast("double") - (n - 1) / 2)
    return F.when(n > 1, total(F.zip_with(at, demean(a), lambda p, q: p * q)) / (n * (n * n - 1) / 12)).otherwise(num(0))


def zero_crossings(a: Column, limit: float = 0.0) -> Column:
    """Sign changes between neighbours that differ by at least the limit."""
    return count_true(F.zip_with(lead(a), trail(a), lambda y, x: (x * y < 0) & (F.abs(y - x) >= num(limit))))


def slope_changes(a: Column, limit: float = 0.0) -> Column:
    d = diff(a)
    return count_true(F.zip_with(lead(d), trail(d), lambda y, x: (x * y < 0) & ((F.abs(x) >= num(limit)) | (F.abs(y) >= num(limit)))))


def hjorth(a: Column) -> tuple[Column, Column, Column]:
    """Activity, mobility and complexity."""
    v0, v1, v2 = moment(a, 2), moment(diff(a), 2), moment(diff(diff(a)), 2)
    mobility = F.sqrt(safe_div(v1, v0))
    return v0, mobility, safe_div(F.sqrt(safe_div(v2, v1)), mobility)


def sliding(a: Column, size: int, stride: int) -> Column:
    """All whole windows; none of an array shorter than one."""
    starts = F.sequence(F.lit(0), F.size(a) - size, F.lit(stride))
    return F.when(F.size(a) >= size, F.transform(starts, lambda i: F.slice(a, i + 1, size))).otherwise(F.transform(F.slice(a, 1, 0), lambda x: F.array(x)))
