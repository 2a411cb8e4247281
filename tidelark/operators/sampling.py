"""Repeatable samples: a hash of a row's key decides, so a sample doesn't change with partitions or order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.operators.split import fraction_sha256
from tidelark.operators.stats import quantiles


def score(keys: Sequence[str], seed: int = 42) -> Column:
    """In [0, 1)."""
    return fraction_sha256(F.concat_ws("::", *[F.col(k).cast("string") for k in keys]), seed)


def first(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows of the smallest scores; rows of one key have one score, and all that tie with the last stay.

    The n-th score is an order statistic found by counting, so nothing is sorted.
    """
    rows = df.withColumn("_score", score(keys, seed))
    total = rows.count()
    if n >= total:
        return df
    if n <= 0:
        return df.where("false")
    cut = quantiles(rows, ["_score"], [(n - 1) / (total - 1)])["_score"][0]
    return rows.where(F.col("_score") <= cut).drop("_score")


def balanced(df: DataFrame, target: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """All negatives and as many positives; all rows where there aren't more positives than negatives, or one class is missing."""
    row = df.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")).first()
    if not row["n"] or row["p"] <= row["n"]:
        return df
    return df.where(F.col(target) == 0).unionByName(first(df.where(F.col(target) == 1), keys, row["n"], seed))
