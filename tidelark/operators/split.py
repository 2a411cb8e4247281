"""Splits that stay the same when rows are added: a hash of the sample's name decides."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.session import ship

NAME = r"^(.+)_w(\d+)_(-?\d+)$"


def stable_key(path: Column, sample: Column) -> Column:
    """basename::sample."""
    return F.concat_ws("::", F.element_at(F.split(path, "/"), -1), sample)


def fraction_sha256(key: Column, seed: int = 42) -> Column:
    """In [0, 1): the first 52 bits of the digest, exactly representable."""
    digest = F.sha2(F.concat(F.lit(f"{seed}::"), key), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def fraction_blake2b(spark, key: Column, seed: int = 42) -> Column:
    """In [0, 1): an eight-byte BLAKE2b digest, big-endian. Spark has no such hash, so it comes from an Arrow UDF."""
    ship(spark)

    @F.pandas_udf("double")
    def fraction(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(f"{seed}::{k}".encode(), digest_size=8).digest(), "big") / 2**64)

    return fraction(key)


def split_name(score: Column, valid: float = 0.2, test: float = 0.2) -> Column:
    """test, then valid, then train, by score."""
    if valid < 0 or test < 0 or valid + test >= 1:
        raise ValueError("split sizes must not be negative and must leave room for train")
    return F.when(score < test, "test").when(score < test + valid, "valid").otherwise("train")


def split_summary(df: DataFrame) -> DataFrame:
    """Samples of each split and target."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("target") == 1).alias("n_target1"), F.count_if(F.col("target") == 0).alias("n_target0"))


def parsed_name(name: Column) -> dict[str, Column]:
    """Base, window number and label of a window's name; nulls if it isn't one."""
    found = name.rlike(NAME)
    return {
        "base": F.when(found, F.regexp_extract(name, NAME, 1)),
        "window_index": F.when(found, F.regexp_extract(name, NAME, 2).cast("long")),
        "label": F.when(found, F.regexp_extract(name, NAME, 3).cast("long")),
    }


def nested_samples(windows: DataFrame, skip: int = 3) -> DataFrame:
    """A row for each sample (columns sample, window_index, label) whose windows share a label.

    Windows are ordered by their parsed number, and the first `skip` are left
    out; a sample without any left goes too.
    """
    ordered = F.array_sort(F.collect_list("window_index"))
    grouped = windows.groupBy("sample").agg(F.min("label").alias("target"), F.max("label").alias("_other"), ordered.alias("all_indices"))
    kept = grouped.where("target = _other").withColumn("window_indices", F.expr(f"slice(all_indices, {skip + 1}, greatest(size(all_indices) - {skip}, 0))"))
    return kept.where(F.size("window_indices") > 0).select("sample", "target", "window_indices")
