"""Sliding windows over rows and arrays, and alignment across sampling rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Position of each row in its sample, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def window_numbers(idx: Column, size: int, stride: int) -> Column:
    """Numbers of the windows that hold a position: from ceil((i - size + 1) / stride), 0 at least, to floor(i / stride)."""
    first = F.greatest(F.ceil((idx - size + 1) / stride), F.lit(0)).cast("int")
    return F.sequence(first, F.floor(idx / stride).cast("int"))


def windowed(df: DataFrame, idx: str, size: int, stride: int, name: str = "window") -> DataFrame:
    """A row for each position and window that holds it. Groups of fewer than `size` rows are partial: see `whole`.

    Where size isn't below stride some positions lie in no window.
    """
    covered = F.floor(F.col(idx) / stride) * stride + size > F.col(idx)
    rows = df if size >= stride else df.where(covered)
    return rows.withColumn(name, F.explode(window_numbers(F.col(idx), size, stride)))


def whole(size: int) -> Column:
    """For groups of `windowed`: no position is missing."""
    return F.count(F.lit(1)) == size


def aligned(fast: Column, start: Column, ratio: int, length: Column) -> Column:
    """The part of a faster signal that a slower one's window covers: cut at the end, null past it."""
    first = (start * ratio).cast("int")
    return F.when(first < F.size(fast), F.slice(fast, first + 1, (length * ratio).cast("int")))


def after_warmup(df: DataFrame, key: str, order: Sequence[str], skip: int) -> DataFrame:
    """Without the first rows of each sample."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") > skip).drop("_rank")
