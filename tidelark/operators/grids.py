"""Small stated tables of parameters, attached to rows without a join."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: From so many sets on, they are one literal of the plan, which is then as quickly made as with few.
MANY = 64


def each(df: DataFrame, params: Sequence[dict]) -> DataFrame:
    """Every row with every set of parameters, as further columns. The sets are literals of the plan: their number is stated, not found in data."""
    if not params:
        raise ValueError("no parameters")
    if len(params) > MANY and all(type(v) in (int, float) for p in params for v in p.values()):
        listed = F.from_json(F.lit(json.dumps(list(params))), "array<struct<" + ", ".join(f"`{k}`: {'int' if type(v) is int else 'double'}" for k, v in params[0].items()) + ">>")
    else:
        listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params])
    return df.withColumn("_params", F.explode(listed)).select(*df.columns, *[F.col(f"_params.{k}").alias(k) for k in params[0]])


def attached(df: DataFrame, stats: DataFrame) -> DataFrame:
    """A table's one row as literals of every row."""
    row = stats.first()
    kinds = dict(stats.dtypes)
    return df.select("*", *[F.lit(row[c]).cast(kinds[c]).alias(c) for c in stats.columns])


def product_of(**axes: Sequence) -> list[dict]:
    return [dict(zip(axes, values)) for values in product(*axes.values())]


def bin_number(c: Column, bounds: Sequence[float]) -> Column:
    """How many of the rising bounds a value reaches; null for null. A balanced tree of comparisons, compiled with the plan."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(c < F.lit(bounds[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return F.when(c.isNotNull(), within(0, len(bounds)))


def bin_found(c: Column, bounds: Sequence[float]) -> Column:
    """The same by a search in one literal: for bounds so many that their comparisons would be too much code."""
    return F.when(c.isNotNull(), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= c)))


def postprocess_grid(offsets: Sequence[float] = (0.0,)) -> list[dict]:
    """The full sweep of postprocessing; fixed values."""
    grid = product_of(
        threshold_offset=offsets, alpha=[0.25, 0.4, 0.6], t_on=[0.55, 0.65, 0.75], t_off=[0.20, 0.35, 0.45],
        k_on=[1, 2, 3, 5], k_off=[1, 2, 3, 5], cooldown=[0, 2, 5], median_k=[1, 3, 5],
    )
    return [p for p in grid if p["t_off"] < p["t_on"]]


def state_machine_grid() -> list[dict]:
    """The sweep of the state machine alone; fixed values."""
    grid = product_of(alpha=[0.2, 0.3, 0.4, 0.5, 0.6], t_on=[0.5, 0.6, 0.7, 0.8], t_off=[0.2, 0.3, 0.4], k_on=[3, 5, 7, 10, 15], k_off=[3, 5, 7, 10], cooldown=[2, 5, 10])
    return [p for p in grid if p["t_off"] < p["t_on"] and p["k_on"] >= p["k_off"]]


def budgeted(grid: list[dict], budget: int | None) -> list[dict]:
    """First, middle and last of a grid, then the mildest: near the threshold, quick on, slow off, a narrow band."""
    if not budget or not 0 < budget < len(grid):
        return list(grid)
    mild = sorted(range(len(grid)), key=lambda i: (abs(grid[i]["threshold_offset"]), grid[i]["k_on"], -grid[i]["k_off"], grid[i]["t_on"] - grid[i]["t_off"], grid[i]["median_k"], grid[i]["cooldown"], grid[i]["alpha"]))
    chosen = list(dict.fromkeys([0, len(grid) // 2, len(grid) - 1, *mild]))[:budget]
    return [grid[i] for i in chosen]


def decoded(index: Column, axes: dict[str, Sequence]) -> dict[str, Column]:
    """A point of the product of axes by its number, the last axis fastest; the product is never listed."""
    out, step = {}, 1
    for name, values in reversed(list(axes.items())):
        out[name] = F.get(F.array(*[F.lit(v) for v in values]), (F.floor(index / F.lit(step)) % len(values)).cast("int"))
        step *= len(values)
    return dict(reversed(list(out.items())))
