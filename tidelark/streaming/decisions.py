"""Streaming twins of the decisions: the state machine with its state kept by sample, and windowed aggregates under a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelark.operators.postprocess import LONG_AGO, Hysteresis, walk
from tidelark.session import shared_path, ship


def traced(stream: DataFrame, key: str, order: list[str], prob: str, machine: Hysteresis | None = None) -> DataFrame:
    """Adds state and score to each row; a sample goes on from its state after the last micro-batch.

    Rows of a micro-batch are taken in order; what arrives in a later one comes later.
    """
    ship(stream.sparkSession)
    m = machine or Hysteresis()
    fields = ", ".join(f"`{c}` {k}" for c, k in stream.dtypes)

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        before = state.get if state.exists else (0, 0.0, 0, 0, LONG_AGO)
        states, scores, after = walk(pdf[prob].to_numpy(float).tolist(), [1.0] * len(pdf), m, before)
        state.update(after)
        yield pdf.assign(state=pd.array(states, "int32"), score=scores)

    return stream.groupBy(key).applyInPandasWithState(run, f"{fields}, state int, score double", "now int, score double, on_count int, off_count int, since int", "append", GroupStateTimeout.NoTimeout)


def counted(stream: DataFrame, time: str, value: str, by: str, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum in sliding windows; state of windows past the watermark is dropped, and rows later than that with it."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def drained(result: DataFrame, label: str) -> DataFrame:
    """Runs an append stream over what is there now into a Parquet sink, and reads that."""
    spark = result.sparkSession
    path = shared_path(spark, label)
    result.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/data")


def latest(result: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The same for an update stream: each micro-batch writes the rows it changed under its number, and a key's last one counts."""
    spark = result.sparkSession
    path = shared_path(spark, label)

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    result.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/data")
    values = [c for c in result.columns if c not in keys]
    best = F.max_by(F.struct(*values), "epoch")
    return rows.groupBy(*keys).agg(best.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def table_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; a table may be one file, which a stream can only find by its folder."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_trigger)
    folder, name = path.rstrip("/").rsplit("/", 1)
    alone = [f for f in table.inputFiles() if f.rstrip("/").endswith(f"/{name}")]
    return stream.option("pathGlobFilter", name).parquet(folder) if alone else stream.parquet(path)
