"""Queries that run as streams over the driver's tables and are checked against their batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.plans.decisions import MACHINE, machine_sql
from tidelark.plans.registry import query
from tidelark.plans.signals import r6
from tidelark.streaming import decisions


@query(f"""WITH RECURSIVE ev AS (SELECT user_id AS sample, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value / (value + 20) AS p, 1.0 AS q FROM events), {machine_sql('ev')}
SELECT s.sample, ev.event_id, s.state, round(s.score, 6) AS score FROM sm s JOIN ev ON ev.sample = s.sample AND ev.n = s.n""")
def stream_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = decisions.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("sample"), "ts", "event_id", (F.col("value") / (F.col("value") + 20)).alias("p"))
    traced = decisions.traced(events, "sample", ["ts", "event_id"], "p", MACHINE)
    return decisions.drained(traced, "stream-states").select("sample", "event_id", "state", r6("score").alias("score"))


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events)
SELECT epoch(start)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = decisions.counted(decisions.table_stream(spark, f"{sf_dir}/events.parquet"), "ts", "value", "event_type", "1 hour", "30 minutes")
    return decisions.latest(counted, ["start", "event_type"], "stream-windows").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
