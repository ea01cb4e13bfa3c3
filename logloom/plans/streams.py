"""Monitoring queries: the entries are written as files and replayed through a stream over what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, cost, sequence
from ..sources import bridge
from ..streaming import monitor


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _replayed(spark: SparkSession, rows: DataFrame, make, complete: bool = False, cut: int | None = None) -> DataFrame:
    """What `make` gives for a stream of `rows`; with `cut` the rows from that idx come in a second run, on the state of the first."""
    folder = _folder(spark)
    for part in [rows] if cut is None else [rows.filter(F.col("idx") < cut), rows.filter(F.col("idx") >= cut)]:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = make(monitor.stream_entries(spark, f"{folder}/in", rows.schema, files=1_000_000))
        (monitor.replay_table if complete else monitor.replay)(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _on_changed(spark: SparkSession, d: str, make, cut: int | None = None) -> DataFrame:
    """What `make` gives for the sessions of each batch of entries, the last result of each session."""
    folder = _folder(spark)
    rows = bridge.entries(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in [rows] if cut is None else [rows.filter(F.col("idx") < cut), rows.filter(F.col("idx") >= cut)]:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = monitor.stream_entries(spark, f"{folder}/in", rows.schema, files=1_000_000)
        monitor.on_changed(stream, f"{folder}/in", make, f"{folder}/out", f"{folder}/checkpoint")
    return monitor.latest(spark, f"{folder}/out")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return bridge.entries(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("session", "idx", "ts", "ctx", "raw_size")


def _costs(spark: SparkSession, d: str) -> DataFrame:
    priced = cost.turn_costs(bridge.entries(spark, d), bridge.prices(spark))
    return priced.select(F.col("ts").cast("timestamp").alias("ts"), F.col("dollars").cast("decimal(20,9)").alias("dollars"))


def stream_running_stats(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, _entries(spark, d), monitor.running_stats, complete=True)


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, _entries(spark, d), monitor.alerts, cut=20)


def stream_cost_windows(spark: SparkSession, d: str) -> DataFrame:
    out = _replayed(spark, _costs(spark, d), monitor.cost_windows, complete=True)
    return out.select(F.to_date("week_start").alias("week_start"), "turns", F.round(F.col("dollars").cast("double"), 9).alias("dollars"))


def stream_branches(spark: SparkSession, d: str) -> DataFrame:
    out = _replayed(spark, _entries(spark, d), lambda e: monitor.branches(e, "12 hours"), complete=True)
    return out.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))


def stream_auto_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, _entries(spark, d), monitor.auto_checkpoints, cut=20)


def stream_expert_trigger(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, _entries(spark, d), monitor.expert_triggers, cut=20)


def stream_changed_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, _entries(spark, d), monitor.changed_sessions, cut=20).groupBy("session").agg(F.count("*").alias("times"))


def stream_savings_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = bridge.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.floor("l_quantity").alias("tokens"), F.floor("l_extendedprice").alias("avoided"))
    return _replayed(spark, lines, monitor.savings_totals, complete=True)


def stream_clean(spark: SparkSession, d: str) -> DataFrame:
    return _on_changed(spark, d, lambda e: clean.clean_tiers(e, bridge.blocks(e), 3).select("session", "idx", "uuid", "type"))


def stream_tangent_advisory(spark: SparkSession, d: str) -> DataFrame:
    def advise(e: DataFrame) -> DataFrame:
        return sequence.find_tangents(e).groupBy("session").agg(F.count("*").alias("groups"), F.sum("entries").alias("entries"), F.sum("tokens").alias("tokens"))

    return _on_changed(spark, d, advise, cut=20)


STREAM_QUERIES = {
    "stream_branches": stream_branches,
    "stream_auto_checkpoint": stream_auto_checkpoint,
    "stream_expert_trigger": stream_expert_trigger,
    "stream_changed_sessions": stream_changed_sessions,
    "stream_savings_totals": stream_savings_totals,
    "stream_clean": stream_clean,
    "stream_tangent_advisory": stream_tangent_advisory,
    "stream_running_stats": stream_running_stats,
    "stream_alerts": stream_alerts,
    "stream_cost_windows": stream_cost_windows,
}
