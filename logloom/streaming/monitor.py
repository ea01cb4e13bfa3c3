"""Structured Streaming forms of the monitoring queries, over an append-only folder of entry files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_entries(spark: SparkSession, path: str, schema, watermark: str = "1 hour", files: int = 64) -> DataFrame:
    """Entries from Parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withWatermark("ts", watermark)


def running_stats(entries: DataFrame) -> DataFrame:
    """session, rows, bytes, peak_ctx so far."""
    return entries.groupBy("session").agg(F.count("*").alias("rows"), F.sum("raw_size").alias("bytes"), F.max("ctx").alias("peak_ctx"))


def cost_windows(costs: DataFrame, width: str = "7 days", start: str | None = None) -> DataFrame:
    """Dollars of each window of event time."""
    when = F.window("ts", width, width, start) if start else F.window("ts", width)
    return costs.groupBy(when.alias("w")).agg(F.count("*").alias("turns"), F.sum("dollars").alias("dollars")).select(F.col("w.start").alias("week_start"), "turns", "dollars")


def branches(entries: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """session, first_ts, rows of spans without a gap; a gap of just that length does not part two spans here."""
    return entries.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("rows")).select("session", F.col("w.start").alias("first_ts"), "rows")


EVENT = "session string, idx long, event string, ctx long"
STATE = "last long, armed boolean"


def alerts(entries: DataFrame, drop: int = 50_000, limit: int = 200_000, percent: float = 80.0) -> DataFrame:
    """session, idx, event, ctx: compactions, and one alert each time the context passes a share of the window.

    State per session: the last context, and whether the next crossing alerts. Rows of a batch are taken by idx.
    """
    level = limit * percent / 100

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, armed = state.get if state.exists else (0, True)
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, ctx in zip(rows["idx"], rows["ctx"], strict=True):
            if pd.isna(ctx):
                continue
            if last > 0 and last - ctx > drop:
                out.append((key[0], int(idx), "compaction", int(ctx)))
            if ctx >= level and armed:
                out.append((key[0], int(idx), "alert", int(ctx)))
            last, armed = int(ctx), bool(ctx < level)
        state.update((last, armed))
        yield pd.DataFrame(out, columns=["session", "idx", "event", "ctx"])

    return entries.groupBy("session").applyInPandasWithState(run, EVENT, STATE, "append", GroupStateTimeout.NoTimeout)


def _stateful(entries: DataFrame, step, start: tuple, state: str, out: str) -> DataFrame:
    """Rows that `step(session, rows by idx, state)` yields; it returns them and the session's next state."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("idx")
        found, after = step(key[0], rows, held.get if held.exists else start)
        held.update(after)
        yield pd.DataFrame(found, columns=names)

    return entries.groupBy("session").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def auto_checkpoints(entries: DataFrame, percent: float = 70.0, drop: int = 50_000, limit: int = 200_000) -> DataFrame:
    """session, idx, epoch, ctx: the first row of each epoch whose context is at least a share of the window."""
    level = limit * percent / 100

    def step(session, rows, state):
        last, epoch, done = state
        found = []
        for idx, ctx in rows.loc[rows["ctx"].notna(), ["idx", "ctx"]].itertuples(index=False):
            if last > 0 and last - ctx > drop:
                epoch, done = epoch + 1, False
            if ctx >= level and not done:
                found.append((session, int(idx), epoch, int(ctx)))
                done = True
            last = int(ctx)
        return found, (last, epoch, done)

    return _stateful(entries, step, (0, 0, False), "last long, epoch long, done boolean", "session string, idx long, epoch long, ctx long")


def expert_triggers(entries: DataFrame, percent: float = 80.0, turns: int = 5, drop: int = 50_000, limit: int = 200_000, full: int = 165_000) -> DataFrame:
    """session, idx, ctx, turns_left: after each batch, sessions whose context is nearly full or has few turns left.

    Turns left stand on the context over the rows with usage of the current epoch.
    """

    def step(session, rows, state):
        last, uses = state
        used = rows.loc[rows["ctx"].notna(), ["idx", "ctx"]]
        for ctx in used["ctx"]:
            uses = 1 if last > 0 and last - ctx > drop else uses + 1
            last = int(ctx)
        per = last // uses if uses else 0
        left = (full - last) // per if per > 0 and full > last else 0
        hit = last > 0 and len(used) and (last * 100 / limit >= percent or left < turns)
        return ([(session, int(used["idx"].iloc[-1]), last, left)] if hit else []), (last, uses)

    return _stateful(entries, step, (0, 0), "last long, uses long", "session string, idx long, ctx long, turns_left long")


def changed_sessions(entries: DataFrame, cooldown: float = 30.0) -> DataFrame:
    """session, at_us: after each batch, sessions with rows later than the time they were last named and a cooldown."""

    def step(session, rows, state):
        newest = int(rows["us"].max())
        named = newest > state[0] + int(cooldown * 1e6) or state[0] < 0
        return ([(session, newest)] if named else []), (newest if named else state[0],)

    timed = entries.filter("ts is not null").withColumn("us", F.unix_micros("ts"))
    return _stateful(timed.select("session", "idx", "us"), step, (-1,), "at_us long", "session string, at_us long")


def savings_totals(events: DataFrame) -> DataFrame:
    """session, events, tokens, avoided so far."""
    return events.groupBy("session").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.sum("avoided").alias("avoided"))


def on_changed(stream: DataFrame, history: str, make, out: str, checkpoint: str) -> None:
    """Runs `make` on all rows so far of the sessions of each batch; `out` holds one folder a batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = spark.read.schema(batch.schema).parquet(history).join(batch.select("session").distinct(), "session", "left_semi")
        make(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """What `on_changed` has written for each session last."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy("session").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["session", "batch"], "left_semi").drop("batch")


def replay(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there into Parquet files under `path`."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def replay_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an updating stream over what is there; `path` holds the last full result."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
