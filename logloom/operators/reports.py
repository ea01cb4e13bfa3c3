"""Composite reports and selections of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cost, noise, sequence, tools


def epoch_summary(entries: DataFrame) -> DataFrame:
    """session, epoch, turns, peak_ctx, files, reads, edits of each closed epoch."""
    rows = sequence.assign_epochs(entries).withColumn("last", F.max("epoch").over(Window.partitionBy("session"))).filter("epoch < last")
    return rows.groupBy("session", "epoch").agg(
        F.count_if(F.col("type").isin("user", "assistant")).alias("turns"), F.coalesce(F.max("ctx"), F.lit(0)).alias("peak_ctx"), cost.count_paths().alias("files"),
        F.sum(F.size(F.filter("tools", lambda x: x.isin(*tools.READS)))).alias("reads"), F.sum(F.size(F.filter("tools", lambda x: x.isin(*tools.WRITES)))).alias("edits"),
    )


def archaeology(entries: DataFrame) -> DataFrame:
    """session, epoch, before_ctx, after_ctx, ratio of each compaction, with the epoch that it closed."""
    cuts = sequence.detect_compactions(entries)
    w = Window.partitionBy("session").orderBy("idx")
    cuts = cuts.withColumn("epoch", (F.row_number().over(w) - 1).cast("long"))
    out = cuts.join(epoch_summary(entries), ["session", "epoch"])
    return out.select("session", "epoch", "idx", "before_ctx", F.col("ctx").alias("after_ctx"), F.round(F.col("ctx") / F.col("before_ctx"), 6).alias("ratio"), "turns", "files")


def epoch_timeline(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """session, epoch, dollars, peak_ctx, turns, files, topic, active: topic is the file touched most."""
    rows = sequence.assign_epochs(entries)
    touched = cost.touched(rows, "session", "epoch").groupBy("session", "epoch", "path").agg(F.count("*").alias("n"))
    best = touched.withColumn("r", F.row_number().over(Window.partitionBy("session", "epoch").orderBy(F.desc("n"), "path"))).filter("r = 1").select("session", "epoch", F.col("path").alias("topic"))
    files = touched.groupBy("session", "epoch").agg(F.count("*").alias("files"))
    out = cost.epoch_cost(entries, prices).join(files, ["session", "epoch"], "left").join(best, ["session", "epoch"], "left")
    last = F.max("epoch").over(Window.partitionBy("session"))
    return out.withColumn("active", F.col("epoch") == last).select("session", "epoch", "dollars", "peak_ctx", "turns", F.coalesce("files", F.lit(0)).alias("files"), "topic", "active")


def flight_record(entries: DataFrame, early: float = 0.4, short: int = 20) -> DataFrame:
    """session, epoch, turns, label: exploration, architecture, implementation, refinement or single."""
    rows = sequence.assign_epochs(entries).groupBy("session", "epoch").agg(F.count_if(F.col("type") == "assistant").alias("turns"))
    n = F.count("*").over(Window.partitionBy("session"))
    at = F.col("epoch") / F.greatest(F.col("n") - 1, F.lit(1))
    label = (
        F.when(F.col("n") == 1, "single").when(F.col("epoch") == 0, "exploration")
        .when(F.col("epoch") == F.col("n") - 1, F.when(F.col("turns") < short, "refinement").otherwise("implementation"))
        .when(at < early, "architecture").otherwise("implementation")
    )
    return rows.withColumn("n", n).select("session", "epoch", "turns", label.alias("label"))


def recent_work(entries: DataFrame, n: int = 3) -> DataFrame:
    """session, kind, rank, label, count: top files and tools."""
    each = {"file": cost.touched(entries, "session").select("session", F.col("path").alias("label")), "tool": cost.used_tools(entries, "session").select("session", F.col("tool").alias("label"))}
    parts = [rows.groupBy("session", F.lit(k).alias("kind"), "label").agg(F.count("*").alias("count")) for k, rows in each.items()]
    w = Window.partitionBy("session", "kind").orderBy(F.desc("count"), "label")
    return parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n).select("session", "kind", "rank", "label", "count")


def mark_rows(entries: DataFrame, markers: DataFrame) -> DataFrame:
    """session, uuid, marker, idx, epoch of each marker; -1 where its row is gone."""
    rows = sequence.assign_epochs(entries).select("session", "uuid", "idx", "epoch")
    out = markers.join(rows, ["session", "uuid"], "left")
    return out.select("session", "uuid", "marker", F.coalesce("idx", F.lit(-1)).alias("idx"), F.coalesce("epoch", F.lit(-1)).alias("epoch"))


def range_metadata(entries: DataFrame, prices: DataFrame, first: int, last: int) -> DataFrame:
    """session, rows, tokens, dollars, files of rows first to last."""
    part = entries.filter(F.col("idx").between(first, last))
    spent = cost.turn_costs(part, prices).groupBy("session").agg(F.round(cost.total().cast("double"), 9).alias("dollars"))
    per = part.groupBy("session").agg(F.count("*").alias("rows"), F.sum(noise.tokens()).alias("tokens"), cost.count_paths().alias("files"))
    return per.join(spent, "session", "left").withColumn("dollars", F.coalesce("dollars", F.lit(0.0)))


def amputate(entries: DataFrame, last: int) -> DataFrame:
    """Rows that stay when each session loses its last `last` rows; a session that would lose all keeps all."""
    n = F.count("*").over(Window.partitionBy("session"))
    return entries.withColumn("_n", n).filter((F.col("_n") <= last) | (F.col("idx") < F.col("_n") - last)).drop("_n")


def deletion_impact(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """session, rows, tokens, children, new_percent: what deleting rows (session, uuid) saves and re-points."""
    out = entries.join(gone, ["session", "uuid"], "left_semi")
    saved = out.groupBy("session").agg(F.count("*").alias("rows"), F.sum(noise.tokens()).alias("tokens"))
    kids = entries.join(gone.withColumnRenamed("uuid", "parent_uuid"), ["session", "parent_uuid"], "left_semi").join(gone, ["session", "uuid"], "left_anti").groupBy("session").agg(F.count("*").alias("children"))
    now = cost.context_stats(entries).select("session", "current_ctx")
    rows = saved.join(kids, "session", "left").join(now, "session")
    after = F.greatest(F.col("current_ctx") - F.col("tokens"), F.lit(0)) * 100.0 / sequence.WINDOW
    return rows.select("session", "rows", "tokens", F.coalesce("children", F.lit(0)).alias("children"), F.round(after, 4).alias("new_percent"))


def large_outputs(blocks: DataFrame, size: int = 4096) -> DataFrame:
    """session, outputs, tokens of tool results of at least `size` bytes."""
    return blocks.filter(F.col("kind") == "tool_result").filter(F.col("raw_size") >= size).groupBy("session").agg(F.count("*").alias("outputs"), F.sum(noise.tokens()).alias("tokens"))


def diagnose(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """session, idx, issue of every row with a broken link."""
    a = noise.missing_parents(entries).select("session", "idx", F.lit("chain_missing_parent").alias("issue"))
    b = noise.orphan_results(blocks).select("session", "idx", F.lit("orphaned_result").alias("issue"))
    lead = entries.filter("type in ('user', 'assistant')").withColumn("_talk", F.count_if(F.col("type") == "user").over(sequence.so_far()))
    c = lead.filter("type = 'assistant' and _talk = 0").select("session", "idx", F.lit("chain_bad_start").alias("issue"))
    return a.unionByName(b).unionByName(c)
