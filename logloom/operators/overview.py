"""Rows that sum up sessions, projects and the whole fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import budget, cost, frame, reports, scoring, sequence, views


def timeline(entries: DataFrame, prices: DataFrame, markers: DataFrame) -> DataFrame:
    """session, epoch, turns, peak_ctx, dollars, topic, out_scope, drift, ghosts, marks, active of each epoch with usage.

    The topic is the folder with most of the epoch's files, without files what its most used tool is for; ties by
    name. ghosts are files of the epoch before that this one writes; marks count rows of `markers` (session, uuid, marker).
    """
    rows = sequence.assign_epochs(entries)
    folders = cost.touched(rows, "session", "epoch").select("session", "epoch", "path").distinct().groupBy("session", "epoch", F.regexp_replace("path", "/[^/]*$", "").alias("dir")).agg(F.count("*").alias("n"))
    folder = folders.groupBy("session", "epoch").agg(F.min_by("dir", F.struct(-F.col("n"), F.col("dir"))).alias("dir"))
    used = cost.used_tools(rows, "session", "epoch").groupBy("session", "epoch", "tool").agg(F.count("*").alias("n"))
    tool = used.groupBy("session", "epoch").agg(F.min_by("tool", F.struct(-F.col("n"), F.col("tool"))).alias("tool"))
    scopes = cost.epoch_scopes(entries)
    ghosts = cost.ghost_files(entries).groupBy("session", (F.col("epoch") + 1).alias("epoch")).agg(F.count("*").alias("ghosts"))
    marks = reports.mark_rows(entries, markers).filter("epoch >= 0").groupBy("session", "epoch").agg(F.count("*").alias("marks"))
    out = cost.epoch_cost(entries, prices)
    for part in (folder, tool, scopes, ghosts, marks):
        out = out.join(part, ["session", "epoch"], "left")
    out = out.na.fill(0, ["in_scope", "out_scope", "ghosts", "marks"])
    use = F.when(F.col("tool") == "Bash", "debugging/testing").when(F.col("tool") == "Read", "code exploration").when(F.col("tool").isin("Edit", "Write", "MultiEdit"), "implementation")
    topic = F.coalesce("dir", use, F.concat(F.lit("tool focus: "), "tool"), F.concat(F.lit("epoch "), F.col("epoch").cast("string")))
    drift = F.round(F.col("out_scope") / F.greatest(F.col("in_scope") + F.col("out_scope"), F.lit(1)), 6)
    active = F.col("epoch") == F.max("epoch").over(Window.partitionBy("session"))
    return out.select("session", "epoch", "turns", "peak_ctx", "dollars", topic.alias("topic"), "out_scope", drift.alias("drift"), "ghosts", "marks", active.alias("active"))


def record_snapshot(entries: DataFrame, blocks: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a session for a snapshot log: project, hours, turns, compactions, context, signal, noise, cost."""
    base = sequence.assign_epochs(entries).groupBy("session", "project").agg(F.count_if(F.col("type").isin("user", "assistant")).alias("turns"), F.max("epoch").alias("compactions"))
    parts = [
        sequence.session_duration(entries), cost.context_stats(entries).select("session", "usage_percent"),
        cost.health(entries, blocks).select("session", F.col("grade").alias("signal_grade"), "signal_percent", "noise_tokens", F.col("biggest").alias("top_noise")), cost.session_cost(entries, prices),
    ]
    for p in parts:
        base = base.join(p, "session", "left")
    hours = F.col("seconds") / 3600
    return base.withColumn("hours", hours).withColumn("per_hour", F.round(F.when(F.col("seconds") > 0, F.col("dollars") / hours), 6)).drop("seconds")


def fleet_health(s: DataFrame, m: DataFrame) -> DataFrame:
    """One row: sessions, sidechain_sessions, sidechain_rows, broken, and the sessions with the worst entropy and cadence (ties by name).

    s: the facts of sessions, m: the log's rows or their frame; see `frame`.
    """
    whole = views.chain_light(m).agg(F.count("*").alias("sessions"), F.count_if(~F.col("whole")).alias("broken"))
    worst = lambda score: F.min(F.struct((-score).alias("s"), F.col("session").alias("name")))
    held = s.agg(
        F.count_if(F.col("side_rows") > 0).alias("sidechain_sessions"), F.coalesce(F.sum("side_rows"), F.lit(0)).alias("sidechain_rows"),
        worst(frame.entropy_columns()["score"]).alias("e"), worst(scoring.cadence_columns()["score"]).alias("c"),
    )
    held = held.select("sidechain_sessions", "sidechain_rows", *[f for n, k in (("entropy", "e"), ("cadence", "c")) for f in (F.col(f"{k}.name").alias(f"{n}_leader"), (-F.col(f"{k}.s")).alias(f"{n}_score"))])
    return whole.crossJoin(held)  # one row each


def budget_actions(m: DataFrame, tangents: DataFrame, limit: float, spent: float) -> DataFrame:
    """session, rank, action, dollars: four ways to spend less, the most first, ties in the order below.

    m: see `scoring.metrics`; tangents: session, dollars of rows out of scope.
    """
    rows = views.projected_savings(m).select("session", F.col("dollars").alias("clean")).join(scoring.budget_risk(m, limit, spent), "session")
    rows = rows.join(tangents.select("session", F.col("dollars").alias("away")), "session", "left")
    # The names of the actions.
    ways = {"clean noise now": F.col("clean"), "split tangent range": F.coalesce("away", F.lit(0.0)), "start new session with branch export": F.round(F.col("to_compaction") * 0.40, 6), "offload mechanical work to cheaper agents or CI": F.round(F.col("to_compaction") * 0.25, 6)}
    each = F.posexplode(F.array(*[F.struct(F.lit(k).alias("action"), v.alias("dollars")) for k, v in ways.items()])).alias("n", "w")
    ranked = rows.select("session", each).select("session", "n", "w.*")
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("dollars"), "n")).cast("long")
    return ranked.withColumn("rank", rank).select("session", "rank", "action", "dollars")


def tangent_dollars(m: DataFrame) -> DataFrame:
    """session, dollars of the rows of out-of-scope islands of a frame."""
    return m.filter("drift_island is not null").groupBy("session").agg(F.round(cost.total().cast("double"), 9).alias("dollars"))


def quick_list_scores(stats: DataFrame, rate: int = 1200) -> DataFrame:
    """session, entropy, level, cadence, status from what a list knows, at a fixed growth.

    stats: session, current_ctx, signal_percent (whole), compactions. Sessions without context are left out.
    """
    rows = stats.filter("current_ctx > 0")
    signal = views.grade_ratio(cost.grade(F.col("signal_percent")))
    score = 100 * (0.30 * (1 - signal) + 0.25 * F.least(F.col("current_ctx") / sequence.LIMIT, F.lit(1.0)) + 0.10 * F.least("compactions", F.lit(10)) / 10)
    level = F.when(score <= 20, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")
    quick = rows.select(
        "session", "current_ctx", "compactions", F.lit(rate).alias("growth_rate"), F.floor(F.greatest(sequence.LIMIT - F.col("current_ctx"), F.lit(0)) / rate).alias("turns_left"),
        F.lit(0).alias("since_cleanup"), F.lit(0.0).alias("usage_percent"), F.lit(None).cast("string").alias("biggest"), F.floor(F.col("current_ctx") * (100 - F.col("signal_percent")) / 100).alias("noise_tokens"),
    )
    swept = scoring.cadence(quick).select("session", F.col("score").alias("cadence"), "status")
    return rows.select("session", F.round(score, 9).alias("entropy"), level.alias("level")).join(swept, "session")


def filter_snapshots(snapshots: DataFrame, since: str | None = None, project=None, now=None) -> DataFrame:
    """Snapshots (ts, project and others) of a time until `now` (the log's last time, if not given) and of a project."""
    if since:
        end = F.lit(now if now is not None else snapshots.agg(F.max("ts")).first()[0])
        snapshots = snapshots.filter(F.col("ts") >= end - F.expr(f"interval {since}"))
    return snapshots if project is None else snapshots.filter(F.col("project") == project)


def weekly_savings(events: DataFrame, anchor: str) -> DataFrame:
    """week_start, events, avoided of each billing week. events: ts, avoided."""
    per = events.groupBy(budget._week("ts", anchor).alias("week")).agg(F.count("*").alias("events"), F.round(F.sum(F.col("avoided").cast("decimal(20,4)")).cast("double"), 2).alias("avoided"))
    return per.select(F.date_add(F.lit(anchor).cast("date"), (F.col("week") * 7).cast("int")).alias("week_start"), "events", "avoided")
