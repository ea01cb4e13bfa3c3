"""Closed-form scores over one row of metrics a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frame


def metrics(entries: DataFrame, blocks: DataFrame, prices: DataFrame) -> DataFrame:
    """The facts of each session (see `frame.facts`), which the scores take."""
    return frame.of(entries, blocks, prices)


def clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def noise_ratio() -> Column:
    return F.when(F.col("current_ctx") > 0, F.col("noise_tokens") / F.col("current_ctx")).otherwise(F.lit(0.0))


def economics(m: DataFrame) -> DataFrame:
    """`m` with cpd (dollars a decision), ttc (whole turns a decision), density, cdr (scope drift)."""
    some = F.col("decisions") > 0
    return m.withColumns({
        "cpd": F.round(F.when(some, F.col("dollars") / F.col("decisions")).otherwise(0.0), 6),
        "ttc": F.when(some, F.floor(F.col("talk") / F.col("decisions"))).otherwise(F.lit(0)).cast("long"),
        "density": F.round(F.when(some & (F.col("talk") > 0), F.col("decisions") / F.col("talk")).otherwise(0.0), 6), "cdr": F.when(some, F.round("drift", 9)).otherwise(0.0),
    })


def decision_economics(m: DataFrame) -> DataFrame:
    """session, decisions, cpd, ttc, density, cdr; see `economics`."""
    return economics(m).select("session", "decisions", "cpd", "ttc", "density", "cdr")


def gauged(m: DataFrame, ctx: float = 75.0, cpd: float = 15.0, ttc: int = 90, cdr: float = 0.35) -> DataFrame:
    """`m` with its economics, gauge, state, action: one point for each value over its limit, with floors and an emergency."""
    rows = economics(m)
    some = F.col("decisions") > 0
    point = lambda c: c.cast("int")
    base = point(F.col("usage_percent") > ctx) + point(F.col("cpd") > cpd) + point(F.col("ttc") > ttc) + point(F.col("cdr") > cdr)
    score = F.when(F.col("usage_percent") > 92, 4).otherwise(base)
    score = F.greatest(score, F.when(some & (F.col("density") < 0.05), 2).otherwise(0), F.when(F.col("cdr") > cdr, 2).otherwise(0), F.when((F.col("compactions") > 0) & ~some, 1).otherwise(0))
    state = F.when(score >= 3, "emergency").when(score == 2, "unstable").when(score == 1, "degrading").otherwise("healthy")
    # The names of states and actions.
    action = F.when(score >= 3, "amputate").when(score == 2, "split or distill").when(score == 1, "clean --all").otherwise("continue")
    return rows.withColumns({"gauge": score.cast("long"), "state": state, "action": action})


def gauge(m: DataFrame, ctx: float = 75.0, cpd: float = 15.0, ttc: int = 90, cdr: float = 0.35) -> DataFrame:
    """session, gauge, state, action; see `gauged`."""
    return gauged(m, ctx, cpd, ttc, cdr).select("session", "gauge", "state", "action")


def cadence_columns() -> dict[str, Column]:
    """What `cadence` tells of a session's facts."""
    ratio, left, since, waste = noise_ratio(), F.col("turns_left"), F.col("since_cleanup"), F.col("noise_tokens")
    near = F.when(left < 0, 0.0).when(left <= 10, 1.0).otherwise(clamp((30 - left) / 20))
    score = F.least(clamp(ratio / 0.30) * 40 + near * 30 + clamp(F.col("growth_rate") / 2000) * 20 + clamp(since / 50) * 10, F.lit(100.0))
    first = F.when(score >= 70, 2).when(score >= 40, 1).otherwise(0)
    second = F.when(ratio > 0.30, 2).when(ratio > 0.15, F.greatest(first, F.lit(1))).otherwise(first)
    third = F.when((left >= 0) & (left < 10) & (waste > 5000), 2).otherwise(second)
    level = F.when((since > 50) & (waste > 10000) & (third == 0), 1).otherwise(third)
    tight = ((left >= 0) & (left < 5)) | (F.col("usage_percent") >= 85) | (F.col("compactions") >= 3)
    # The names of states and actions.
    action = F.when(level == 0, "monitor").when(tight, "export decisions then amputate").when(F.col("biggest") == "tangents", "split tangent range first").otherwise("quick-clean --live")
    status = F.when(level == 2, "overdue").when(level == 1, "due").otherwise("clean")
    return {"score": F.round(score, 9), "status": status, "action": action}


def cadence(m: DataFrame) -> DataFrame:
    """session, score, status, action: how urgent cleaning is."""
    return m.select("session", *[c.alias(n) for n, c in cadence_columns().items()])


def budget_risk(m: DataFrame, limit: float, spent: float) -> DataFrame:
    """session, risk, to_compaction: how near a session and the week's budget are to their ends."""
    left = F.greatest(F.col("turns_left"), F.lit(0))
    share = max(0.0, limit - spent) / limit * 100
    soon = (left > 0) & (left < 10)
    raised = soon.cast("int") + (noise_ratio() > 0.15).cast("int") + int(share < 20)
    risk = F.when(soon & F.lit(share < 10), "critical").when(raised >= 2, "high").when(raised == 1, "medium").otherwise("low")
    return m.select("session", risk.alias("risk"), F.round(F.col("dollars") / F.greatest("talk", F.lit(1)) * left, 6).alias("to_compaction"))


def prune_verdict(m: DataFrame, rows: DataFrame) -> DataFrame:
    """session, verdict: empty, substantive, has-content or throwaway. rows: session, entries, commit_points, bookmarks."""
    j = m.join(rows, "session", "left").na.fill(0)
    verdict = (
        F.when(F.col("entries") <= 2, "empty")
        .when((F.col("compactions") >= 2) | (F.col("commit_points") >= 3) | (F.col("dollars") > 5), "substantive")
        .when((F.col("compactions") > 0) | (F.col("commit_points") > 0) | (F.col("bookmarks") > 0), "has-content")
        .otherwise("throwaway")
    )
    return j.select("session", verdict.alias("verdict"))


def zombie(stats: DataFrame, size: int = 30 * 1024 * 1024, cuts: int = 12) -> DataFrame:
    """session, signals, reason of desktop sessions with two or more of: large file, lost context, many compactions.

    stats: session, starts_queued, bytes, current_ctx, assistant_rows, compactions.
    """
    large, many, none = F.col("bytes") > size, F.col("compactions") > cuts, F.col("current_ctx") == 0
    n = large.cast("int") + (none & (F.col("assistant_rows") > 10)).cast("int") + many.cast("int")
    reason = F.when(large & none, "large file, lost context").when(many & none, "many compactions, lost context").when(large & many, "large file, many compactions").otherwise("too large")
    return stats.filter("starts_queued").withColumn("signals", n.cast("long")).filter("signals >= 2").select("session", "signals", reason.alias("reason"))


def noise_multiplier(m: DataFrame) -> DataFrame:
    """session, multiplier, projected_tokens: noise over context, and what it costs until compaction."""
    return m.select("session", F.round(noise_ratio(), 6).alias("multiplier"), (F.col("noise_tokens") * F.greatest("turns_left", F.lit(0))).alias("projected_tokens"))
