"""Budgets of projects and billing weeks over a sessions table (session, project, created, modified, dollars)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _week(column: str, anchor: str):
    return F.floor(F.datediff(F.col(column), F.lit(anchor).cast("date")) / 7)


def billing_week(rows: DataFrame, column: str, anchor: str) -> DataFrame:
    """session, week, week_start: seven-day weeks from an anchor day, before it too."""
    week = _week(column, anchor)
    return rows.select("session", week.alias("week"), F.date_add(F.lit(anchor).cast("date"), (week * 7).cast("int")).alias("week_start"))


def weekly_usage(sessions: DataFrame, anchor: str, limit: float) -> DataFrame:
    """week_start, sessions, dollars, remaining, largest_share of each billing week."""
    per = sessions.groupBy(_week("modified", anchor).alias("week")).agg(F.count("*").alias("sessions"), F.sum("dollars").alias("d"), F.max("dollars").alias("m"))
    start = F.date_add(F.lit(anchor).cast("date"), (F.col("week") * 7).cast("int"))
    return per.select(start.alias("week_start"), "sessions", F.round("d", 2).alias("dollars"), F.round(limit - F.col("d"), 2).alias("remaining"), F.round(F.col("m") / F.col("d"), 6).alias("largest_share"))


def repo_budget(sessions: DataFrame) -> DataFrame:
    """project, sessions, dollars, per_session, rank; one row a project reaches the ranking."""
    per = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.round(F.sum("dollars"), 2).alias("dollars"), F.round(F.avg("dollars"), 2).alias("per_session"))
    return per.withColumn("rank", F.rank().over(Window.orderBy(F.desc("dollars"))).cast("long"))


def latest_n(sessions: DataFrame, n: int) -> DataFrame:
    """session, project, created: the newest `n` of each project, ties by session."""
    ranked = sessions.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created"), "session")))
    return ranked.filter(F.col("r") <= n).select("session", "project", "created")


def cost_alert(sessions: DataFrame, threshold: float) -> DataFrame:
    """session, dollars at or over a threshold above zero."""
    return sessions.filter((F.lit(threshold) > 0) & (F.col("dollars") >= threshold)).select("session", "dollars")


def cost_rollup(sessions: DataFrame) -> DataFrame:
    """project, year, sessions, dollars with subtotals."""
    return sessions.rollup("project", F.year("created").alias("year")).agg(F.count("*").alias("sessions"), F.round(F.sum("dollars"), 2).alias("dollars"))


def high_daily(sessions: DataFrame, over: float) -> DataFrame:
    """day, sessions, high: sessions of each day, and those dearer than `over`."""
    return sessions.groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("sessions"), F.count_if(F.col("dollars") > over).alias("high"))
