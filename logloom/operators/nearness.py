"""Sessions of a project that lie within a day of each other, counted without their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 24 * 3600 * 1_000_000


def _ranked(marks: DataFrame, asked: DataFrame, strict: bool) -> DataFrame:
    """`asked` (project, session, t) with n: how many `marks` (project, t) lie at t or before, with `strict` before it.

    Marks are counted by day first, so a task sorts one day of one project and a project's days are few.
    """
    day = F.floor(F.col("t") / DAY)
    rows = marks.select("project", F.lit(None).cast("string").alias("session"), "t", F.lit(1).alias("mark")).unionByName(asked.select("project", "session", "t", F.lit(0).alias("mark"))).withColumn("day", day)
    days = rows.groupBy("project", "day").agg(F.sum("mark").alias("of_day"))
    before = F.sum("of_day").over(Window.partitionBy("project").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("project", "day", F.coalesce(before, F.lit(0)).alias("base"))
    w = Window.partitionBy("project", "day").orderBy("t").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = rows.withColumn("own", F.coalesce(F.sum("mark").over(w), F.lit(0))).filter("mark = 0")
    return rows.join(days, ["project", "day"]).select("project", "session", (F.col("base") + F.col("own")).alias("n"))


def temporal_classes(entries: DataFrame) -> DataFrame:
    """project, session, starts_before, ends_at, reach, passed, links: a session's place among those of its project.

    Two sessions link when at most a day lies between the end of one and the start of the other; overlapping ones do.
    reach counts the sessions that start up to a day after its end, passed those that end over a day before its start,
    so links = reach - passed - 1, itself left out. A pair links just where the other's starts_before < reach and its
    ends_at > passed, where ends_at counts the ends up to its own: no link is lost, and no pair is written. Rows
    without time or project are passed over.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    per = entries.filter("ts is not null and project is not null").groupBy("project", "session").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("project", "session", micros("a").alias("a"), micros("b").alias("b"))
    starts, ends = per.select("project", F.col("a").alias("t")), per.select("project", F.col("b").alias("t"))
    at = lambda t: per.select("project", "session", t.alias("t"))

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumnRenamed("n", name)

    parts = [
        named(_ranked(starts, at(F.col("a")), True), "starts_before"), named(_ranked(ends, at(F.col("b")), False), "ends_at"),
        named(_ranked(starts, at(F.col("b") + DAY), False), "reach"), named(_ranked(ends, at(F.col("a") - DAY), True), "passed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["project", "session"])
    return out.withColumn("links", F.col("reach") - F.col("passed") - 1)


def linked(own: dict[str, Column], other: dict[str, Column]) -> Column:
    """Whether two rows of `temporal_classes` of one project link."""
    return (other["starts_before"] < own["reach"]) & (other["ends_at"] > own["passed"])
