"""Operators across sessions: repeated reads, pairs of sessions, and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dealt, written
from . import cost, noise, tools


def file_stats(entries: DataFrame, n: int = 12) -> DataFrame:
    """path, touches, sessions of the `n` files touched most; ties by sessions, then path."""
    per = cost.touched(entries, "session").groupBy("path").agg(F.count("*").alias("touches"), F.count_distinct("session").alias("sessions"))
    return per.orderBy(F.desc("touches"), F.desc("sessions"), "path").limit(n)


def first_reads(blocks: DataFrame) -> DataFrame:
    """session, path, tokens of the first read of each path in each session."""
    reads = blocks.filter("kind = 'tool_use'").filter(F.col("name").isin(*noise.READS))
    return reads.groupBy("session", "path").agg(F.min_by(noise.tokens(), "idx").alias("tokens"))


def continuity_files(blocks: DataFrame, rate: float = 0.75) -> DataFrame:
    """path, sessions, tokens, dollars: what sessions after the cheapest spend to read a file again."""
    per = first_reads(blocks).groupBy("path").agg(F.count("*").alias("sessions"), F.sum("tokens").alias("s"), F.min("tokens").alias("m"))
    return per.filter("sessions >= 2").select("path", "sessions", (F.col("s") - F.col("m")).alias("tokens"), F.round((F.col("s") - F.col("m")) * rate / 1e6, 9).alias("dollars"))


def repeat_topics(blocks: DataFrame, least: int = 3) -> DataFrame:
    """a, b, sessions: pairs of files read together in at least `least` sessions.

    Pairs are made inside one session's set of files, bounded by the files it reads, and counted by partial sums.
    """
    sets = first_reads(blocks).groupBy("session").agg(F.array_sort(F.collect_set("path")).alias("files"))
    first = sets.select(F.posexplode("files").alias("i", "a"), "files")
    pairs = first.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("sessions")).filter(F.col("sessions") >= least)


def file_touch_edges(entries: DataFrame, least: int = 2, max_sessions: int | None = None) -> DataFrame:
    """path, sessions, touches of files that several sessions touch at least `least` times each.

    The hub form of session pairs: a file with n sessions stands for its n (n - 1) / 2 pairs.
    """
    per = cost.touched(entries, "session").groupBy("path", "session").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    hubs = per.groupBy("path").agg(F.count("*").alias("sessions"), F.sum("n").alias("touches")).filter("sessions >= 2")
    return hubs if max_sessions is None else hubs.filter(F.col("sessions") <= max_sessions)


def temporal_edges(entries: DataFrame) -> DataFrame:
    """session, next_session, gap_seconds: sessions of one project, each with the next by start, at most a day apart."""
    per = entries.groupBy("project", "session").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    w = Window.partitionBy("project").orderBy("a", "session")
    pairs = per.withColumn("next_session", F.lead("session").over(w)).withColumn("next_a", F.lead("a").over(w)).filter("next_session is not null")
    gap = F.greatest(F.unix_seconds(F.date_trunc("second", "next_a")) - F.unix_seconds(F.date_trunc("second", "b")), F.lit(0))
    return pairs.withColumn("gap_seconds", gap).filter("gap_seconds <= 86400").select("session", "next_session", "gap_seconds")


def file_lineage(entries: DataFrame, suffix: str) -> DataFrame:
    """session, idx, action, path of every touch of paths that end in a part."""
    hit = (F.col("path") == suffix) | F.col("path").endswith("/" + suffix)
    return cost.touched(entries, "session", "idx").filter(hit).select("session", "idx", tools.action(F.col("tool")).alias("action"), "path")


def commit_session_join(sessions: DataFrame, commits: DataFrame, minutes: int = 30) -> DataFrame:
    """session, commits, lines: commits of a project within [created, modified + minutes], by day buckets and running totals.

    sessions: session, project, created, modified; commits: project, ts, whole lines. A session's commits are those up to
    its end less those before its start: totals of the days before, and a running count in the day itself. So a row
    a commit and two a session are sorted, however long sessions are and however many commits they share.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = sessions.select("session", "project", micros("created").alias("a"), (micros("modified") + minutes * 60_000_000).alias("b")).filter("a <= b and project is not null")
    # At one instant a start comes before the commits and an end after them.
    bounds = F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(kind).alias("kind")) for c, kind in (("a", 0), ("b", 2))])).alias("p")
    ends = spans.select("session", "project", bounds).select("session", "project", "p.*", F.lit(None).cast("long").alias("lines"))
    made = commits.select(F.lit(None).cast(sessions.schema["session"].dataType).alias("session"), "project", micros("ts").alias("at"), F.lit(1).alias("kind"), F.col("lines").cast("long").alias("lines"))
    points = ends.union(made.filter("at is not null and project is not null")).withColumn("day", F.expr("at div 86400000000")).repartition("project", "day")
    counts = {"n": F.sum((F.col("kind") == 1).cast("long")), "known": F.count("lines"), "added": F.sum(F.coalesce("lines", F.lit(0)))}
    inside = Window.partitionBy("project", "day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("project").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = points.groupBy("project", "day").agg(*[c.alias(k) for k, c in counts.items()])
    days = days.select("project", "day", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in counts])
    rows = points.withColumns({k: c.over(inside) for k, c in counts.items()}).filter("kind <> 1").join(days.hint("merge"), ["project", "day"])
    sign = F.col("kind") - 1
    per = rows.groupBy("session").agg(*[F.sum(sign * (F.col(k) + F.col(f"{k}_before"))).alias(k) for k in counts]).filter("n > 0")
    return per.select("session", F.col("n").alias("commits"), F.when(F.col("known") > 0, F.col("added")).alias("lines"))


def efficiency(sessions: DataFrame, commits: DataFrame, n: int = 5, minutes: int = 30) -> DataFrame:
    """kind, session, commits, lines, per_1k: the `n` sessions with most lines for 1000 tokens, and those without commits.

    sessions: session, project, created, modified, tokens.
    """
    hits = commit_session_join(sessions, commits, minutes)
    rows = sessions.select("session", "tokens").join(hits.hint("merge"), "session", "left").na.fill(0, ["commits", "lines"])
    rows = rows.withColumn("per_1k", F.round(F.col("lines") * 1000.0 / F.greatest("tokens", F.lit(1)), 6))
    best = rows.filter("commits > 0").orderBy(F.desc("per_1k"), "session").limit(n).withColumn("kind", F.lit("efficient"))
    sinks = rows.filter("commits = 0 and tokens > 10000").orderBy(F.desc("tokens"), "session").limit(n).withColumn("kind", F.lit("sink"))
    return best.unionByName(sinks).select("kind", "session", "commits", "lines", "per_1k")


def productivity(sessions: DataFrame, commits: DataFrame, minutes: int = 30) -> DataFrame:
    """project, sessions, commits, dollars, per_commit, hours: cost of commits by project; hours are 0.01 at least."""
    hits = commit_session_join(sessions, commits, minutes)
    hours = F.greatest((F.unix_seconds(F.col("modified").cast("timestamp")) - F.unix_seconds(F.col("created").cast("timestamp"))) / 3600.0, F.lit(0.01))
    rows = sessions.withColumn("h", hours).join(hits.hint("merge"), "session", "left").na.fill(0, ["commits"])
    per = rows.groupBy("project").agg(F.count("*").alias("sessions"), F.sum("commits").alias("commits"), F.sum(F.col("dollars").cast("decimal(20,4)")).cast("double").alias("d"), F.round(F.sum(F.col("h").cast("decimal(20,4)")).cast("double"), 4).alias("hours"))
    return per.select("project", "sessions", "commits", F.round("d", 4).alias("dollars"), F.round(F.when(F.col("commits") > 0, F.col("d") / F.col("commits")), 6).alias("per_commit"), "hours")


def _folders(path: Column) -> Column:
    """A path and every folder above it, as an array."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda x: x != "")


def _scope(path: Column) -> Column:
    """The parent folder of a path; the path itself where that is the root or nothing."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(folder.isin("", "."), path).otherwise(folder)


def blocked(left: DataFrame, right: DataFrame, key: list[str], parts: int = 8, rows: int = 100_000, hub: int = 250) -> DataFrame:
    """All pairs of `left` and `right` with one `key`, of which each side may have very many rows.

    A key's rows of `right` become lists of about `hub`, its rows of `left` fall into `parts`, or more, of `rows` at most on
    average, and each list meets each part: so a key's pairs are made by many tasks in bounded memory, after the last
    exchange. What is dealt is each row of `left` once and of `right` once a part. A list comes again for each row of
    `left`, in order, which files of the pairs compress well.
    """
    of = [c for c in right.columns if c not in key]
    size = lambda df, n, least: df.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / n), F.lit(least).cast("long")).alias("_n"))
    place = lambda df: F.pmod(F.xxhash64(*df.columns), F.col("_n"))
    lists = right.join(size(right, hub, 1), key).withColumn("_hub", place(right)).groupBy(*key, "_hub").agg(F.array_sort(F.collect_list(F.struct(*of))).alias("_list"))
    n = size(left, rows, parts)
    lists = lists.join(n, key).select(*key, "_list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_part"))
    own = left.join(n, key).withColumn("_part", place(left)).drop("_n")
    pairs = dealt(lists, *key, "_part").join(dealt(own, *key, "_part").hint("merge"), [*key, "_part"])
    return pairs.withColumn("_one", F.explode("_list")).select(*left.columns, *[F.col("_one")[c].alias(c) for c in of])


def decision_conflicts(points: DataFrame, touches: DataFrame) -> DataFrame:
    """point_session, session, scope, severity: later sessions that work where an earlier session has decided.

    points: session, ts, path (a file of the decision), and perhaps constrained; touches: session, ts, path, and
    perhaps deleted. Scopes are parent folders and hold all paths below them: ancestors are exploded, so the prefix
    test is an equality.

    - warning: a path in the scope is touched, and no scope of the session's own decisions is, holds or lies in it
    - info: a path in the scope of a constrained decision is touched
    - alert: a file of the decision is deleted; `scope` is that file
    """
    constrained = F.col("constrained") if "constrained" in points.columns else F.lit(False)
    decided = points.select(F.col("session").alias("point_session"), "ts", _scope(F.col("path")).alias("scope"), F.when(constrained, F.col("ts")).alias("ts_c"))
    decided = written(decided.groupBy("point_session", "scope").agg(F.min("ts").alias("at"), F.min("ts_c").alias("at_c")), "decided")
    first = touches.groupBy("session", "path").agg(F.min("ts").alias("ts")).select("session", F.explode(_folders(F.col("path"))).alias("scope"), "ts")
    first = first.groupBy("session", "scope").agg(F.min("ts").alias("first"))
    first = written(first.join(decided.select("scope").distinct(), "scope", "left_semi").select("scope", "first", "session"), "first")

    own = decided.select(F.col("point_session").alias("session"), F.col("scope").alias("own"))
    within = own.select("session", F.explode(_folders(F.col("own"))).alias("scope"))
    above = first.select("session", "scope").withColumn("own", F.explode(_folders(F.col("scope")))).join(own, ["session", "own"], "left_semi")
    known = within.union(above.select("session", "scope")).distinct()

    # Pairs grow with the square of the log, so sessions that know a scope go before any are made.
    free = first.join(known, ["session", "scope"], "left_anti").select(*first.columns)

    def found(held: DataFrame, met: DataFrame, severity: str) -> DataFrame:
        pairs = blocked(held, met, ["scope"]).filter((F.col("session") != F.col("point_session")) & (F.col("first") > F.col("at")))
        return pairs.select("point_session", "session", "scope", F.lit(severity).alias("severity"))

    out = found(decided.select("point_session", "scope", "at"), free, "warning")
    if "constrained" in points.columns:
        out = out.union(found(decided.filter("at_c is not null").select("point_session", "scope", F.col("at_c").alias("at")), first, "info"))
    if "deleted" in touches.columns:
        files = points.groupBy(F.col("session").alias("point_session"), F.col("path").alias("scope")).agg(F.min("ts").alias("at"))
        gone = touches.filter("deleted").groupBy("session", F.col("path").alias("scope")).agg(F.min("ts").alias("first"))
        out = out.union(found(files, gone, "alert"))
    return out


def continuity_index(blocks: DataFrame) -> DataFrame:
    """files, reads, score: the share of reads over all sessions that were of files not read before, times 100."""
    reads = first_reads(blocks)
    return reads.agg(F.count_distinct("path").alias("files"), F.count("*").alias("reads")).withColumn("score", F.round(F.when(F.col("reads") > 0, F.col("files") * 100.0 / F.col("reads")).otherwise(100.0), 6))


def alias_edges(sessions: DataFrame) -> DataFrame:
    """project, sessions, pairs, first_session: the hub form of all pairs of sessions of one project."""
    per = sessions.filter("project is not null").groupBy("project").agg(F.count("*").alias("sessions"), F.min("session").alias("first_session"))
    return per.filter("sessions > 1").select("project", "sessions", F.floor(F.col("sessions") * (F.col("sessions") - 1) / 2).alias("pairs"), "first_session")


def savings_summary(events: DataFrame, n: int = 3) -> DataFrame:
    """session, events, tokens, avoided, rank of the sessions that saved most. events: session, tokens, avoided."""
    per = events.groupBy("session").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.sum("avoided").alias("avoided"))
    return per.orderBy(F.desc("avoided"), "session").limit(n)


def snapshot_summary(snapshots: DataFrame) -> DataFrame:
    """model, snapshots, dollars, share of a snapshot log (model, dollars)."""
    per = snapshots.groupBy("model").agg(F.count("*").alias("snapshots"), F.sum(F.col("dollars").cast("decimal(20,4)")).cast("double").alias("d"))
    total = per.agg(F.sum("snapshots").alias("all"))
    return per.crossJoin(F.broadcast(total)).select("model", "snapshots", F.round("d", 4).alias("dollars"), F.round(F.col("snapshots") / F.col("all"), 6).alias("share"))
