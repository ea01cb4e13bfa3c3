"""Fixpoints over the parent links of sessions: walks by pointer doubling, closures by frontiers.

Most rows follow their parent at once, so cascades and walks double pointers between runs of such rows and not between
rows. Each round is a join on a narrow table that is written to the shared folder, so lost executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _cut(df: DataFrame) -> DataFrame:
    """`df` written to the session's shared folder, and never broadcast; a checkpoint would compute it twice."""
    return written(df, "cut")


def ancestors(links: DataFrame) -> DataFrame:
    """session, uuid, top, steps, looped: the end of each row's chain of parents, and how far it is.

    links: session, uuid, parent_uuid, one row a uuid. The end is the first row without a parent, or the first
    whose parent is not there. Chains double their reach each round; what still moves after as many rounds as
    the longest session needs is on or behind a cycle.
    """
    known = links.select("session", F.col("uuid").alias("parent_uuid"), F.lit(True).alias("there"))
    rows = links.join(known, ["session", "parent_uuid"], "left")
    rows = rows.select("session", "uuid", F.when(F.col("there"), F.col("parent_uuid")).otherwise(F.col("uuid")).alias("top"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"))
    rows = _cut(rows.withColumn("looped", F.col("steps") > 0))
    longest = links.groupBy("session").count().agg(F.max("count")).first()[0] or 1
    for _ in range(int(longest).bit_length() + 1):
        if not rows.filter("looped").limit(1).count():
            break
        ends = rows.select("session", F.col("uuid").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"))
        joined = rows.join(ends, ["session", "top"])
        rows = _cut(joined.select("session", "uuid", F.col("next").alias("top"), F.least(F.col("steps") + F.col("more"), F.lit(1 << 60)).alias("steps"), (F.col("more") > 0).alias("looped")))
    return rows


def last_by_uuid(entries: DataFrame) -> DataFrame:
    """session, uuid, parent_uuid, idx, type: one row a uuid, the last one."""
    w = Window.partitionBy("session", "uuid").orderBy(F.desc("idx"))
    return entries.filter("uuid is not null").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("session", "uuid", "parent_uuid", "idx", "type")


def chain_integrity(entries: DataFrame) -> DataFrame:
    """session, length, broken, starts_with_assistant of the chain that ends in the session's last row."""
    links = last_by_uuid(entries)
    ends = links.groupBy("session").agg(F.max_by("uuid", "idx").alias("uuid"))
    walk = ancestors(links.select("session", "uuid", "parent_uuid")).join(ends, ["session", "uuid"])
    first = links.select("session", F.col("uuid").alias("top"), F.col("parent_uuid").alias("beyond"), "type")
    out = walk.join(first, ["session", "top"])
    return out.select("session", (F.col("steps") + 1).alias("length"), F.col("beyond").isNotNull().alias("broken"), (F.col("type") == "assistant").alias("starts_with_assistant"))


def in_runs(links: DataFrame) -> DataFrame:
    """`links` (session, uuid, parent_uuid, idx, one row a uuid) with n, the row's place in its session, and run, the place where its run starts.

    A row whose parent is the row just before it goes on with that row's run, so of a run only the first row's parent is to be looked for.
    """
    w = Window.partitionBy("session").orderBy("idx", "uuid")
    follows = F.coalesce(F.col("parent_uuid") == F.lag("uuid").over(w), F.lit(False))
    rows = links.withColumns({"_follows": follows, "n": F.row_number().over(w).cast("long")})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.max(F.when(~F.col("_follows"), F.col("n"))).over(so_far)).drop("_follows")


def run_edges(rows: DataFrame) -> DataFrame:
    """session, run, up_run, up_n of the runs of `rows` (see `in_runs`) whose first row has its parent among them: that parent's run and place."""
    up = rows.select("session", F.col("uuid").alias("parent_uuid"), F.col("run").alias("up_run"), F.col("n").alias("up_n"))
    heads = rows.filter("n = run and parent_uuid is not null").select("session", "run", "parent_uuid")
    return heads.join(up, ["session", "parent_uuid"]).select("session", "run", "up_run", "up_n")


def rounds_of(edges: DataFrame) -> int:
    """Rounds in which doubled pointers reach along all `edges` of a session; 0 without any."""
    return int(edges.groupBy("session").count().agg(F.max("count")).first()[0] or 0).bit_length()


def _fallen(at: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """`at` (session, run, n: all of the run from n on goes) and the runs that hang on what goes, directly or not.

    Pointers double each round; a run is done when its pointer has met a place that goes or has ended.
    """
    if not rounds:
        return at
    met = F.coalesce(F.col("up_n") >= F.col("n"), F.lit(False))
    start = edges.join(at.select("session", F.col("run").alias("up_run"), "n"), ["session", "up_run"], "left")
    rows = _cut(start.select("session", "run", F.when(~met, F.col("up_run")).alias("up"), met.alias("gone")))
    for _ in range(rounds):
        if rows.filter("up is not null").isEmpty():
            break
        ahead = rows.select("session", F.col("run").alias("up"), F.col("up").alias("next"), F.col("gone").alias("met"))
        hit = F.coalesce("met", F.lit(False))
        rows = _cut(rows.join(ahead, ["session", "up"], "left").select("session", "run", F.when(~hit, F.col("next")).alias("up"), (F.col("gone") | hit).alias("gone")))
    return at.unionByName(rows.filter("gone").select("session", "run", F.col("run").alias("n"))).groupBy("session", "run").agg(F.min("n").alias("n"))


def cascade(entries: DataFrame, results: DataFrame, seeds: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """session, uuid of all rows that go with `seeds` (session, uuid): children of any, result owners of calls.

    results: session, uuid (of the owner), call_uuid. Rows of `keep` stay and stop the cascade. It goes to any depth:
    a run goes from its first lost row on, runs below are found by doubling pointers, and only a call that went above
    an owner that did not asks for another turn. Of rows with one uuid the last counts.
    """
    links = last_by_uuid(entries).select("session", "uuid", "parent_uuid", "idx")
    kept = keep.select("session", "uuid").distinct() if keep is not None else None
    if kept is not None:
        links = links.join(kept.withColumn("kept", F.lit(True)), ["session", "uuid"], "left").select("session", "uuid", F.when(F.col("kept").isNull(), F.col("parent_uuid")).alias("parent_uuid"), "idx")
        seeds = seeds.join(kept, ["session", "uuid"], "left_anti")
        results = results.join(kept, ["session", "uuid"], "left_anti")
    seeds = _cut(seeds.select("session", "uuid").distinct())
    unseen = seeds.join(links, ["session", "uuid"], "left_anti").withColumns({c: F.lit(None).cast(links.schema[c].dataType) for c in ("parent_uuid", "idx")})
    rows = _cut(in_runs(links.unionByName(unseen)))
    edges = _cut(run_edges(rows))
    rounds = rounds_of(edges)
    places = rows.select("session", "uuid", "run", "n")
    calls = places.select("session", F.col("uuid").alias("call_uuid"), F.col("run").alias("call_run"), F.col("n").alias("call_n"))
    owners = results.select("session", "uuid", "call_uuid").join(places, ["session", "uuid"]).join(calls, ["session", "call_uuid"])
    owners = _cut(owners.select("session", "run", "n", "call_run", "call_n").distinct())
    at = places.join(seeds, ["session", "uuid"], "left_semi").groupBy("session", "run").agg(F.min("n").alias("n"))
    while True:
        at = _cut(_fallen(at, edges, rounds))
        lost = owners.join(at.select("session", F.col("run").alias("call_run"), F.col("n").alias("_from")), ["session", "call_run"]).filter("call_n >= _from").groupBy("session", "run").agg(F.min("n").alias("n"))
        lost = lost.join(at.select("session", "run", F.col("n").alias("_known")), ["session", "run"], "left").filter("_known is null or n < _known").drop("_known")
        more = _cut(lost)
        if more.isEmpty():
            return rows.join(at.withColumnRenamed("n", "_from"), ["session", "run"]).filter("n >= _from").select("session", "uuid")
        at = at.unionByName(more).groupBy("session", "run").agg(F.min("n").alias("n"))


def targets(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """session, parent_uuid, target, was_gone: for each row of `gone` (session, uuid) its nearest ancestor that stays, null if there is none."""
    links = last_by_uuid(entries).select("session", "uuid", "parent_uuid", "idx")
    rows = _cut(in_runs(links.join(gone.select("session", "uuid").distinct(), ["session", "uuid"], "left_semi")))
    heads = rows.filter("n = run").select("session", "run", "parent_uuid")
    chain = heads.join(run_edges(rows), ["session", "run"], "left").select("session", F.col("run").alias("uuid"), F.col("up_run").alias("parent_uuid"))
    tops = ancestors(_cut(chain)).filter("not looped").select("session", F.col("uuid").alias("run"), "top")
    final = tops.join(heads.select("session", F.col("run").alias("top"), F.col("parent_uuid").alias("target")), ["session", "top"]).select("session", "run", "target")
    return rows.join(final, ["session", "run"], "left").select("session", F.col("uuid").alias("parent_uuid"), "target", F.lit(True).alias("was_gone"))


def repoint(rows: DataFrame, to: DataFrame) -> DataFrame:
    """`rows` whose removed parents are replaced (see `targets`); every row stays once, also without or with a shared uuid."""
    out = rows.join(to, ["session", "parent_uuid"], "left").withColumn("parent_uuid", F.when(F.col("was_gone"), F.col("target")).otherwise(F.col("parent_uuid")))
    return out.select(*rows.columns)


def resolve_parents(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """session, uuid, parent_uuid of the rows that stay, re-pointed to their nearest ancestor that stays.

    A parent that is not there is kept as it is; a chain that ends in a removed row gives null.
    """
    kept = entries.join(gone.select("session", "uuid"), ["session", "uuid"], "left_anti").select("session", "uuid", "parent_uuid")
    return repoint(kept, targets(entries, gone))
