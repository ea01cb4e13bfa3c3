"""Order-sensitive operators on one session at a time: windows over (session, idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import tools

DROP = 50_000
LIMIT = 165_000
WINDOW = 200_000


def by_idx():
    """A session's rows in order."""
    return Window.partitionBy("session").orderBy("idx")


def so_far():
    return by_idx().rowsBetween(Window.unboundedPreceding, 0)


def before():
    return by_idx().rowsBetween(Window.unboundedPreceding, -1)


def detect_compactions(entries: DataFrame, drop: int = DROP) -> DataFrame:
    """session, idx, before_ctx, ctx: assistant rows with usage whose context fell by more than `drop`."""
    used = entries.filter("type = 'assistant' and ctx is not null").select("session", "idx", "ctx", F.lag("ctx").over(by_idx()).alias("before_ctx"))
    return used.filter((F.col("before_ctx") > 0) & (F.col("before_ctx") - F.col("ctx") > drop)).select("session", "idx", "before_ctx", "ctx")


def assign_epochs(entries: DataFrame, drop: int = DROP) -> DataFrame:
    """`entries` with epoch: compactions so far; the compaction row opens the new epoch.

    The context before a row is that of the last assistant row with usage, so one window spec serves all.
    """
    own = F.when(F.col("type") == "assistant", F.col("ctx"))
    seen = entries.withColumn("_before", F.last(own, ignorenulls=True).over(before()))
    compacted = F.coalesce((F.col("_before") > 0) & (F.col("_before") - own > drop), F.lit(False))
    return seen.withColumn("epoch", F.sum(compacted.cast("long")).over(so_far())).drop("_before")


def turn_number(entries: DataFrame) -> DataFrame:
    """session, idx, turn: running count of assistant rows."""
    return entries.select("session", "idx", F.sum((F.col("type") == "assistant").cast("long")).over(so_far()).alias("turn"))


def epoch_turn_bounds(entries: DataFrame, drop: int = DROP) -> DataFrame:
    """session, epoch, first_turn, last_turn; a compaction's own turn closes the earlier epoch."""
    rows = assign_epochs(entries, drop).filter("type = 'assistant'")
    rows = rows.withColumn("turn", F.row_number().over(by_idx()).cast("long"))
    per = rows.groupBy("session", "epoch").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    w = Window.partitionBy("session").orderBy("epoch")
    first = F.when(F.col("epoch") == 0, F.col("lo")).otherwise(F.col("lo") + 1)
    last = F.when(F.lead("epoch").over(w).isNotNull(), F.col("hi") + 1).otherwise(F.col("hi"))
    return per.select("session", "epoch", first.alias("first_turn"), last.alias("last_turn"))


def growth(entries: DataFrame, drop: int = DROP, limit: int = LIMIT) -> DataFrame:
    """session, current_ctx, growth_rate, turns_left (compaction distance), fast_turns_left."""
    rows = assign_epochs(entries, drop).withColumn("last_epoch", F.max("epoch").over(Window.partitionBy("session")))
    used = F.col("ctx").isNotNull()
    here = F.col("epoch") == F.col("last_epoch")
    per = rows.groupBy("session").agg(
        F.max("last_epoch").alias("compactions"),
        F.coalesce(F.max_by("ctx", F.when(used, F.col("idx"))), F.lit(0)).alias("current"),
        F.min_by("ctx", F.when(used & here, F.col("idx"))).alias("start"),
        F.count_if(used & here).alias("uses"),
        F.count_if(F.col("type").isin("user", "assistant")).alias("talk"),
    )
    since = F.col("uses") - 1
    rate = (
        F.when((F.col("compactions") > 0) & (since >= 1), (F.col("current") - F.col("start")) / since)
        .when(F.col("talk") > 0, F.col("current") / F.col("talk"))
        .otherwise(F.lit(0.0))
    )
    average = F.when(F.col("uses") > 0, F.floor(F.col("current") / F.col("uses")))
    room = limit - F.col("current")
    return per.withColumn("growth_rate", rate).select(
        "session", F.col("current").alias("current_ctx"), F.round("growth_rate", 6).alias("growth_rate"),
        distance(F.col("current"), F.col("growth_rate"), limit).alias("turns_left"),
        F.when((average > 0) & (room > 0), F.floor(room / average)).otherwise(F.lit(0)).cast("long").alias("fast_turns_left"),
    )


def distance(ctx: Column, rate: Column, limit: int = LIMIT) -> Column:
    """Turns until compaction: -1 without growth, 0 beyond the limit."""
    return F.when(rate <= 0, -1).when(ctx >= limit, 0).otherwise(F.floor((limit - ctx) / rate)).cast("long")


def branch_rows(entries: DataFrame, gap: str = "30 minutes", drop: int = DROP) -> DataFrame:
    """`entries` with compacted (a compaction opens the row's epoch here) and branch, the branch's number."""
    rows = assign_epochs(entries, drop)
    cut = F.lag("epoch").over(by_idx()) != F.col("epoch")
    quiet = F.col("ts") - F.lag("ts").over(by_idx()) >= F.expr(f"interval {gap}")
    starts = F.coalesce(cut | F.coalesce(quiet, F.lit(False)), F.lit(False))
    return rows.withColumn("compacted", F.coalesce(cut, F.lit(False))).withColumn("branch", F.sum(starts.cast("long")).over(so_far()))


def find_branches(entries: DataFrame, gap: str = "30 minutes", drop: int = DROP) -> DataFrame:
    """session, branch, entries, tokens, user_turns, first_ts, last_ts, paths, has_compaction, is_last.

    A branch starts at a compaction or where two rows in a row lie `gap` or more apart.
    """
    rows = branch_rows(entries, gap, drop)
    per = rows.groupBy("session", "branch").agg(
        F.count("*").alias("entries"), F.sum(F.floor(F.col("raw_size") / 4)).alias("tokens"), F.count_if(F.col("type") == "user").alias("user_turns"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.size(F.array_distinct(F.flatten(F.collect_set(F.transform("refs", lambda r: r["path"]))))).cast("long").alias("paths"), F.bool_or("compacted").alias("has_compaction"),
    )
    return per.withColumn("is_last", F.col("branch") == F.max("branch").over(Window.partitionBy("session")))


def active_cwd(entries: DataFrame) -> DataFrame:
    """session, idx, active_cwd: the last directory so far, before that the session's first."""
    return entries.select("session", "idx", active().alias("active_cwd"))


def session_duration(entries: DataFrame) -> DataFrame:
    """session, seconds from the first row's time to the last row's; 0 with fewer than two rows or without times."""
    per = entries.groupBy("session").agg(F.min_by("ts", "idx").alias("a"), F.max_by("ts", "idx").alias("b"), F.count("*").alias("n"))
    seconds = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1e6
    return per.select("session", F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(seconds, F.lit(0.0))), 3).alias("seconds"))


def spikes(entries: DataFrame, rise: int = 30_000, drop: int = DROP, burst: int = 1) -> DataFrame:
    """session, turn, event, amount: compactions, context spikes and bursts of files not seen before.

    Turns without usage are passed over; the first turn with files makes no burst.
    """
    turns = entries.filter("type = 'assistant'").withColumn("turn", F.row_number().over(by_idx()).cast("long"))
    used = turns.filter("ctx > 0").withColumn("before", F.lag("ctx").over(by_idx()))
    change = F.col("ctx") - F.col("before")
    jumps = used.filter((change > rise) | (-change > drop)).select("session", "turn", F.when(change > 0, "spike").otherwise("compaction").alias("event"), F.abs(change).alias("amount"))
    seen = turns.select("session", "turn", F.explode("refs").alias("r")).groupBy("session", F.col("r.path").alias("path")).agg(F.min("turn").alias("turn"))
    new = seen.groupBy("session", "turn").agg(F.count("*").alias("amount")).withColumn("first", F.min("turn").over(Window.partitionBy("session")))
    bursts = new.filter((F.col("turn") > F.col("first")) & (F.col("amount") >= burst)).select("session", "turn", F.lit("burst").alias("event"), "amount")
    return jumps.unionByName(bursts)


def outside(path: Column, cwd: Column) -> Column:
    """Whether a clean path is neither the directory nor below it."""
    return (path != cwd) & ~path.startswith(F.when(cwd == "/", "/").otherwise(F.concat(cwd, F.lit("/"))))


def active(cwd: str = "cwd") -> Column:
    """The last working directory so far, before that the session's first; null where it has none."""
    known = paths.clean_path(F.expr(f"nullif({cwd}, '')"))
    first = F.first(known, ignorenulls=True).over(by_idx().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(F.last(known, ignorenulls=True).over(so_far()), first)


def scopes(entries: DataFrame) -> DataFrame:
    """`entries` with n_ext, n_home, repos, ext, home, mod, conv: how many paths lie outside and inside the active folder, the outside roots, whether it modifies inside, is conversational.

    Rows without refs have the one call that path and tool tell.
    """
    rows = entries.withColumn("_cwd", active())
    if "refs" not in entries.columns:
        rows = rows.withColumn("refs", F.filter(F.array(F.struct("path", "tool")), lambda r: r["path"].isNotNull()))
    known = F.col("_cwd").isNotNull()
    away = F.filter("refs", lambda r: outside(r["path"], F.col("_cwd")))
    rows = rows.withColumn("_away", F.when(known, away).otherwise(F.slice("refs", 1, 0)))
    rows = rows.withColumns({
        "n_ext": F.size("_away"), "n_home": F.when(known, F.size("refs") - F.size("_away")).otherwise(0), "repos": F.array_distinct(F.transform("_away", lambda r: paths.external_root(r["path"], F.col("_cwd")))),
        "mod": known & F.exists("refs", lambda r: r["tool"].isin(*tools.MODIFYING) & ~outside(r["path"], F.col("_cwd"))), "conv": F.col("type").isin("user", "assistant"),
    })
    return rows.withColumns({"ext": F.col("n_ext") > 0, "home": F.col("n_home") > 0}).drop("_away")


def tangent_marks(entries: DataFrame, rows: int = 2, tokens: int = 100) -> DataFrame:
    """`entries` with their scopes and out-of-scope islands.

    A breaker modifies in scope, is in scope only, or is a conversational row without paths after one without
    outside paths. Between breakers an island runs from the first row that starts one; a row of both scopes starts
    none, but goes on with one, and counts by its share. island and drift_island (where such a row may start one)
    are null outside; tangent holds for islands of at least `rows` rows and `tokens` tokens.
    """
    r = scopes(entries)
    earlier = F.coalesce(F.last(F.when(F.col("conv"), F.col("ext")), ignorenulls=True).over(before()), F.lit(False))
    plain = F.col("conv") & ~F.col("ext") & ~F.col("home")
    breaker = F.col("mod") | (F.col("home") & ~F.col("ext")) | (plain & ~earlier)
    start = F.col("ext") & ~F.col("mod")
    t = F.floor(F.col("raw_size") / 4)
    r = r.withColumns({"_breaker": breaker, "_start": start})
    at = lambda c: F.coalesce(F.max(F.when(c, F.col("idx"))).over(so_far()), F.lit(-1))
    r = r.withColumns({"_cut": at(F.col("_breaker")), "_pure": at(F.col("_start") & ~F.col("home")), "_any": at(F.col("_start"))})
    live = lambda c: F.when(~F.col("_breaker") & (F.col(c) > F.col("_cut")), F.col("_cut"))
    mixed = F.col("ext") & F.col("home")
    r = r.withColumns({
        "island": live("_pure"), "drift_island": live("_any"),
        "tangent_tokens": F.when(mixed, F.floor(t * F.round(F.col("n_ext") / (F.col("n_ext") + F.col("n_home")), 12))).otherwise(t),
    })
    whole = Window.partitionBy("session", "_cut")
    on = F.col("island").isNotNull()
    r = r.withColumns({"_rows": F.count_if(on).over(whole), "_tokens": F.sum(F.when(on, F.col("tangent_tokens"))).over(whole)})
    return r.withColumn("tangent", on & (F.col("_rows") >= rows) & (F.col("_tokens") >= tokens)).drop("_breaker", "_start", "_cut", "_pure", "_any", "_rows", "_tokens", "_cwd")


def tangent_rows(entries: DataFrame, mixed_may_start: bool = False) -> DataFrame:
    """Rows of out-of-scope islands with their island's number; see `tangent_marks`."""
    rows = tangent_marks(entries)
    return rows.withColumn("island", F.col("drift_island" if mixed_may_start else "island")).filter("island is not null")


def find_tangents(entries: DataFrame, rows: int = 2, tokens: int = 100, mixed_may_start: bool = False) -> DataFrame:
    """session, first_idx, last_idx, entries, tokens, mixed, roots of each island of at least `rows` rows and `tokens` tokens; mixed counts its rows of both scopes, roots the outside folders."""
    per = tangent_rows(entries, mixed_may_start).groupBy("session", "island").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("entries"), F.sum("tangent_tokens").alias("tokens"),
        F.count_if(F.col("ext") & F.col("home")).alias("mixed"), F.size(F.array_distinct(F.flatten(F.collect_set("repos")))).cast("long").alias("roots"),
    )
    return per.filter((F.col("entries") >= rows) & (F.col("tokens") >= tokens)).drop("island")
