"""Session views that stand on other operators: summaries, lists, purity, search space, edges, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from . import cost, cross, frame, graphops, noise, scoring, sequence, tools

# Parts of a command, in the order in which they are tried, and the share of its output that could go.
COMMAND_KINDS = {
    "git_output": (0.70, ("git status", "git diff", "git log", "git show", "git branch")),
    "file_listing": (0.60, ("ls ", "ls\n", "find ", "tree ", "tree\n")),
    "test_output": (0.65, ("go test", "pytest", "npm test", "jest", "cargo test", "make test")),
    "lint_output": (0.55, ("golangci-lint", "eslint", "ruff ", "pylint", "clippy")),
    "build_output": (0.50, ("go build", "make ", "npm run build", "cargo build", "gcc ", "g++ ")),
}
LARGE, LARGE_SHARE = 2000, 0.30


def tool_class_pred(entries: DataFrame) -> DataFrame:
    """session, class, calls: tool calls by every class that holds the tool."""
    rows = cost.used_tools(entries, "session")
    return rows.join(F.broadcast(tools.tool_class(entries.sparkSession)), "tool").groupBy("session", "class").agg(F.count("*").alias("calls"))


def command_paths(blocks: DataFrame) -> DataFrame:
    """session, idx, path of every absolute path in shell commands that is no system path."""
    rows = blocks.filter(F.col("name").isin(*tools.BASH) & F.col("command").isNotNull())
    return rows.select("session", "idx", F.explode(paths.bash_paths(F.col("command"))).alias("path"))


def distinct_tools(entries: DataFrame) -> DataFrame:
    """session, tools: how many tools closed epochs use."""
    rows = sequence.assign_epochs(entries).withColumn("last", F.max("epoch").over(Window.partitionBy("session")))
    return rows.groupBy("session").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("epoch") < F.col("last"), F.col("tools")))))).cast("long").alias("tools"))


def cache_read_cost(entries: DataFrame, rate: float = cost.DEFAULT_PRICE["p_read"]) -> DataFrame:
    """session, dollars: cache-read tokens at a rate for a million; nothing for none."""
    per = entries.groupBy("session").agg(F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).alias("n"))
    return per.select("session", F.round(F.greatest("n", F.lit(0)) / 1e6 * rate, 9).alias("dollars"))


def input_purity(blocks: DataFrame) -> DataFrame:
    """session, tokens, compressible, score: how much of the tool results could have been left out.

    Results of native tools count nothing, those of a known kind of command its share, other large ones LARGE_SHARE,
    cut to whole tokens a result. A result without a known call is judged by its size alone.
    """
    calls = blocks.filter("kind = 'tool_use'").groupBy("session", F.col("id").alias("tool_use_id")).agg(F.max_by("name", "idx").alias("used"), F.max_by("command", "idx").alias("typed"))
    rows = blocks.filter("kind = 'tool_result'").select("session", "tool_use_id", noise.tokens().alias("t")).filter("t > 0").join(calls, ["session", "tool_use_id"], "left")
    part = F.when(F.col("t") > LARGE, LARGE_SHARE).otherwise(0.0)
    typed = F.lower("typed")
    for share, marks in reversed(COMMAND_KINDS.values()):
        hit = F.lit(False)
        for m in marks:
            hit = hit | typed.contains(m)
        part = F.when(F.col("used").isin(*tools.BASH) & hit, share).otherwise(part)
    part = F.when(F.col("used").isin(*tools.NATIVE), 0.0).otherwise(part)
    per = rows.groupBy("session").agg(F.sum("t").alias("tokens"), F.sum(F.floor(F.col("t") * part)).alias("compressible"))
    return per.withColumn("score", F.round(F.greatest((1 - F.col("compressible") / F.col("tokens")) * 100, F.lit(0.0)), 6))


def branch_costs(entries: DataFrame, prices: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """session, branch, entries, dollars, repo: branches with their cost and the outside folder they touch most (ties by name)."""
    rows = sequence.branch_rows(entries, gap)
    spent = cost.turn_costs(rows, prices).groupBy("session", "branch").agg(F.round(cost.total().cast("double"), 9).alias("dollars"))
    per = rows.groupBy("session", "branch").agg(F.count("*").alias("entries"))
    away = sequence.scopes(rows).select("session", "branch", F.explode("repos").alias("repo")).groupBy("session", "branch", "repo").agg(F.count("*").alias("n"))
    best = away.groupBy("session", "branch").agg(F.min_by("repo", F.struct(-F.col("n"), F.col("repo"))).alias("repo"))
    out = per.join(spent, ["session", "branch"], "left").join(best, ["session", "branch"], "left")
    return out.withColumn("dollars", F.coalesce("dollars", F.lit(0.0)))


def drift_entries(entries: DataFrame) -> DataFrame:
    """session, idx, repo: rows of out-of-scope islands with the outside folder their island touches most (ties by name)."""
    rows = sequence.tangent_rows(entries, mixed_may_start=True)
    counts = rows.select("session", "island", F.explode("repos").alias("repo")).groupBy("session", "island", "repo").agg(F.count("*").alias("n"))
    best = counts.groupBy("session", "island").agg(F.min_by("repo", F.struct(-F.col("n"), F.col("repo"))).alias("repo"))
    return rows.join(best, ["session", "island"]).select("session", "idx", "repo")


def chain_light(entries: DataFrame, hops: int = 5) -> DataFrame:
    """session, whole: whether the last row's chain of parents is there for `hops` steps or to its start."""
    links = graphops.last_by_uuid(entries)
    at = links.groupBy("session").agg(F.max_by("parent_uuid", "idx").alias("parent_uuid")).withColumn("whole", F.lit(True))
    step = links.select("session", F.col("uuid").alias("parent_uuid"), F.col("parent_uuid").alias("next"), F.lit(True).alias("there"))
    for _ in range(hops):
        at = at.join(step, ["session", "parent_uuid"], "left")
        at = at.select("session", F.col("next").alias("parent_uuid"), (F.col("whole") & (F.col("parent_uuid").isNull() | F.coalesce("there", F.lit(False)))).alias("whole"))
    return at.select("session", "whole")


def filter_noise(entries: DataFrame) -> DataFrame:
    """Rows without progress, snapshots and flagged side chains, idx counted anew."""
    rows = entries.filter(~F.col("type").isin("progress", "file-history-snapshot")).filter(~F.coalesce("is_sidechain", F.lit(False)))
    return rows.withColumn("idx", (F.row_number().over(sequence.by_idx()) - 1).cast("long"))


def list_recent(entries: DataFrame, n: int = 20) -> DataFrame:
    """session, project, modified, rows of the `n` sessions with the latest row; ties by name."""
    per = entries.groupBy("session", "project").agg(F.max("ts").alias("modified"), F.count("*").alias("rows"))
    return per.orderBy(F.desc("modified"), "session").limit(n)


def filter_active(entries: DataFrame, window: str = "10 minutes") -> DataFrame:
    """session, modified of sessions whose last row lies within a window before the table's last row."""
    per = entries.groupBy("session").agg(F.max("ts").alias("modified"))
    newest = per.agg(F.max("modified")).first()[0]
    return per.filter(F.col("modified") >= F.lit(newest) - F.expr(f"interval {window}"))


def filter_project(entries: DataFrame, name: str) -> DataFrame:
    """session, project of sessions whose project's name holds `name`, in any case."""
    return entries.select("session", "project").distinct().filter(F.lower("project").contains(name.lower()))


def alias_session_counts(entries: DataFrame) -> DataFrame:
    """project, sessions."""
    return entries.groupBy("project").agg(F.count_distinct("session").alias("sessions"))


def sessions_for_cwd(entries: DataFrame, cwd: str) -> DataFrame:
    """session, rows of sessions with rows in a working directory."""
    return entries.filter(F.col("cwd") == cwd).groupBy("session").agg(F.count("*").alias("rows"))


def gc_candidates(entries: DataFrame, days: int = 30, most: int = 10) -> DataFrame:
    """session, rows, age_days of old sessions with few conversational rows and no compaction; ages count from the table's last row."""
    per = sequence.assign_epochs(entries).groupBy("session").agg(F.max("ts").alias("modified"), F.count_if(F.col("type").isin("user", "assistant")).alias("rows"), F.max("epoch").alias("cuts"))
    newest = per.agg(F.max("modified")).first()[0]
    age = F.floor((F.unix_seconds(F.lit(newest).cast("timestamp")) - F.unix_seconds(F.col("modified").cast("timestamp"))) / 86400)
    return per.withColumn("age_days", age).filter((F.col("age_days") >= days) & (F.col("rows") <= most) & (F.col("cuts") == 0)).select("session", "rows", "age_days")


def split_range(entries: DataFrame, first: int, last: int, rest: bool = False) -> DataFrame:
    """Rows first to last of each session as sessions of their own, idx from 0; with `rest` the others instead."""
    inside = F.col("idx").between(first, last)
    rows = entries.filter(~inside if rest else inside)
    return rows.withColumn("idx", (F.row_number().over(sequence.by_idx()) - 1).cast("long"))


def tombstone(turns: DataFrame, gone: Column, mark: str = "[removed]") -> DataFrame:
    """`turns` with a mark in place of the text of rows where `gone`; rows and order stay."""
    return turns.withColumn("text", F.when(gone, F.lit(mark)).otherwise(F.col("text")))


def session_diff(entries: DataFrame) -> DataFrame:
    """session, next_session, added, dropped, kept: files of the last epochs of a session and the next of its project."""
    rows = sequence.assign_epochs(entries).withColumn("last", F.max("epoch").over(Window.partitionBy("session")))
    per = rows.groupBy("project", "session").agg(F.min("ts").alias("a"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("epoch") == F.col("last"), cost.paths_of())))).alias("files"))
    w = Window.partitionBy("project").orderBy("a", "session")
    pairs = per.withColumns({"next_session": F.lead("session").over(w), "then": F.lead("files").over(w)}).filter("next_session is not null")
    return pairs.select(
        "session", "next_session", F.size(F.array_except("then", "files")).cast("long").alias("added"),
        F.size(F.array_except("files", "then")).cast("long").alias("dropped"), F.size(F.array_intersect("files", "then")).cast("long").alias("kept"),
    )


def decision_edges(points: DataFrame, touches: DataFrame, parts: int = 8) -> DataFrame:
    """point, session: commit points (point, session, path) and every other session (session, path) that touches one of their files.

    Pairs grow with the square of the log, so they are the output of the last join and not shuffled again: points of
    the same files share the sessions that touch any of them, each once. Only points of several sessions are made
    distinct as pairs. `parts` tasks at least share the points of one set of files; see `cross.blocked`.
    """
    rows = points.select("point", F.col("session").alias("own"), "path").filter("own is not null and path is not null").distinct()
    near = touches.select("session", "path").filter("session is not null").distinct()
    per = rows.groupBy("point").agg(F.min("own").alias("own"), F.max("own").alias("last"), F.array_sort(F.collect_set("path")).alias("files"))
    one = per.filter("own = last").select("point", "own", "files")
    sets = one.select("files").distinct().select("files", F.explode("files").alias("path"))
    seen = sets.join(near, "path").select("files", "session").distinct()
    found = cross.blocked(one, seen, ["files"], parts).filter("session <> own").select("point", "session")
    many = per.filter("own <> last").select(F.col("point").alias("_many"))
    several = rows.join(many, F.col("point").eqNullSafe(F.col("_many")), "left_semi")
    several = several.join(near, "path").filter("session <> own").select("point", "session").distinct()
    return found.union(several)


def project_graph(entries: DataFrame, least: int = 2) -> DataFrame:
    """kind, src, dst, weight: projects, shared files and time as edges; a project or file stands for all pairs of its sessions."""
    own = entries.groupBy("project", "session").agg(F.count("*").alias("weight")).select(F.lit("project").alias("kind"), F.col("project").alias("src"), F.col("session").alias("dst"), "weight")
    per = cost.touched(entries, "session").groupBy("path", "session").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)
    shared = per.groupBy("path").agg(F.count("*").alias("n")).filter("n >= 2").select("path")
    file = per.join(shared, "path", "left_semi").select(F.lit("file").alias("kind"), F.col("path").alias("src"), F.col("session").alias("dst"), "weight")
    spans = entries.groupBy("project", "session").agg(F.min("ts").alias("a"))
    follows = spans.withColumn("dst", F.lead("session").over(Window.partitionBy("project").orderBy("a", "session"))).filter("dst is not null")
    return own.unionByName(file).unionByName(follows.select(F.lit("next").alias("kind"), F.col("session").alias("src"), "dst", F.lit(1).cast("long").alias("weight")))


def continuity_suggestions(repeats: DataFrame, sessions: int = 3, tokens: int = 1000) -> DataFrame:
    """path, sessions, tokens of files (see `cross.continuity_files`) worth a note: many sessions, many tokens."""
    return repeats.filter((F.col("sessions") > sessions) & (F.col("tokens") > tokens)).select("path", "sessions", "tokens")


def grade_ratio(grade: Column) -> Column:
    """The share that a grade stands for."""
    return F.when(grade == "A", 0.95).when(grade == "B", 0.80).when(grade == "C", 0.65).when(grade == "D", 0.45).otherwise(0.20)


def active_health(graded: DataFrame) -> DataFrame:
    """healthy, other: sessions (session, grade) graded A or B, and the rest."""
    good = F.col("grade").isin("A", "B")
    return graded.agg(F.count_if(good).alias("healthy"), F.count_if(~good).alias("other"))


def projected_savings(m: DataFrame, rate: float = cost.DEFAULT_PRICE["p_read"]) -> DataFrame:
    """session, tokens, dollars: noise that cleaning would spare in all turns left, at the cache-read rate."""
    spared = F.col("noise_tokens") * F.greatest("turns_left", F.lit(0))
    return m.select("session", spared.alias("tokens"), F.round(spared / 1e6 * rate, 9).alias("dollars"))


def search_space(s: DataFrame, m: DataFrame) -> DataFrame:
    """session, probes, ratio, branch_factor, reexploration of sessions with decisions; rounded to tenths.

    s: the facts of sessions, m: their frame; see `frame`.
    """
    ghosts = cost.ghost_files(m).groupBy("session").agg(F.count("*").alias("ghosts"))
    broken = broken_chains(m)
    rows = s.filter("decisions > 0").select("session", "decisions", "compactions", "noise_tokens", F.col("side_groups").alias("groups"), F.col("tangent_rows").alias("tangents"), "stale", "tools", F.col("max_ctx").alias("peak"))
    rows = rows.join(ghosts, "session", "left").join(broken, "session", "left").na.fill(0, ["ghosts"]).withColumn("broken", F.coalesce("broken", F.lit(False)))
    d = F.col("decisions")
    most = lambda x, n: F.least(x, F.lit(n))
    within = lambda x, lo, hi: F.greatest(F.least(x, F.lit(hi)), F.lit(lo))
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    wide = F.when(F.col("tools") > 3, most((F.col("tools") - 3) * 0.12, 1.2)).otherwise(0.0)
    factor = within(1.8 + most(F.col("compactions") / d * 0.8, 1.5) + most(F.col("groups") / d * 0.4, 1.5) + most(F.col("tangents") / d * 0.08, 1.0) + wide, 2.0, 8.0)
    again = within(
        1.0 + most(F.col("compactions") * 0.07, 1.2) + F.when(F.col("broken"), 0.35).otherwise(0.0) + most(F.col("ghosts") / d * 0.08, 0.5)
        + most(F.col("noise_tokens") / F.greatest("peak", F.lit(1)) * 0.5, 0.6) + most(F.col("stale") / d * 0.1, 0.35), 1.0, 3.5,
    )
    rows = rows.withColumn("f", F.round(factor, 9)).withColumn("r", F.round(again, 9))
    return rows.select("session", tenth(d * F.col("f") * F.col("r")).alias("probes"), tenth(F.col("f") * F.col("r")).alias("ratio"), tenth(F.col("f")).alias("branch_factor"), tenth(F.col("r")).alias("reexploration"))


def broken_chains(m: DataFrame) -> DataFrame:
    """session, broken of a frame's sessions whose last chain may be broken (see `graphops.chain_integrity`).

    A chain is whole where no row of its session misses its parent and every parent comes before its rows, so that no
    chain meets itself; only the other sessions are walked.
    """
    links = m.filter("uuid is not null").select("session", "idx", "uuid", "parent_uuid")
    at = links.select("session", F.col("uuid").alias("parent_uuid"), F.col("idx").alias("at"))
    late = links.join(at, ["session", "parent_uuid"]).filter("at >= idx").select("session")
    open_ = m.filter("missing").select("session").union(late).distinct()
    return graphops.chain_integrity(m.join(open_, "session", "left_semi")).select("session", "broken")


def session_quick_view(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """session, usage_percent, last_in, last_out, dollars, turns_left, state, whole: what one light pass over a session tells."""
    used = F.when(F.col("ctx").isNotNull(), F.col("idx"))
    last = entries.groupBy("session").agg(F.coalesce(F.max_by("ctx", used), F.lit(0)).alias("last_in"), F.coalesce(F.max_by("output_tokens", used), F.lit(0)).alias("last_out"))
    left = sequence.growth(entries).select("session", F.col("fast_turns_left").alias("turns_left"))
    out = last.join(cost.quick_cost(entries, prices), "session", "left").join(left, "session").join(chain_light(entries), "session")
    percent = F.round(F.col("last_in") * 100.0 / sequence.WINDOW, 4)
    state = F.when(F.col("p") > 92, "emergency").when(F.col("p") > 75, "degrading").otherwise("healthy")
    return out.withColumn("p", percent).select("session", F.col("p").alias("usage_percent"), "last_in", "last_out", F.coalesce("dollars", F.lit(0.0)).alias("dollars"), "turns_left", state.alias("state"), "whole")


def session_summary(s: DataFrame, m: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a session: cost, turns, duration, context, grade, decisions' economics, gauge, top file, noise, purity, chain.

    s: the facts of sessions, m: their frame; see `frame`.
    """
    base = scoring.gauged(s).select(
        "session", "dollars", F.col("talk").alias("turns"), "usage_percent", "compactions", F.col("noise_tokens").alias("cleanable"), frame.health_columns()["grade"].alias("grade"),
        F.round("seconds", 3).alias("seconds"), "cpd", "ttc", "gauge", "state",
    )
    parts = [cost.top_files(m, 1).select("session", F.col("path").alias("top_file")), input_purity(blocks).select("session", F.col("score").alias("purity")), chain_light(m)]
    for p in parts:
        base = base.join(p, "session", "left")
    return base.withColumn("purity", F.coalesce("purity", F.lit(100.0)))


#: The facts that a report gives as they are, by part.
FACTS = {
    "context": ("entries", "user_rows", "assistant_rows", "progress_rows", "snapshot_rows", "bytes", "progress_tokens", "current_ctx", "max_ctx", "images", "large"),
    "growth": ("growth_rate", "turns_left", "compactions", "since_cleanup"), "drift": ("in_scope", "out_scope", "mixed_scope", "drift"),
}


def session_report(s: DataFrame, m: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a session with the columns of context, growth, drift, noise, health, entropy and summary, each under its part's name.

    s: the facts of sessions, m: their frame; see `frame`.
    """
    parts = {n: {c: F.col(c) for c in columns} for n, columns in FACTS.items()}
    parts |= {"noise": frame.noise_columns(), "health": frame.health_columns(), "entropy": frame.entropy_columns()}
    out = s.select("session", *[c.alias(f"{n}_{k}") for n, columns in parts.items() for k, c in columns.items()])
    summary = session_summary(s, m, blocks)
    return out.join(summary.select("session", *[F.col(c).alias(f"summary_{c}") for c in summary.columns if c != "session"]), "session", "left")


def collect_topics(entries: DataFrame, prices: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """topic, session, branch, entries, dollars: branches of all sessions without noise, numbered by start in their project."""
    rows = filter_noise(entries)
    costs = branch_costs(rows, prices, gap).select("session", "branch", "dollars")
    marked = sequence.branch_rows(rows, gap).groupBy("project", "session", "branch").agg(F.min("ts").alias("first_ts"), F.count("*").alias("entries"))
    topic = F.row_number().over(Window.partitionBy("project").orderBy("first_ts", "session", "branch")).cast("long")
    return marked.join(costs, ["session", "branch"]).withColumn("topic", topic).select("project", "topic", "session", "branch", "entries", "dollars")
