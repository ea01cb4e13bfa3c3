"""Dollars and composite scores over session aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import noise, sequence, tools


#: Dollars for a million tokens of a model that no prefix fits.
DEFAULT_PRICE = {"p_in": 15.0, "p_out": 75.0, "p_write": 3.75, "p_read": 0.75}


def touched(rows: DataFrame, *columns: str) -> DataFrame:
    """`columns`, path, tool: a row each reference."""
    return rows.select(*columns, F.explode("refs").alias("_r")).select(*columns, "_r.path", "_r.tool")


def used_tools(rows: DataFrame, *columns: str) -> DataFrame:
    """`columns`, tool: a row each call."""
    return rows.select(*columns, F.explode("tools").alias("tool"))


def paths_of(refs: str = "refs") -> Column:
    return F.transform(refs, lambda r: r["path"])


def count_paths() -> Column:
    """How many different paths the rows of a group refer to."""
    return F.size(F.array_distinct(F.flatten(F.collect_set(paths_of())))).cast("long")


def total(column: str = "dollars") -> Column:
    """A sum of dollars that does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(20,9)"))


def price_table(prices: DataFrame | list[dict], most: int = 1000) -> list[dict]:
    """The price list, the longest prefixes first. It is a parameter: a list of over `most` prefixes is refused."""
    if isinstance(prices, list):
        return prices
    rows = [r.asDict() for r in prices.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a price list of over {most} rows")
    return sorted(rows, key=lambda r: (-len(r["prefix"]), r["prefix"]))


def priced(model: Column, prices: DataFrame | list[dict]) -> Column:
    """Dollars of a row's tokens at the price of a model, by the longest prefix that fits."""
    table = price_table(prices)

    def price(r: dict) -> Column:
        return F.struct(*[F.lit(r[c]).cast("double").alias(c) for c in ("p_in", "p_out", "p_write", "p_read")])

    best = price(next((r for r in table if not r["prefix"]), DEFAULT_PRICE))
    for r in reversed([r for r in table if r["prefix"]]):
        best = F.when(model.startswith(r["prefix"]), price(r)).otherwise(best)
    return (
        F.col("input_tokens") * best["p_in"] + F.col("output_tokens") * best["p_out"]
        + F.col("cache_creation_tokens") * best["p_write"] + F.col("cache_read_tokens") * best["p_read"]
    ) / 1e6


def turn_costs(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with usage and dollars: each at its own model's price, by the longest prefix that fits; no model is 'unknown'."""
    used = entries.filter("ctx is not null").withColumn("model", F.coalesce("model", F.lit("unknown")))
    return used.withColumn("dollars", priced(F.col("model"), prices))


def model_cost(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """session, model, turns, input_tokens, output_tokens, dollars."""
    return turn_costs(entries, prices).groupBy("session", "model").agg(
        F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(total().cast("double"), 9).alias("dollars")
    )


def session_cost(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """session, dollars, per_turn, primary_model: the dearest model, ties to the smaller name."""
    per = turn_costs(entries, prices).groupBy("session", "model").agg(total().alias("d"), F.count("*").alias("n"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("d"), "model")))
    out = ranked.groupBy("session").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.max(F.when(F.col("r") == 1, F.col("model"))).alias("primary_model"))
    return out.withColumn("d", F.col("d").cast("double")).select("session", F.round("d", 9).alias("dollars"), F.round(F.col("d") / F.col("n"), 6).alias("per_turn"), "primary_model")


def epoch_cost(entries: DataFrame, prices: DataFrame, drop: int = sequence.DROP) -> DataFrame:
    """session, epoch, turns, peak_ctx, dollars."""
    rows = turn_costs(sequence.assign_epochs(entries, drop), prices)
    return rows.groupBy("session", "epoch").agg(F.count("*").alias("turns"), F.max("ctx").alias("peak_ctx"), F.round(total().cast("double"), 9).alias("dollars"))


def quick_cost(entries: DataFrame, prices: DataFrame) -> DataFrame:
    """session, dollars: all tokens at the price of the session's first model."""
    first = entries.filter("model is not null").groupBy("session").agg(F.min_by("model", "idx").alias("model"))
    totals = entries.filter("ctx is not null").groupBy("session").agg(*[F.sum(c).alias(c) for c in ("ctx", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")])
    return turn_costs(totals.join(first, "session", "left"), prices).select("session", F.round("dollars", 9).alias("dollars"))


def context_stats(entries: DataFrame) -> DataFrame:
    """session, counts by type, bytes, progress tokens, current and largest context and its share of the window."""
    used = F.col("ctx").isNotNull()
    n = lambda t: F.count_if(F.col("type") == t)
    per = entries.groupBy("session").agg(
        F.count("*").alias("entries"), n("user").alias("user_rows"), n("assistant").alias("assistant_rows"), n("progress").alias("progress_rows"),
        F.sum("raw_size").alias("bytes"), F.sum(F.when(F.col("type") == "progress", noise.tokens()).otherwise(0)).alias("progress_tokens"),
        F.coalesce(F.max_by("ctx", F.when(used, F.col("idx"))), F.lit(0)).alias("current_ctx"), F.coalesce(F.max("ctx"), F.lit(0)).alias("max_ctx"),
    )
    return per.withColumn("usage_percent", F.round(F.col("current_ctx") * 100.0 / sequence.WINDOW, 4))


def epoch_scopes(entries: DataFrame) -> DataFrame:
    """session, epoch, in_scope, out_scope: conversational rows with paths; a row with both kinds counts by its share, sums are rounded."""
    rows = sequence.scopes(sequence.assign_epochs(entries)).filter("conv and n_ext + n_home > 0")
    part = (F.col("n_ext") / (F.col("n_ext") + F.col("n_home"))).cast("decimal(20,9)")
    whole = lambda c: F.floor(F.sum(c) + F.lit(0.5).cast("decimal(20,9)")).cast("long")
    return rows.groupBy("session", "epoch").agg(whole(1 - part).alias("in_scope"), whole(part).alias("out_scope"))


def scope_drift(entries: DataFrame) -> DataFrame:
    """session, in_scope, out_scope, drift."""
    per = epoch_scopes(entries).groupBy("session").agg(F.sum("in_scope").alias("in_scope"), F.sum("out_scope").alias("out_scope"))
    return per.withColumn("drift", F.round(F.col("out_scope") / F.greatest(F.col("in_scope") + F.col("out_scope"), F.lit(1)), 6))


def half_life(entries: DataFrame) -> DataFrame:
    """session, epoch, files, dropped, decay: the share of an epoch's files that no later epoch touches."""
    rows = touched(sequence.assign_epochs(entries), "session", "epoch").select("session", "epoch", "path").distinct()
    rows = rows.withColumn("last", F.max("epoch").over(Window.partitionBy("session", "path")))
    per = rows.groupBy("session", "epoch").agg(F.count("*").alias("files"), F.count_if(F.col("last") == F.col("epoch")).alias("dropped"))
    return per.withColumn("decay", F.round(F.col("dropped") / F.col("files"), 6))


def ghost_files(entries: DataFrame) -> DataFrame:
    """session, epoch, path: files of an epoch that the next epoch writes."""
    rows = touched(sequence.assign_epochs(entries), "session", "epoch")
    held = rows.select("session", "epoch", "path").distinct()
    written = rows.filter(F.col("tool").isin(*tools.SINGLE_WRITES)).select("session", (F.col("epoch") - 1).alias("epoch"), "path").distinct()
    return held.join(written, ["session", "epoch", "path"])


def epoch_diff(entries: DataFrame) -> DataFrame:
    """session, epoch, added, dropped, kept: files against the epoch before."""
    sets = sequence.assign_epochs(entries).groupBy("session", "epoch").agg(F.array_distinct(F.flatten(F.collect_set(paths_of()))).alias("files"))
    before = F.lag("files").over(Window.partitionBy("session").orderBy("epoch"))
    pairs = sets.withColumn("before", before).filter("before is not null")
    return pairs.select(
        "session", "epoch", F.size(F.array_except("files", "before")).cast("long").alias("added"),
        F.size(F.array_except("before", "files")).cast("long").alias("dropped"), F.size(F.array_intersect("files", "before")).cast("long").alias("kept"),
    )


def top_files(entries: DataFrame, n: int = 3) -> DataFrame:
    """session, rank, path, writes: the files written most, ties by path."""
    per = touched(entries, "session").filter(F.col("tool").isin(*tools.SINGLE_WRITES)).groupBy("session", "path").agg(F.count("*").alias("writes"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("writes"), "path")).cast("long"))
    return ranked.filter(F.col("rank") <= n).select("session", "rank", "path", "writes")


def grade(percent: Column) -> Column:
    return F.when(percent > 90, "A").when(percent > 75, "B").when(percent > 60, "C").when(percent > 40, "D").otherwise("F")


def grade_ratio(grade: Column) -> Column:
    """The share that a grade stands for."""
    return F.when(grade == "A", 0.95).when(grade == "B", 0.80).when(grade == "C", 0.65).when(grade == "D", 0.45).otherwise(0.20)


def health(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """session, noise_tokens, signal_percent, grade, biggest: how much of the context is signal."""
    stats = context_stats(entries).select("session", "current_ctx")
    ranked = noise.recommend(entries, blocks)
    total = ranked.groupBy("session").agg(F.sum("tokens").alias("noise_tokens"), F.max(F.when(F.col("rank") == 1, F.col("category"))).alias("biggest"))
    rows = stats.join(total, "session", "left").withColumn("noise_tokens", F.coalesce("noise_tokens", F.lit(0)))
    share = F.when(F.col("current_ctx") <= 0, 100.0).otherwise(F.greatest(F.col("current_ctx") - F.col("noise_tokens"), F.lit(0)) * 100.0 / F.col("current_ctx"))
    return rows.withColumn("p", share).select("session", "noise_tokens", F.round("p", 4).alias("signal_percent"), grade(F.col("p")).alias("grade"), "biggest")


def entropy(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """session, score, level from signal, fullness, drift, orphans and compactions."""
    base = health(entries, blocks).select("session", (F.col("signal_percent") / 100).alias("signal"))
    stats = context_stats(entries).select("session", "current_ctx", "entries")
    drift = scope_drift(entries).select("session", "drift")
    orphans = noise.orphan_results(blocks).groupBy("session").agg(F.count("*").alias("orphans"))
    cuts = sequence.detect_compactions(entries).groupBy("session").agg(F.count("*").alias("cuts"))
    rows = base.join(stats, "session").join(drift, "session", "left").join(orphans, "session", "left").join(cuts, "session", "left").na.fill(0, ["drift", "orphans", "cuts"])
    score = 100 * (
        0.30 * (1 - F.col("signal")) + 0.25 * F.least(F.col("current_ctx") / sequence.LIMIT, F.lit(1.0)) + 0.20 * F.col("drift")
        + 0.15 * F.least(F.col("orphans") / F.greatest("entries", F.lit(1)), F.lit(1.0)) + 0.10 * F.least("cuts", F.lit(10)) / 10
    )
    level = F.when(score <= 20, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")
    return rows.select("session", F.round(score, 9).alias("score"), level.alias("level"))
