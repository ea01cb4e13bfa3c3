"""Transcript cleaning: rows in, rows out, with counts of what went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphops, noise, sequence

PHASES = ("progress", "sidechains", "tangents", "failed_retries", "stale_reads")


def delete_rows(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """`entries` without the rows of `gone` (session, uuid), children re-pointed to the nearest row that stays."""
    rest = entries.join(gone.select("session", "uuid"), ["session", "uuid"], "left_anti")
    return graphops.repoint(rest, graphops.targets(entries, gone))


def marked(entries: DataFrame, blocks: DataFrame, phases: tuple[str, ...] = PHASES, keep: DataFrame | None = None) -> DataFrame:
    """session, idx, phase: rows that go, each under the first phase that takes it; kept uuids never go."""
    tags = noise.noise_tags(entries, blocks).select("session", "idx", F.col("category").alias("phase"))
    tags = tags.unionByName(entries.filter("type = 'progress'").select("session", "idx", F.lit("progress").alias("phase")))
    order = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase"))
    out = tags.withColumn("o", order).filter("o > 0").groupBy("session", "idx").agg(F.min_by("phase", "o").alias("phase"))
    if keep is None:
        return out
    safe = entries.join(keep.select("session", "uuid"), ["session", "uuid"], "left_semi").select("session", "idx")
    return out.join(safe, ["session", "idx"], "left_anti")


def clean_all(entries: DataFrame, blocks: DataFrame, phases: tuple[str, ...] = PHASES, keep: DataFrame | None = None) -> DataFrame:
    """`entries` after all phases: rows gone, chains re-pointed, idx counted anew."""
    out = marked(entries, blocks, phases, keep)
    gone = entries.join(out.select("session", "idx"), ["session", "idx"], "left_semi").select("session", "uuid").filter("uuid is not null")
    rest = entries.join(out.select("session", "idx"), ["session", "idx"], "left_anti")
    rest = graphops.repoint(rest, graphops.targets(entries, gone))
    return rest.withColumn("idx", (F.row_number().over(sequence.by_idx()) - 1).cast("long"))


def clean_audit(entries: DataFrame, blocks: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """session, phase, rows, bytes, tokens that cleaning takes away."""
    out = marked(entries, blocks, phases).join(entries.select("session", "idx", "raw_size"), ["session", "idx"])
    return out.groupBy("session", "phase").agg(F.count("*").alias("rows"), F.sum("raw_size").alias("bytes"), F.sum(noise.tokens()).alias("tokens"))


def clean_tiers(entries: DataFrame, blocks: DataFrame, tier: int) -> DataFrame:
    """clean_all with the phases of a tier: 1 progress, 2 retries too, 3 stale reads too."""
    return clean_all(entries, blocks, (("progress",), ("progress", "failed_retries"), ("progress", "failed_retries", "stale_reads"))[max(1, min(tier, 3)) - 1])


def coalesce_roles(turns: DataFrame) -> DataFrame:
    """conv_id, grp, turn, role, text: runs of one role merged, the first turn's number kept."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("long"), F.lit(0))
    runs = turns.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    per = runs.groupBy("conv_id", "grp").agg(F.min("turn").alias("turn"), F.min("role").alias("role"), parts.alias("parts"))
    return per.select("conv_id", "grp", "turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def budget_pick(items: DataFrame, budget: int) -> DataFrame:
    """project, item, size: of each project's items, newest first, those that still fit a budget; others are passed over.

    A fold over the project's items in order, as a running sum would stop at the first that does not fit.
    """
    rows = items.groupBy("project").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "item", "size"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<item:bigint,size:bigint>>)").alias("took"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        more = F.concat(acc["took"], F.array(F.struct(x["item"].cast("long").alias("item"), x["size"].cast("long").alias("size"))))
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, more).otherwise(acc["took"]).alias("took"))

    return rows.select("project", F.explode(F.aggregate("all", start, step)["took"]).alias("t")).select("project", "t.item", "t.size")
