"""What a session has said: goals, decisions, constraints, findings and questions as rows, and merging of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text

# Words that mark a decision, a constraint or a finding, in the order in which they are tried.
DECISIONS = ["decided", "chose", "going with", "instead of", "opted", "trade-off", "rather than", "because"]
CONSTRAINTS = ["must", "cannot", "should not", "required", "never", "always"]
FINDINGS = ["found that", "discovered", "noticed", "turns out", "the issue is", "the problem is", "root cause", "confirmed", "verified", "tested and"]


def _trimmed() -> Column:
    return F.regexp_replace("text", r"^\s+|\s+$", "")


def short(column: Column, limit: int = 120) -> Column:
    return F.when(F.length(column) <= limit, column).otherwise(F.concat(F.substring(column, 1, limit - 3), F.lit("...")))


def _ranked(turns: DataFrame, kinds: dict[str, tuple[Column, int]]) -> DataFrame:
    """conv_id, kind, rank, text: the first texts of each kind by turn, ties by text, up to the kind's number."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text"), F.lit(n).alias("most")) for k, (c, n) in kinds.items()])
    rows = turns.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", "p.*").filter("text is not null and text != ''")
    rank = F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy("turn", "text")).cast("long")
    return rows.withColumn("rank", rank).filter("rank <= most").select("conv_id", "kind", "rank", "text")


def canonical_state(turns: DataFrame, decisions: list[str] = DECISIONS, constraints: list[str] = CONSTRAINTS, most: int = 10) -> DataFrame:
    """conv_id, kind, rank, text: the goal (first user text) and up to `most` decisions, constraints and questions."""
    user, other = F.col("role") == "user", F.col("role") == "assistant"
    return _ranked(turns, {
        "goal": (F.when(user & (_trimmed() != ""), short(_trimmed())), 1), "question": (F.when(user & _trimmed().endswith("?"), short(_trimmed())), most),
        "decision": (F.when(other, text.hint(F.col("text"), decisions)), most), "constraint": (F.when(other, text.hint(F.col("text"), constraints)), most),
    })


def checkpoint_data(turns: DataFrame, decisions: list[str] = DECISIONS, findings: list[str] = FINDINGS, most: tuple[int, int, int] = (20, 20, 15)) -> DataFrame:
    """conv_id, kind, rank, text: decisions, findings and the user's texts of over 5 and under 500 bytes."""
    user, other = F.col("role") == "user", F.col("role") == "assistant"
    size = F.octet_length(_trimmed())
    return _ranked(turns, {
        "decision": (F.when(other, text.hint(F.col("text"), decisions)), most[0]), "finding": (F.when(other, text.hint(F.col("text"), findings)), most[1]),
        "question": (F.when(user & (size > 5) & (size < 500), short(_trimmed())), most[2]),
    })


def preserve_data(turns: DataFrame, gone: DataFrame, decisions: list[str] = DECISIONS, findings: list[str] = FINDINGS) -> DataFrame:
    """`checkpoint_data` of the turns that are to go (conv_id, turn), with room for more."""
    return checkpoint_data(turns.join(gone.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi"), decisions, findings, (50, 50, 30))


def decision_lineage(said: DataFrame, label: str) -> DataFrame:
    """conv_id, hits: conversations whose goal or decisions (see `canonical_state`) hold a label, in any case."""
    held = F.col("kind").isin("goal", "decision") & F.lower("text").contains(label.lower())
    return said.filter(held).groupBy("conv_id").agg(F.count("*").alias("hits"))


def vector_items(items: DataFrame) -> DataFrame:
    """project, kind, text, priority, conv_id: one of each normalised text, by priority, conversation and rank.

    items: project, kind, text, priority, conv_id, rank. Texts of white space only go.
    """
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    first = items.withColumn("key", key).filter("key != ''").groupBy("project", "kind", "key").agg(F.min(F.struct("priority", "conv_id", "rank", "text")).alias("f"))
    return first.select("project", "kind", "f.text", "f.priority", "f.conv_id")


def section_merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """key, part, place, heading, body, action: a target's sections with the bodies of a source's, new ones after them.

    Both: key, place, heading, body. A source section fits the target section with its heading, else the first whose
    heading is the same without case, signs and spaces. Of several for one heading the last counts.
    """
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("heading"), "[^a-z0-9 _-]", ""), "[ _-]+", " "))
    heads = target.groupBy("key", "heading").agg(F.max_by("body", "place").alias("body"), F.min("place").alias("first")).withColumn("norm", norm)
    exact = heads.select("key", "heading", F.col("heading").alias("hit"))
    loose = heads.groupBy("key", "norm").agg(F.min_by("heading", "first").alias("near"))
    found = source.withColumn("norm", norm).join(exact, ["key", "heading"], "left").join(loose, ["key", "norm"], "left").withColumn("hit", F.coalesce("hit", "near"))
    new = found.filter("hit is not null").groupBy("key", F.col("hit").alias("heading")).agg(F.max_by("body", "place").alias("new"), F.lit("replace").alias("done"))
    kept = target.select("key", "place", "heading").join(heads.select("key", "heading", "body"), ["key", "heading"]).join(new, ["key", "heading"], "left")
    own = kept.select("key", F.lit("target").alias("part"), "place", "heading", F.when(F.col("done").isNotNull(), F.col("new")).otherwise(F.col("body")).alias("body"), F.coalesce("done", F.lit("keep")).alias("action"))
    return own.unionByName(found.filter("hit is null").select("key", F.lit("source").alias("part"), "place", "heading", "body", F.lit("append").alias("action")))
