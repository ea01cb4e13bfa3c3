"""Merkle manifest of a table: leaves of rows, a tree a source, and one tree of the sources' roots.

Each parent's children are spread into `FANOUT` slot columns by conditional aggregates: the slots put together and hashed are
the parent, the slots without the own one are the siblings. Rows are dealt by blocks of `FANOUT ** LEVELS` nodes and sorted
once; a block's levels are aggregates over prefixes of that order, so `LEVELS` levels of a tree cost one shuffle and no group
is larger than a block. The blocks' nodes are the rows of the next round, and its paths are joined back by block.

Null sources make a group of their own, before all others; null and repeated doc_ids are leaves like any other, in the order
of (doc_id with nulls first, leaf), and rows that are the same in all fields have places side by side; null fields and empty
texts differ in the leaf; texts of any length are hashed whole; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a leaf's way to the root: the parent's slots and which of them is the own one.
STEP = "array<struct<slots:array<string>,own:int>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with pos, their place from 0 in their group in the order of columns; no group is one task's.

    Sorted ranges are written, so that a row's range and place in it stay as they are; then the rows of a group in the ranges
    before its own are counted.
    """
    kept = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = written(kept.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "sorted")
    per = kept.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return kept.join(per, [group, "_part"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def block_levels(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """`nodes` (grp, pos, node, n: nodes of the group) with _block, steps to their block's top node, and that node as top."""
    at = lambda level: F.floor(F.col("pos") / fanout**level)
    rows = nodes.withColumns({f"_q{i}": at(i) for i in range(levels, 0, -1)}).repartition("grp", f"_q{levels}")
    rows = rows.sortWithinPartitions("grp", *[f"_q{i}" for i in range(levels, 0, -1)])
    rows = rows.withColumns({"top": F.col("node"), "steps": F.expr(f"cast(array() as {STEP})"), "_left": F.col("n")})
    for level in range(1, levels + 1):
        own = F.pmod(at(level - 1), F.lit(fanout)).cast("int")
        family = Window.partitionBy("grp", *[f"_q{i}" for i in range(levels, level - 1, -1)])
        rows = rows.withColumn("_own", own)
        rows = rows.withColumns({f"_slot{j}": F.max(F.when(F.col("_own") == j, F.col("top"))).over(family) for j in range(fanout)})
        slots = F.array(*[f"_slot{j}" for j in range(fanout)])
        grows = F.col("_left") > 1
        rows = rows.withColumns({
            "top": F.when(grows, digest(F.concat_ws("", *[f"_slot{j}" for j in range(fanout)]))).otherwise(F.col("top")),
            "steps": F.when(grows, F.concat("steps", F.array(F.struct(slots.alias("slots"), F.col("_own").alias("own"))))).otherwise(F.col("steps")),
            "_left": F.ceil(F.col("_left") / fanout),
        }).drop("_own", *[f"_slot{j}" for j in range(fanout)])
    return rows.withColumnRenamed(f"_q{levels}", "_block").drop(*[f"_q{i}" for i in range(1, levels)])


def tree(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`nodes` (grp, pos, node) with steps, the way from each to its group's top node, and that node as top."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    return _grown(nodes.join(sizes, "grp"), sizes.agg(F.max("n")).first()[0] or 0, fanout, levels)


def _grown(nodes: DataFrame, most: int, fanout: int, levels: int) -> DataFrame:
    rows = block_levels(nodes, fanout, levels)
    if most <= fanout**levels:
        return rows.drop("_block", "_left", "n")
    tops = rows.filter(F.col("pos") % fanout**levels == 0).select("grp", F.col("_block").alias("pos"), F.col("top").alias("node"), F.col("_left").alias("n"))
    above = _grown(written(tops, "nodes"), -(-most // fanout**levels), fanout, levels)
    above = above.select("grp", F.col("pos").alias("_block"), F.col("steps").alias("_more"), F.col("top").alias("_top"))
    out = rows.join(above, ["grp", "_block"]).withColumn("steps", F.concat("steps", "_more")).withColumn("top", F.col("_top"))
    return out.drop("_block", "_left", "n", "_more", "_top")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""

    def up(node: Column, step: Column) -> Column:
        return digest(F.concat_ws("", F.transform(step["slots"], lambda x, j: F.when(j == step["own"], node).otherwise(x))))

    return F.aggregate(steps, leaf, up)


def siblings(steps: Column) -> Column:
    """The digests beside a leaf's way, level by level, left to right, in one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat_ws("", F.filter(s["slots"], lambda x, j: j != s["own"]))), "")


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`leaves` (doc_id, source, leaf and others) with subroot, root and steps: the way of each leaf to the root."""
    # A mark before each source keeps null apart and first.
    rows = leaves.withColumn("grp", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source"))))
    low = tree(numbered(rows, "grp", ["doc_id", "leaf"]).withColumn("node", F.col("leaf")), fanout, levels).drop("node", "pos").withColumnRenamed("top", "subroot")
    low = written(low, "paths")
    roots = low.groupBy("grp").agg(F.first("subroot").alias("node")).withColumn("_all", F.lit(0))
    top = numbered(roots.withColumnRenamed("grp", "_source"), "_all", ["_source"]).withColumnRenamed("_all", "grp")
    top = tree(top, fanout, levels).select(F.col("_source").alias("grp"), F.col("steps").alias("_more"), F.col("top").alias("root"))
    return low.join(top, "grp").withColumn("steps", F.concat("steps", "_more")).drop("grp", "_more")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document.

    Documents whose id's crc32 is even are tampered with: their line feeds go. A null id is never tampered with.
    """
    values = [F.col(c) for c in FIELDS]
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf_of(*values[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaves = written(docs.select("doc_id", "source", leaf_of(*values).alias("leaf"), bad.alias("_bad")), "leaves")
    out = manifest(leaves).withColumn("folded_root", folded(F.coalesce("_bad", "leaf"), F.col("steps")))
    out = out.withColumn("proof_sha256", digest(siblings(F.col("steps"))))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
