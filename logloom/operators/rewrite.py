"""Changes to logs that keep the rest of a line: content blocks, images, parents, rows above a commit point.

Contents are JSON; what an operator does not name stays as it is, as blocks are variants and not typed rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import clean, noise

PLACEHOLDER = "[image removed]"
OVERSIZED = 5 * 1024 * 1024
TOKEN_BYTES = 750

# First bytes of image files in hex, and their types.
MAGIC = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "52494646": "image/webp"}


def detected_type(data: Column) -> Column:
    """The type that the first bytes of base64 data tell; null where they tell none or there are under 8 characters."""
    start = F.hex(F.try_to_binary(F.substring(data, 1, 8), F.lit("base64")))
    out = F.lit(None).cast("string")
    for magic, kind in MAGIC.items():
        out = F.when(start.startswith(magic), kind).otherwise(out)
    return F.when(F.length(data) >= 8, out)


def image_bytes(data: Column) -> Column:
    """Decoded size by the length of base64 data."""
    return F.floor(F.length(data) * 3 / 4)


def image_stats(images: DataFrame, key: str) -> DataFrame:
    """`key`, images, bytes, tokens of images (`key`, data)."""
    per = images.groupBy(key).agg(F.count("*").alias("images"), F.sum(image_bytes(F.col("data"))).alias("bytes"))
    return per.withColumn("tokens", F.floor(F.col("bytes") / TOKEN_BYTES))


def media_type_audit(images: DataFrame) -> DataFrame:
    """`images` (media_type, data and others) whose data are of another type than they say, with that type as detected."""
    return images.withColumn("detected", detected_type(F.col("data"))).filter("detected != media_type").drop("data")


def _part(block: Column, path: str) -> Column:
    return F.try_variant_get(block, path, "string")


def _note(text: str) -> Column:
    return F.parse_json(F.to_json(F.struct(F.lit(text).alias("text"), F.lit("text").alias("type"))))


def map_blocks(content: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON list of blocks with each block changed; null blocks go, other contents stay as they are."""
    blocks = F.from_json(content, "array<variant>")
    changed = F.filter(F.transform(blocks, change), lambda b: b.isNotNull())
    return F.when(F.ltrim(content).startswith("[") & blocks.isNotNull(), F.to_json(changed)).otherwise(content)


def replace_images(content: Column, over: int = -1) -> Column:
    """Content with a text block in place of each image of more than `over` decoded bytes."""
    size = lambda b: F.coalesce(image_bytes(_part(b, "$.source.data")), F.lit(0))
    return map_blocks(content, lambda b: F.when((_part(b, "$.type") == "image") & (size(b) > over), _note(PLACEHOLDER)).otherwise(b))


def replace_oversized(content: Column, over: int = OVERSIZED) -> Column:
    return replace_images(content, over)


def fix_media_types(content: Column) -> Column:
    """Content whose images say the type that their data have."""

    def change(b: Column) -> Column:
        told, real = _part(b, "$.source.media_type"), detected_type(_part(b, "$.source.data"))
        field = lambda t: F.concat(F.lit('"media_type":"'), t, F.lit('"'))
        fixed = F.try_parse_json(F.replace(F.to_json(b), field(told), field(real)))
        return F.when((_part(b, "$.type") == "image") & (real != told), fixed).otherwise(b)

    return map_blocks(content, change)


def with_content(rows: DataFrame, content: Column) -> DataFrame:
    """`rows` whose raw line and column content hold another message content; equal contents leave the line as read, and unread."""
    top = F.when(~F.col("_same"), F.from_json("raw", "map<string,variant>"))
    message = F.from_json(F.to_json(F.col("_top")["message"]), "map<string,variant>")
    swapped = F.transform_values(message, lambda k, v: F.when(k == "content", F.try_parse_json("_new")).otherwise(v))
    line = F.to_json(F.transform_values(F.col("_top"), lambda k, v: F.when(k == "message", F.try_parse_json(F.to_json(swapped))).otherwise(v)))
    same = F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("content")) | F.try_parse_json("_new").isNull()
    out = rows.withColumn("_new", content).withColumn("_same", same).withColumn("_top", top)
    out = out.withColumn("raw", F.when(F.col("_same"), F.col("raw")).otherwise(line)).withColumn("content", F.when(F.col("_same"), F.col("content")).otherwise(F.col("_new")))
    return out.withColumn("raw_size", F.octet_length("raw").cast("long")).drop("_new", "_top", "_same")


def without_blocks(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """session, idx, uuid, _left: the content that is left of rows that have blocks in `gone` (session, idx, block_idx)."""
    per = gone.groupBy("session", "idx").agg(F.collect_set(F.col("block_idx").cast("int")).alias("_gone"))
    cut = rows.select("session", "idx", "uuid", "content").join(per, ["session", "idx"])
    blocks = F.from_json("content", "array<variant>")
    left = F.to_json(F.filter(blocks, lambda b, i: ~F.array_contains("_gone", i)))
    return cut.select("session", "idx", "uuid", F.when(blocks.isNotNull(), left).alias("_left"))


def content_surgery(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` without the blocks of `gone` (session, idx, block_idx); rows that lose all go, their children re-pointed."""
    cut = rows.join(without_blocks(rows, gone).drop("uuid"), ["session", "idx"], "left")
    empty = cut.filter("_left = '[]' and uuid is not null").select("session", "uuid")
    kept = with_content(cut, F.coalesce("_left", "content")).drop("_left")
    return clean.delete_rows(kept, empty)


def collapse_rows(entries: DataFrame, candidates: DataFrame, points: DataFrame) -> DataFrame:
    """session, uuid of candidate rows (session, uuid) above their session's commit point (session, uuid)."""
    at = entries.join(points.select("session", "uuid"), ["session", "uuid"], "left_semi").groupBy("session").agg(F.min("idx").alias("at"))
    rows = entries.join(candidates.select("session", "uuid"), ["session", "uuid"], "left_semi").join(at, "session")
    return rows.filter("idx < at").select("session", "uuid")


def collapse_preview(entries: DataFrame, candidates: DataFrame, points: DataFrame) -> DataFrame:
    """session, rows that `collapse` would take; sessions without any are left out."""
    return collapse_rows(entries, candidates, points).groupBy("session").agg(F.count("*").alias("rows"))


def collapse(entries: DataFrame, candidates: DataFrame, points: DataFrame) -> DataFrame:
    """`entries` without the candidates above a commit point, children re-pointed."""
    return clean.delete_rows(entries, collapse_rows(entries, candidates, points))


def patch_parents(entries: DataFrame, flagged: DataFrame) -> DataFrame:
    """`entries` with no parent on flagged rows (session, uuid), nor on rows that share a flagged row's missing parent."""
    marked = entries.join(flagged.select("session", "uuid", F.lit(True).alias("_flag")).distinct(), ["session", "uuid"], "left")
    lost = noise.missing_parents(entries).select("session", "idx").withColumn("_lost", F.lit(True))
    marked = marked.join(lost, ["session", "idx"], "left")
    shared = marked.filter("_flag and _lost").select("session", "parent_uuid", F.lit(True).alias("_shared")).distinct()
    marked = marked.join(shared, ["session", "parent_uuid"], "left")
    out = marked.withColumn("parent_uuid", F.when(F.coalesce("_flag", "_shared", F.lit(False)), None).otherwise(F.col("parent_uuid")))
    return out.select(*entries.columns)


def reconnect_sidechains(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """`entries` where repairable rows without their parent take the nearest earlier row that has one."""
    found = noise.detect_sidechains(entries, blocks).filter("class = 'repairable' and reasons like '%missing_parent%'").select("session", "idx", F.col("reconnect_to").alias("_to"))
    out = entries.join(found, ["session", "idx"], "left").withColumn("parent_uuid", F.coalesce("_to", "parent_uuid"))
    return out.select(*entries.columns)


def repair(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Parsed `rows` with image types and sizes put right, broken parents reconnected or cleared, orphan results taken out.

    Rows are written after each step that later ones read more than once.
    """
    blocks = written(blocks, "blocks")
    fixed = written(with_content(rows, replace_oversized(fix_media_types(F.col("content")))), "fixed")
    joined = written(reconnect_sidechains(fixed, blocks), "joined")
    lost = noise.missing_parents(joined).select("session", "idx")
    joined = patch_parents(joined, joined.join(lost, ["session", "idx"], "left_semi").select("session", "uuid"))
    orphans = noise.orphan_results(blocks).select("session", "idx", "tool_use_id")
    gone = blocks.filter("kind = 'tool_result'").join(orphans, ["session", "idx", "tool_use_id"], "left_semi").select("session", "idx", "block_idx")
    return content_surgery(written(joined, "patched"), gone)
