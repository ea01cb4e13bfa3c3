"""Session logs in JSON lines: scans, content blocks, summaries, and writing them back."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..operators import tools
from .scratch import dealt, written

USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")] + [T.StructField("service_tier", T.StringType())])
MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "content", "model", "id", "type", "stop_reason")] + [T.StructField("usage", USAGE)])
_TEXT = ("type", "uuid", "parentUuid", "timestamp", "sessionId", "cwd", "version", "gitBranch", "userType", "slug", "customTitle", "agentName", "permissionMode", "requestId", "toolUseID", "parentToolUseID", "messageId", "data", "snapshot", "toolUseResult")
ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT] + [T.StructField("isSidechain", T.BooleanType()), T.StructField("isSnapshotUpdate", T.BooleanType()), T.StructField("message", MESSAGE)])
#: The fields that `parse` asks for; the content is taken from the line as it stands.
ASKED = T.StructType([f for f in ENTRY.fields if f.name in ("type", "uuid", "parentUuid", "timestamp", "cwd", "slug", "customTitle", "toolUseResult", "isSidechain")] + [T.StructField("message", T.StructType([f for f in MESSAGE.fields if f.name in ("role", "model", "usage")]))])
SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "media_type", "data")])
BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "name", "id", "input", "tool_use_id", "content")] + [T.StructField("is_error", T.BooleanType()), T.StructField("source", SOURCE)])


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """session, line, raw of every physical line under a folder; session is the file's name, line counts from 1.

    Files that `write_sessions` made belong to the session that their folder names.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.jsonl,part-*.txt}").text(path)
    lines = lines.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("n"))
    w = Window.partitionBy("file").orderBy("at", "n")
    name = F.coalesce(F.expr(r"nullif(regexp_extract(file, '/session=([^/]+)/part-[^/]*$', 1), '')"), F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    return lines.select(name.alias("session"), folder.alias("project"), "modified", F.row_number().over(w).cast("long").alias("line"), "raw")


def _given(block: Column, *names: str) -> list[Column]:
    """Text fields of a tool call's input as they stand; each is read from the JSON once, so later steps should take them as columns."""
    return [F.get_json_object(block["input"], f"$.{name}").alias(name) for name in names]


def _some(value: Column) -> Column:
    """A text field; none where it is missing or empty."""
    return F.when(value != "", value)


def _typed_path(given: Column) -> Column:
    """The path of a call's input as typed."""
    return F.coalesce(_some(given["file_path"]), _some(given["path"]))


def _calls(blocks: str) -> Column:
    """Tool, clean path and shell command of each call among `blocks`.

    One step reads the inputs and the next tests them, as a lambda reads an input again for each mention of a field.
    """
    read = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["name"].alias("tool"), *_given(b, "file_path", "path"), F.when(b["name"].isin(*tools.BASH), *_given(b, "command")).alias("command")))
    return F.transform(read, lambda c: F.struct(c["tool"].alias("tool"), paths.clean_path(_typed_path(c)).alias("path"), _some(c["command"]).alias("command")))


def _small_calls(blocks: str) -> Column:
    """`_calls` of the blocks of `fold`."""
    return F.transform(F.filter(blocks, lambda b: b["kind"] == "tool_use"), lambda b: F.struct(b["name"].alias("tool"), b["path"].alias("path"), F.when(b["name"].isin(*tools.BASH), b["command"]).alias("command")))


# What in a tool's answer, in any case, tells an error.
ERRORS = ("error:", "permission denied", "no such file", "command not found", "exit status", "fatal:", "panic:", "traceback", "exception:")


def _answer_texts(content: Column) -> Column:
    """The texts of a result's content: its text blocks, or the content itself."""
    said = F.from_json(content, T.ArrayType(BLOCK))
    listed = F.transform(F.filter(said, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.when(F.ltrim(content).startswith("[") & said.isNotNull(), listed).otherwise(F.array(content))


def answer_text(content: Column) -> Column:
    """The first text of a result's content."""
    return F.get(F.filter(_answer_texts(content), lambda t: t.isNotNull() & (t != "")), F.lit(0))


def is_error_result(block: Column) -> Column:
    """Whether a tool result says that it failed, by its flag or its text."""
    # Each phrase is one pass over the text; those with a colon are passed over where it has none.
    marked, plain = [e for e in ERRORS if ":" in e], [e for e in ERRORS if ":" not in e]
    said = lambda t, phrases: reduce(or_, [t.contains(e) for e in phrases])
    told = lambda t: said(t, plain) | (t.contains(":") & said(t, marked))
    hit = F.exists(F.transform(_answer_texts(block["content"]), F.lower), lambda t: F.coalesce(told(t), F.lit(False)))
    return F.coalesce(block["is_error"], F.lit(False)) | F.coalesce(hit, F.lit(False))


def content_blocks(content: Column) -> Column:
    """A message's content as blocks; a plain text is one text block."""
    one = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in BLOCK.fields[2:]]))
    many = F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.from_json(content, T.ArrayType(BLOCK)))
    return F.when(content.isNotNull(), F.coalesce(many, one))


def with_references(rows: DataFrame, small: bool = False) -> DataFrame:
    """`rows` with blocks folded into sets: text, tools (names of calls) and refs (path, tool), first the calls' paths, then those in shell commands; small: blocks are those of `fold`."""
    calls = F.col("_calls")
    refs = F.transform(F.filter(calls, lambda c: c["path"].isNotNull()), lambda c: F.struct(c["path"].alias("path"), c["tool"].alias("tool")))
    shell = F.filter(calls, lambda c: c["command"].isNotNull())
    typed = F.flatten(F.transform(shell, lambda c: F.transform(paths.bash_paths(c["command"]), lambda p: F.struct(paths.clean_path(p).alias("path"), c["tool"].alias("tool")))))
    none = F.expr("cast(array() as array<struct<path:string,tool:string>>)")
    texts = F.transform(F.filter("blocks", lambda b: (b["kind" if small else "type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return rows.withColumn("_calls", _small_calls("blocks") if small else _calls("blocks")).withColumns({
        "tools": F.coalesce(F.transform(calls, lambda c: c["tool"]), F.expr("cast(array() as array<string>)")),
        "refs": F.coalesce(F.concat(refs, typed), none),
        "text": F.when(F.size(texts) > 0, F.array_join(texts, "\n")),
    }).drop("_calls")


def _read(lines: DataFrame) -> DataFrame:
    """`lines` with e (the fields that `parse` asks for), ts and _valid."""
    rows = lines.withColumn("e", F.from_json("raw", ASKED, {"mode": "PERMISSIVE"})).withColumn("ts", F.try_to_timestamp(F.col("e.timestamp")))
    is_object = F.substring(F.ltrim("raw"), 1, 1) == "{"
    # A line holds a key by its name, or else by escapes; most lines have neither and need not be read again.
    named = lambda key: F.col("raw").contains(f'"{key}"') | F.col("raw").contains("\\u")
    typed = lambda key, column: column.isNotNull() | ~named(key) | F.get_json_object("raw", f"$.{key}").isNull()
    valid = is_object & F.try_parse_json("raw").isNotNull() & typed("message", F.col("e.message")) & typed("isSidechain", F.col("e.isSidechain")) & typed("timestamp", F.col("ts"))
    return rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))


def _numbered(rows: DataFrame) -> DataFrame:
    """The valid ones of `rows` with idx from 0."""
    # Valid lines are counted before the others go: a filter on the lines themselves would parse each once more for every test.
    w = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return dealt(rows, "session").withColumn("idx", (F.sum(F.col("_valid").cast("long")).over(w) - 1).cast("long")).filter("_valid").drop("_valid")


def _fields(rows: DataFrame) -> DataFrame:
    """Typed columns of `rows` as read, and their blocks."""
    u = "e.message.usage."
    n = lambda c: F.coalesce(F.col(u + c), F.lit(0))
    used = F.col("e.message.usage").isNotNull()
    out = rows.select(
        "session", "project", "modified", "line", *[c for c in ("idx", "_valid") if c in rows.columns], "raw", F.octet_length("raw").cast("long").alias("raw_size"),
        F.coalesce("e.type", F.lit("")).alias("type"), F.expr("nullif(e.uuid, '')").alias("uuid"), F.expr("nullif(e.parentUuid, '')").alias("parent_uuid"), "ts",
        F.coalesce("e.cwd", F.lit("")).alias("cwd"), F.coalesce("e.isSidechain", F.lit(False)).alias("is_sidechain"), F.col("e.toolUseResult").alias("tool_use_result"),
        F.col("e.customTitle").alias("custom_title"), F.col("e.slug").alias("slug"), F.expr("nullif(e.message.model, '')").alias("model"), F.col("e.message.role").alias("role"), F.get_json_object("raw", "$.message.content").alias("content"),
        F.when(used, n("input_tokens") + n("cache_creation_input_tokens") + n("cache_read_input_tokens")).alias("ctx"),
        F.when(used, n("input_tokens")).alias("input_tokens"), F.when(used, n("output_tokens")).alias("output_tokens"),
        F.when(used, n("cache_creation_input_tokens")).alias("cache_creation_tokens"), F.when(used, n("cache_read_input_tokens")).alias("cache_read_tokens"),
    )
    return out.withColumn("blocks", content_blocks(F.col("content")))


def parse(lines: DataFrame) -> DataFrame:
    """Typed rows of the lines that parse, with idx from 0; blank and malformed lines are passed over.

    A line whose known field has another type is malformed, and so is one with a bad time. Besides the fields of the
    line a row has its content as `blocks` and what `with_references` tells of them, which the operators use.
    """
    return with_references(_fields(_numbered(_read(lines))))


def fold(lines: DataFrame) -> DataFrame:
    """The rows of `parse` without raw and content, and of each block only what `block_rows` gives.

    The lines are parsed where they are read, so that their texts and results are neither shuffled nor sorted nor written.
    """
    rows = _fields(_read(lines)).drop("raw", "content").withColumn("_given", F.transform("blocks", _given_of))
    return _numbered(with_references(rows.withColumn("blocks", F.zip_with("blocks", "_given", _small)).drop("_given"), small=True))


def scan_entries(spark: SparkSession, path: str) -> DataFrame:
    """The typed rows of the logs under a folder, parsed once and written, so that no operator parses JSON again."""
    return written(parse(scan_lines(spark, path)), "entries")


_INPUT = ("file_path", "path", "command", "pattern")


def _given_of(block: Column) -> Column:
    """The fields of a call's input as they stand; null of other blocks."""
    use = block["type"] == "tool_use"
    return F.struct(*[F.when(use, c).alias(n) for n, c in zip(_INPUT, _given(block, *_INPUT), strict=True)])


def _told(block: Column, given: Column) -> dict[str, Column]:
    """What a block tells besides its fields; `given`: see `_given_of`, taken in a step before, as each test of a field would read its JSON again."""
    answer = block["type"] == "tool_result"
    return {
        "is_error": F.coalesce(answer & is_error_result(block), F.lit(False)), "kind": block["type"], "path": paths.clean_path(_typed_path(given)), "command": _some(given["command"]), "pattern": _some(given["pattern"]),
        "result_size": F.when(answer, F.coalesce(F.octet_length(block["content"]), F.lit(0))).cast("long"),
    }


def _small(block: Column, given: Column) -> Column:
    """A block without its input, content and data; `data_size` is the length of an image's data."""
    kept = [block[n].alias(n) for n in ("text", "name", "id", "tool_use_id")]
    return F.struct(*kept, *[c.alias(n) for n, c in _told(block, given).items()], F.when(block["type"] == "image", F.length(block["source"]["data"])).alias("data_size"))


def block_rows(folded: DataFrame) -> DataFrame:
    """session, idx, row_type, raw_size, block_idx and what each block of `fold`'s rows tells."""
    out = folded.select("session", "idx", F.col("type").alias("row_type"), "raw_size", F.posexplode("blocks").alias("block_idx", "b"))
    return out.select("session", "idx", "row_type", "raw_size", "block_idx", "b.*")


def explode_blocks(entries: DataFrame) -> DataFrame:
    """session, idx, block_idx and the fields of each content block, with kind, clean path, command, pattern and result_size of a call or result.

    is_error holds for results that say so by their flag or their text; raw_size is that of the whole row.
    """
    out = entries.select("session", "idx", F.col("type").alias("row_type"), "raw_size", F.posexplode("blocks").alias("block_idx", "b")).withColumn("_given", _given_of(F.col("b")))
    told = _told(F.col("b"), F.col("_given"))
    return out.select("session", "idx", "row_type", "raw_size", "block_idx", *[F.col("b")[f.name].alias(f.name) for f in BLOCK.fields if f.name != "is_error"], *[c.alias(n) for n, c in told.items()])


def session_stats(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """One row a session: lines (blank and bad ones too), rows by type, last and largest context, tokens, times, first model."""
    used = F.col("ctx").isNotNull()
    n = lambda t: F.count_if(F.col("type") == t)
    per = entries.groupBy("session").agg(
        F.count("*").alias("entries"), n("user").alias("user_rows"), n("assistant").alias("assistant_rows"), n("progress").alias("progress_rows"), n("file-history-snapshot").alias("snapshot_rows"),
        F.coalesce(F.max_by("ctx", F.when(used, F.col("idx"))), F.lit(0)).alias("current_ctx"), F.coalesce(F.max("ctx"), F.lit(0)).alias("max_ctx"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("idx"))).alias("first_model"),
        F.max_by("custom_title", F.when(F.col("custom_title").isNotNull(), F.col("idx"))).alias("title"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if((F.col("type") == "user") & F.col("raw").contains('"type":"image"')).alias("image_rows"), (F.min_by("type", "idx") == "queue-operation").alias("starts_queued"),
    )
    counts = lines.groupBy("session").agg(F.count("*").alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"))
    client = F.when(F.col("snapshot_rows") > 0, "cli").when(F.col("starts_queued"), "desktop").when(F.col("lines") > 100, "cli").otherwise("unknown")
    return counts.join(per, "session", "left").withColumn("client_type", client)


def list_sessions(lines: DataFrame) -> DataFrame:
    """session, project, modified, lines, bytes; the newest first."""
    per = lines.groupBy("session", "project").agg(F.max("modified").alias("modified"), F.count("*").alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"))
    return per.orderBy(F.desc("modified"), "session")


def strip_type(lines: DataFrame, kind: str) -> DataFrame:
    """Lines without the marker of a type anywhere in them, as a byte scan sees it."""
    return lines.filter(~(F.col("raw").contains(f'"type":"{kind}"') | F.col("raw").contains(f'"type": "{kind}"')))


def with_parents(rows: DataFrame) -> DataFrame:
    """`rows` with the line's own parent as in the column parent_uuid; lines whose parent is the same stay as read.

    Only the field of the line itself changes, so a text that quotes it does not; a line without the field gets one.
    """
    old = F.expr("nullif(get_json_object(raw, '$.parentUuid'), '')")
    told = F.col("parent_uuid").cast("string")
    new = F.when(told.isNotNull(), F.variant_get(F.parse_json(F.to_json(F.struct(told.alias("v")))), "$.v", "variant")).otherwise(F.parse_json(F.lit("null")))
    top = F.from_json("raw", "map<string,variant>")
    swapped = F.to_json(F.transform_values(top, lambda k, v: F.when(k == "parentUuid", new).otherwise(v)))
    added = F.to_json(F.map_concat(top, F.create_map(F.lit("parentUuid"), new)))
    line = F.when(F.map_contains_key(top, "parentUuid"), swapped).otherwise(added)
    return rows.withColumn("raw", F.when(old.eqNullSafe(told), F.col("raw")).otherwise(line))


def write_sessions(rows: DataFrame, path: str, order: str = "idx") -> None:
    """One folder a session under a new path, lines in order, parents as in the column parent_uuid where there is one."""
    rows = with_parents(rows) if "parent_uuid" in rows.columns else rows
    rows.repartition("session").sortWithinPartitions("session", order).select("session", F.col("raw").alias("value")).write.partitionBy("session").text(path)
