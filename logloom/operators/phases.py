"""Clean-up of whole logs in phases: rows go, then blocks, then parts of blocks, then runs of one role become one row.

Each phase reads the rows that the one before has written, with idx counted anew, so a lost executor costs one phase.
What becomes of a row is found on a few columns; its line is dealt again once a phase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import jsonl
from ..sources.scratch import written
from . import clean, graphops, noise, rewrite, sequence, text, tools

# Types of rows that do not part a run of one role; texts that stand for what went; sizes of cuts.
TRANSPARENT = ("system", "queue-operation", "progress")
EMPTIED, ORPHAN = "[coalesced]", "[removed: orphaned tool result]"
THRESHOLD, KEEP_LINES = 4096, 10
#: Rows of whole lines that one task sorts, so that a larger log has more tasks and not larger ones.
TASK_ROWS = 20_000
COUNTS = (
    "progress", "snapshots", "sidechains", "tangents", "failed_retries", "stale_reads", "orphans", "tombstoned", "images", "separators", "outputs",
    "merged", "stripped", "keep_skipped", "bytes_before", "bytes_after", "tokens_saved",
)


def _part(block: Column, path: str) -> Column:
    return F.try_variant_get(block, path, "string")


def _listed(content: Column) -> Column:
    """A content's blocks as variants; null where it is no list."""
    return F.when(F.ltrim(content).startswith("["), F.from_json(content, "array<variant>"))


def _text_block(words: Column) -> Column:
    return F.to_json(F.struct(words.alias("text"), F.lit("text").alias("type")))


def _with_field(block: Column, name: str, value: Column) -> Column:
    """A block whose field holds another variant."""
    fields = F.from_json(F.to_json(block), "map<string,variant>")
    return F.try_parse_json(F.to_json(F.transform_values(fields, lambda k, v: F.when(k == name, value).otherwise(v))))


def _as_variant(words: Column) -> Column:
    return F.variant_get(F.parse_json(F.to_json(F.struct(words.alias("v")))), "$.v", "variant")


def reread(rows: DataFrame) -> DataFrame:
    """`rows` with blocks, text, tools and refs of their content as it is now."""
    return jsonl.with_references(rows.withColumn("blocks", jsonl.content_blocks(F.col("content"))))


def _placed(rows: DataFrame, left: DataFrame) -> DataFrame:
    """`rows` that are in `left` (session, idx, parent_uuid and perhaps more columns, one row each), with its columns and idx from 0.

    Places are counted and parents changed on a few columns, so the lines themselves are dealt once. Rows of no session all stay.
    """
    more = [c for c in left.columns if c not in ("session", "idx", "parent_uuid", *rows.columns)]
    to = left.select("session", "idx", (F.row_number().over(sequence.by_idx()) - 1).cast("long").alias("_idx"), F.col("parent_uuid").alias("_parent"), *more)
    out = rows.join(to.filter("session is not null"), ["session", "idx"], "left").filter("session is null or _idx is not null")
    out = out.withColumn("parent_uuid", F.when(F.col("_idx").isNotNull(), F.col("_parent")).otherwise(F.col("parent_uuid"))).withColumn("idx", F.coalesce("_idx", "idx"))
    return out.select(*rows.columns, *more)


def _tasks(rows: DataFrame) -> int:
    """Parts to deal whole lines to; their compressed size, by which they are dealt otherwise, tells little of what they take in memory."""
    return max(1, -(-rows.count() // TASK_ROWS))


def coalesce(rows: DataFrame) -> DataFrame:
    """`rows` in which runs of one role are one row, with merged (rows that it took in) and stripped (results that went).

    Rows of transparent types do not part a run; where a run is merged they come before its row, which keeps the first
    row's fields and has all blocks in order; a plain text becomes a text block. The row after a merged run gets its
    row as parent. Then results stay only in the user row right after the assistant row that calls them (rows whose
    content is no list are passed over); a user row that loses all gets a placeholder, an assistant row of nothing but
    results stays. Rows without content or role are not merged; null uuids are no parents; idx counts from 0.
    """
    inner = F.when(F.ltrim("content").startswith("[") & _listed(F.col("content")).isNotNull(), F.expr("substr(trim(content), 2, length(trim(content)) - 2)")).otherwise(_text_block(F.col("content")))
    speaks = F.col("type").isin("user", "assistant") & F.col("content").isNotNull() & (F.col("role") != "")
    n = _tasks(rows)
    r = rows.repartition(n, "session").withColumn("_role", F.when(speaks, F.col("role"))).withColumn("_clear", F.col("type").isin(*TRANSPARENT))
    earlier = F.last(F.when(~F.col("_clear"), F.coalesce("_role", F.lit(""))), ignorenulls=True).over(sequence.before())
    opens = ~F.col("_clear") & (F.col("_role").isNull() | earlier.isNull() | (earlier != F.col("_role")))
    r = r.withColumn("_opens", opens).withColumn("_grp", F.sum(F.col("_opens").cast("long")).over(sequence.so_far()))
    r = r.repartition(n, "session", "_grp")

    own = F.when(F.col("_role").isNotNull(), F.col("idx"))
    parts = F.filter(F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct("idx", inner.alias("v"))))), lambda p: p["v"] != "")
    groups = r.groupBy("session", "_grp").agg(F.count("_role").alias("_n"), F.min(own).alias("_head"), F.min_by("uuid", own).alias("_uuid"), F.array_join(F.transform(parts, lambda p: p["v"]), ",").alias("_all")).filter("_n > 1")
    last = groups.select("session", (F.col("_grp") + 1).alias("_grp"), F.col("_uuid").alias("_parent"))
    r = r.join(groups, ["session", "_grp"], "left").join(last, ["session", "_grp"], "left")
    run, head = F.col("_n").isNotNull(), F.col("idx") == F.col("_head")
    r = r.filter(~run | F.col("_role").isNull() | head)
    r = r.withColumn("parent_uuid", F.when(F.col("_opens"), F.coalesce("_parent", "parent_uuid")).otherwise(F.col("parent_uuid")))
    r = r.withColumn("merged", F.when(head, F.col("_n") - 1).otherwise(0).cast("long")).withColumn("_last", run & F.col("_role").isNotNull())
    r = rewrite.with_content(r, F.when(F.coalesce(head, F.lit(False)), F.concat(F.lit("["), F.col("_all"), F.lit("]"))).otherwise(F.col("content")))
    order = Window.partitionBy("session").orderBy("_grp", "_last", "idx")
    r = r.repartition(n, "session").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return _matched(r.select(*rows.columns, "merged"))


def _matched(rows: DataFrame) -> DataFrame:
    """`rows`, dealt by session, without results whose call is not in the row of content blocks just before, and how many went."""
    r = rows.withColumn("_blocks", F.when(F.col("role").isin("user", "assistant"), _listed(F.col("content"))))
    calls = F.filter(F.transform("_blocks", lambda b: F.when(_part(b, "$.type") == "tool_use", _part(b, "$.id"))), lambda i: i.isNotNull() & (i != ""))
    r = r.withColumn("_said", F.when(F.col("_blocks").isNotNull(), F.struct(F.col("role").alias("role"), calls.alias("calls"))))
    r = r.withColumn("_before", F.last("_said", ignorenulls=True).over(sequence.before()))
    known = F.when((F.col("role") == "user") & (F.col("_before.role") == "assistant"), F.col("_before.calls"))
    r = r.withColumn("_known", F.coalesce(known, F.expr("cast(array() as array<string>)")))
    stays = lambda b: F.coalesce(_part(b, "$.type") != "tool_result", F.lit(True)) | F.coalesce(F.array_contains("_known", _part(b, "$.tool_use_id")), F.lit(False))
    left = F.filter("_blocks", stays)
    r = r.withColumn("_left", F.to_json(left)).withColumn("stripped", F.coalesce(F.size("_blocks") - F.size(left), F.lit(0)).cast("long"))
    r = r.withColumn("stripped", F.when(F.col("_blocks").isNull(), 0).otherwise(F.col("stripped")).cast("long"))
    placeholder = F.concat(F.lit("["), _text_block(F.lit(EMPTIED)), F.lit("]"))
    new = F.when((F.col("stripped") > 0) & (F.col("_left") != "[]"), F.col("_left")).when((F.col("stripped") > 0) & (F.col("role") == "user"), placeholder).otherwise(F.col("content"))
    r = r.withColumn("_content", new).drop("_blocks", "_said", "_before", "_known", "_left")
    return rewrite.with_content(r, F.col("_content")).select(*rows.columns, "stripped")


def strip_separators(content: Column) -> Column:
    """Content whose text blocks have no lines that are rules."""
    lines = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(text.RULE)), "\n")
    ruled = lambda b: (_part(b, "$.type") == "text") & F.exists(F.split(_part(b, "$.text"), "\n"), lambda x: x.rlike(text.RULE))
    return rewrite.map_blocks(content, lambda b: F.when(ruled(b), _with_field(b, "text", _as_variant(lines(_part(b, "$.text"))))).otherwise(b))


def _cut_text(words: Column, keep: int) -> Column:
    lines = F.split(words, "\n")
    mark = F.concat(F.lit("[... "), (F.size(lines) - 2 * keep).cast("string"), F.lit(" lines truncated ...]"))
    return F.array_join(F.concat(F.slice(lines, 1, keep), F.array(mark), F.slice(lines, -keep, keep)), "\n")


def _answer_text(block: Column) -> Column:
    """A result's text: its content, or the first text block of it."""
    held = F.to_json(F.try_variant_get(block, "$.content", "variant"))
    texts = F.filter(F.transform(_listed(held), lambda b: F.when(_part(b, "$.type") == "text", _part(b, "$.text"))), lambda t: t.isNotNull() & (t != ""))
    return F.when(held.startswith("["), F.get(texts, F.lit(0))).otherwise(_part(block, "$.content"))


def _too_long(words: Column, threshold: int, keep: int) -> Column:
    return F.coalesce((F.octet_length(words) >= threshold) & (F.size(F.split(words, "\n")) > 2 * keep + 1), F.lit(False))


def truncate_outputs(content: Column, shell: Column, threshold: int = THRESHOLD, keep: int = KEEP_LINES) -> Column:
    """Content whose results of the calls `shell` (ids) keep their first and last lines where they are long."""

    def change(b: Column) -> Column:
        words = _answer_text(b)
        held = F.to_json(F.try_variant_get(b, "$.content", "variant"))
        short = _as_variant(_cut_text(words, keep))
        listed = F.to_json(F.transform(_listed(held), lambda x: F.when(_part(x, "$.type") == "text", _with_field(x, "text", short)).otherwise(x)))
        value = F.when(held.startswith("["), F.try_parse_json(listed)).otherwise(short)
        hit = (_part(b, "$.type") == "tool_result") & F.array_contains(shell, _part(b, "$.tool_use_id")) & _too_long(words, threshold, keep)
        return F.when(hit, _with_field(b, "content", value)).otherwise(b)

    return F.when(shell.isNull(), content).otherwise(rewrite.map_blocks(content, change))


def active_chain(rows: DataFrame) -> DataFrame:
    """session, uuid, step, idx, type, parent_uuid of the chain that ends in a session's last row with a uuid; step counts up from 0.

    Pointers between runs (see `graphops.in_runs`) double each round, so n runs take log n of them; a loop ends where it meets itself.
    """
    links = written(graphops.in_runs(graphops.last_by_uuid(rows)), "links")
    edges = written(graphops.run_edges(links), "edges")
    last = links.groupBy("session").agg(F.max_by(F.struct("run", "n"), "idx").alias("e")).select("session", "e.run", "e.n", F.lit(0).cast("long").alias("step"))
    # at: steps to the first row of a run that the chain goes through.
    walk = last.select("session", "run", (F.col("n") - F.col("run")).alias("at"))
    jumps = edges.select("session", "run", F.col("up_run").alias("up"), (F.col("up_n") - F.col("up_run") + 1).alias("cost"))
    for _ in range(graphops.rounds_of(edges)):
        further = walk.join(jumps, ["session", "run"]).select("session", F.col("up").alias("run"), (F.col("at") + F.col("cost")).alias("at"))
        walk = written(walk.unionByName(further).groupBy("session", "run").agg(F.min("at").alias("at")), "walk")
        ahead = jumps.select("session", F.col("run").alias("up"), F.col("up").alias("next"), F.col("cost").alias("more"))
        jumps = written(jumps.join(ahead, ["session", "up"]).select("session", "run", F.col("next").alias("up"), F.least(F.col("cost") + F.col("more"), F.lit(1 << 60)).alias("cost")), "jumps")
        if jumps.isEmpty():
            break
    entered = walk.join(edges, ["session", "run"]).select("session", F.col("up_run").alias("run"), F.col("up_n").alias("n"), (F.col("at") + 1).alias("step"))
    entered = last.unionByName(entered).groupBy("session", "run").agg(F.collect_set(F.struct("n", "step")).alias("_entered"))
    steps = F.array_min(F.transform(F.filter("_entered", lambda e: e["n"] >= F.col("n")), lambda e: e["step"] + e["n"] - F.col("n")))
    return links.join(entered, ["session", "run"]).withColumn("step", steps).filter("step is not null").select("session", "uuid", "step", "idx", "type", "parent_uuid")


def first_phase(rows: DataFrame, blocks: DataFrame, keep: DataFrame | None = None, tombstone: bool = False) -> DataFrame:
    """session, idx, progress, snapshots, sidechains, tangents, orphan, kept, patch, grave: what becomes of the rows that a rule names.

    Rows of the first four kinds go. Orphaned answers (also to calls that go) and assistant rows at the chain's start
    go with all that follows from them, as `orphan`, or with `tombstone` answers only lose their content (grave).
    patch marks the row whose missing parent breaks the chain. Kept rows are named but nothing happens to them.
    """
    names = ("progress", "snapshots", "sidechains", "tangents")
    kept = rows.join(keep.select("session", "uuid").distinct(), ["session", "uuid"], "left_semi").select("session", "idx") if keep is not None else rows.select("session", "idx").limit(0)
    tag = lambda df, name: df.select("session", "idx", F.lit(name).alias("tag"))
    tags = tag(rows.filter("type = 'progress'"), "progress").unionByName(tag(rows.filter("type = 'file-history-snapshot'"), "snapshots"))
    tags = tags.unionByName(tag(noise.detect_sidechains(rows, blocks), "sidechains")).unionByName(tag(sequence.tangent_marks(rows).filter("tangent"), "tangents"))
    tags = tags.join(kept.withColumn("kept", F.lit(True)), ["session", "idx"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    tags = written(tags, "tags")
    gone = tags.filter("not kept").select("session", "idx").distinct()

    held = blocks.join(gone, ["session", "idx"], "left_anti")
    calls = held.filter("kind = 'tool_use' and row_type = 'assistant'").select("session", F.col("id").alias("tool_use_id")).distinct()
    lost = held.filter("kind = 'tool_result' and row_type = 'user' and tool_use_id != ''").join(calls, ["session", "tool_use_id"], "left_anti").select("session", "idx").distinct()
    chain = written(active_chain(rows), "chain")
    up = Window.partitionBy("session").orderBy(F.desc("step"))
    chain = chain.withColumn("_other", F.count_if(F.col("type") != "assistant").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_top", F.max("step").over(Window.partitionBy("session")))
    unseen = rows.select("session", F.col("uuid").alias("parent_uuid")).distinct()
    broken = chain.filter("step = _top and parent_uuid is not null").join(unseen, ["session", "parent_uuid"], "left_anti").select("session", "idx")
    start = chain.filter("_other = 0").select("session", "idx")
    free = lambda df: df.join(gone, ["session", "idx"], "left_anti").join(kept, ["session", "idx"], "left_anti")
    seeds = free(start if tombstone else lost.union(start).distinct())
    ids = rows.filter("uuid is not null").select("session", "idx", "uuid")
    owner = blocks.filter("kind = 'tool_result' and row_type = 'user' and tool_use_id != ''").groupBy("session", "tool_use_id").agg(F.max("idx").alias("idx")).join(ids, ["session", "idx"])
    caller = blocks.filter("kind = 'tool_use' and row_type = 'assistant'").select("session", F.col("id").alias("tool_use_id"), "idx").join(ids, ["session", "idx"]).select("session", "tool_use_id", F.col("uuid").alias("call_uuid"))
    owners = owner.join(caller, ["session", "tool_use_id"]).select("session", "uuid", "call_uuid")
    seeds = written(seeds, "seeds")
    fallen = graphops.cascade(rows, owners, seeds.join(ids, ["session", "idx"]).select("session", "uuid"), keep)
    fallen = ids.join(fallen, ["session", "uuid"], "left_semi").select("session", "idx").union(seeds).distinct().join(kept, ["session", "idx"], "left_anti").join(gone, ["session", "idx"], "left_anti")
    more = tag(fallen, "orphan").unionByName(tag(free(broken), "patch"))
    if tombstone:
        more = more.unionByName(tag(free(lost), "grave"))
    every = tags.unionByName(more.withColumn("kept", F.lit(False)))
    has = lambda name: F.max(F.col("tag") == name).alias(name)
    return every.groupBy("session", "idx").agg(*[has(n) for n in (*names, "orphan", "patch", "grave")], F.max("kept").alias("kept"))


def surgery_blocks(blocks: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """session, idx, block_idx, kind: blocks of failed calls that were tried again and of stale reads, with their answers; pairs with a kept row (session, idx) stay whole.

    kind is failed_retries or stale_reads on calls and null on answers.
    """
    m = noise.block_marks(blocks)
    retries = m.filter("retry_idx is not null").select("session", F.col("call.idx").alias("a"), F.col("tool_use_id").alias("id"), F.col("idx").alias("b"), F.lit("failed_retries").alias("kind"))
    stale = m.filter("stale").select("session", F.col("idx").alias("a"), "id", F.col("answer.idx").alias("b"), F.lit("stale_reads").alias("kind"))
    pairs = retries.unionByName(stale)
    if keep is not None:
        for end in ("a", "b"):
            pairs = pairs.join(keep.select("session", F.col("idx").alias(end)).distinct(), ["session", end], "left_anti")
    pairs = written(pairs, "pairs")
    uses = blocks.filter("kind = 'tool_use'").select("session", F.col("idx").alias("a"), "id", "block_idx")
    answers = blocks.filter("kind = 'tool_result'").select("session", F.col("idx").alias("b"), F.col("tool_use_id").alias("id"), "block_idx")
    first = pairs.join(uses, ["session", "a", "id"]).select("session", F.col("a").alias("idx"), "block_idx", "kind")
    second = pairs.join(answers, ["session", "b", "id"]).select("session", F.col("b").alias("idx"), "block_idx", F.lit(None).cast("string").alias("kind"))
    return first.union(second).distinct()


def clean_log(rows: DataFrame, keep: DataFrame | None = None, tombstone: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed and written `rows` after all phases, and a row of counts a session (`COUNTS`).

    Phases: rows of `first_phase` go, children re-pointed; blocks of failed retries and stale reads; images, rules and
    long shell outputs; runs of one role. keep: session, uuid of rows that the first two spare. Null uuids are in no
    chain; of rows that share one the last counts; empty tables give empty ones; tokens are bytes saved div 4.
    Between phases rows are lines with their own fields; what their blocks tell is read again where a phase asks for it.
    """
    links = ("session", "idx", "uuid", "parent_uuid", "type")
    derived = ("blocks", "text", "tools", "refs")
    blocks = written(jsonl.explode_blocks(rows).select("session", "idx", "row_type", "kind", "id", "tool_use_id"), "blocks")
    fate = written(first_phase(rows, blocks, keep, tombstone), "fate")
    goes = F.coalesce(~F.col("kept") & (F.col("progress") | F.col("snapshots") | F.col("sidechains") | F.col("tangents") | F.col("orphan")), F.lit(False))
    marked = written(rows.select(*links).join(fate, ["session", "idx"], "left").select(*links, goes.alias("goes"), "patch", "grave"), "marked")
    patched = written(rewrite.patch_parents(marked, marked.filter("patch").select("session", "uuid")).drop("patch"), "patched")
    gone = patched.filter("goes and uuid is not null").select("session", "uuid")
    left = _placed(rows.drop(*derived), graphops.repoint(patched.filter("not goes"), graphops.targets(patched, gone)).drop("goes"))
    if tombstone:
        grave = F.concat(F.lit("["), _text_block(F.lit(ORPHAN)), F.lit("]"))
        left = rewrite.with_content(left, F.when(F.col("grave"), grave).otherwise(F.col("content")))
    left = written(left.drop("grave"), "first")

    told = jsonl.explode_blocks(left.withColumn("blocks", jsonl.content_blocks(F.col("content"))))
    blocks = written(told.drop("text", "input", "content", "source", "result_size"), "blocks")
    spared = left.join(keep.select("session", "uuid").distinct(), ["session", "uuid"], "left_semi").select("session", "idx") if keep is not None else None
    cut = written(surgery_blocks(blocks, spared), "cut")
    shorter = written(rewrite.without_blocks(left, cut), "shorter")
    empty = shorter.filter("_left = '[]' and uuid is not null").select("session", "uuid")
    stays = clean.delete_rows(left.select(*links), empty).join(shorter.drop("uuid"), ["session", "idx"], "left")
    second = _placed(left, stays)
    second = written(rewrite.with_content(second, F.coalesce("_left", "content")).drop("_left"), "second")

    words = jsonl.answer_text(F.col("content"))
    told = jsonl.explode_blocks(second.withColumn("blocks", jsonl.content_blocks(F.col("content"))))
    rules = F.when((F.col("kind") == "text") & (F.col("row_type") == "assistant"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(text.RULE))))
    long = F.when((F.col("kind") == "tool_result") & (F.col("row_type") == "user"), _too_long(words, THRESHOLD, KEEP_LINES))
    blocks = written(told.select("session", "idx", "row_type", "kind", "name", "id", "tool_use_id", rules.alias("rules"), long.alias("long")), "blocks")
    shell = blocks.filter(F.col("kind") == "tool_use").filter(F.col("name").isin(*tools.BASH)).select("session", F.col("id").alias("tool_use_id")).distinct()
    answers = written(blocks.filter("kind = 'tool_result' and row_type = 'user'").join(shell, ["session", "tool_use_id"], "left_semi").select("session", "idx", "tool_use_id", "long"), "answers")
    shells = answers.groupBy("session", "idx").agg(F.collect_set("tool_use_id").alias("_shell"))
    content = F.when(F.col("type") == "assistant", strip_separators(rewrite.replace_images(F.col("content")))).otherwise(truncate_outputs(rewrite.replace_images(F.col("content")), F.col("_shell")))
    third = rewrite.with_content(second.join(shells, ["session", "idx"], "left"), content).drop("_shell")
    done = jsonl.with_parents(coalesce(written(third, "third")))
    done = reread(done.withColumn("raw_size", F.octet_length("raw").cast("long")))
    done = written(done.select(*rows.columns, "merged", "stripped"), "done")

    def counts(df: DataFrame, **of: Column) -> DataFrame:
        per = df.groupBy("session").agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in of.items()])
        return per.select("session", *[(F.col(n) if n in of else F.lit(0).cast("long")).alias(n) for n in COUNTS if n != "tokens_saved"])

    here = lambda tag: F.expr(f"{tag} and not kept")
    kind = lambda name: F.col("kind") == name
    parts = [
        counts(fate, progress=here("progress"), snapshots=here("snapshots"), sidechains=here("sidechains"), tangents=here("tangents"), orphans=here("orphan"), tombstoned=here("grave"), keep_skipped=F.col("kept")),
        counts(cut.filter("kind is not null"), failed_retries=kind("failed_retries"), stale_reads=kind("stale_reads")),
        counts(blocks.filter("kind = 'image' or rules is not null"), images=kind("image"), separators=F.col("rules")), counts(answers.filter("long"), outputs=F.lit(1)),
        counts(done, merged=F.col("merged"), stripped=F.col("stripped"), bytes_after=F.col("raw_size")), counts(rows, bytes_before=F.col("raw_size")),
    ]
    audit = reduce(DataFrame.unionByName, parts).groupBy("session").agg(*[F.sum(n).alias(n) for n in COUNTS if n != "tokens_saved"])
    audit = audit.withColumn("tokens_saved", F.expr("(bytes_before - bytes_after) div 4"))
    return done.drop("merged", "stripped"), audit.select("session", *COUNTS)
