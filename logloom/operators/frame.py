"""The session frame: one row a log line with everything that the session operators ask of it, written once.

`marks` reads a log's entries and blocks once, lays what the blocks tell beside the rows in one exchange by session, sets epoch, scope,
tangent and noise columns in windows that share one order, and writes the rows. `of` goes on to the facts without writing them. `epoch_facts` and `facts` aggregate them, by (session, epoch) and then by session, in one shuffle; scores,
reports and summaries are expressions on the facts. A row may hold many calls: refs are its paths with their tools, and rows
that refer both in and out of scope count by their share of outside paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dealt, written
from . import cost, noise, notes, sequence, text, tools

#: Bytes from which a shell's output is large; bytes of image data a token; hints and questions kept of an epoch.
LARGE, IMAGE_TOKEN, HINTS, QUESTIONS = 4096, 750, 5, 10
INDEXED = ("stale_reads", "failed_retries", "tangents", "sidechains")


def _images(blocks: DataFrame) -> tuple[Column, Column]:
    """Whether a block is an image, and its bytes."""
    data = F.col("data_size") if "data_size" in blocks.columns else F.when(F.col("kind") == "image", F.length("source.data")) if "source" in blocks.columns else F.lit(None).cast("int")
    return data.isNotNull(), F.floor(data * 3 / 4)


COUNTS = ("stale_tags", "stale", "retry_tags", "retries", "orphans", "images", "image_bytes", "large", "large_tokens")
PICTURES = ("images", "image_bytes")


def _hint(said: Column) -> Column:
    return text.hint(said, notes.DECISIONS)


def _question(said: Column) -> Column:
    trimmed = F.regexp_replace(said, r"^\s+|\s+$", "")
    return F.when(trimmed.endswith("?"), notes.short(trimmed))


def own(rows: DataFrame) -> DataFrame:
    """`rows` of `jsonl.fold` with what each tells without its neighbours' blocks: images, image_bytes, decisions, questions, and follows (its parent is the row before).

    It is taken while the blocks are at hand, so that they need not be exploded, dealt and put beside the rows again for it.
    """
    said = F.transform(F.filter("blocks", lambda b: (b["kind"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    some = lambda type, f: F.when(F.col("type") == type, F.filter(F.transform(said, f), lambda x: x.isNotNull()))
    sizes = F.transform(F.filter("blocks", lambda b: b["data_size"].isNotNull()), lambda b: F.floor(b["data_size"] * 3 / 4))
    before = F.lag("uuid").over(Window.partitionBy("session").orderBy("line"))
    return rows.withColumns({
        "images": F.greatest(F.coalesce(F.size(sizes), F.lit(0)), F.lit(0)).cast("long"), "image_bytes": F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)),
        "decisions": some("assistant", _hint), "questions": some("user", _question), "follows": F.coalesce(F.col("parent_uuid") == before, F.lit(False)),
    })


def block_facts(blocks: DataFrame, pictures: bool = True) -> DataFrame:
    """session, idx and what the blocks tell of rows of which they tell something: counts of noise tags, orphans, images, large outputs, tokens of stale reads and retries.

    Without `pictures` only calls and results are read, and images are not counted.
    """
    blocks = blocks if pictures else blocks.filter(F.col("kind").isin("tool_use", "tool_result"))
    again = F.col("retry_idx").isNotNull()
    at = lambda kind, idx: F.struct(F.lit(kind).alias("kind"), idx.alias("idx"))
    # A block tells something of its own row and, where it is tagged, of the rows of its answer or call.
    big = F.when(F.col("shell_result") & (F.col("_size") >= LARGE), F.floor(F.col("_size") / 4))
    ends = F.array(at("own", F.when(F.col("orphan") | F.col("_image") | F.col("_big").isNotNull(), F.col("idx"))), at("stale", F.when(F.col("stale"), F.col("idx"))), at("answer", F.when(F.col("stale"), F.col("answer.idx"))), at("call", F.when(again, F.col("call.idx"))), at("error", F.when(again, F.col("idx"))))
    size = F.col("result_size") if "result_size" in blocks.columns else F.col("raw_size")
    images, image_bytes = _images(blocks) if pictures else (F.lit(False), F.lit(None).cast("long"))
    b = noise.block_marks(blocks.withColumns({"_image": images, "_bytes": image_bytes, "_size": size})).withColumn("_big", big)
    b = b.select("session", F.explode(F.filter(ends, lambda e: e["idx"].isNotNull())).alias("_e"), "orphan", "_image", "_bytes", "_big")
    kind, own = F.col("_e.kind"), F.col("_e.kind") == "own"
    return b.groupBy("session", F.col("_e.idx").alias("idx")).agg(
        F.count_if(kind.isin("stale", "answer")).alias("stale_tags"), F.count_if(kind == "stale").alias("stale"), F.count_if(kind.isin("call", "error")).alias("retry_tags"), F.count_if(kind == "call").alias("retries"),
        F.count_if(own & F.col("orphan")).alias("orphans"), F.count_if(own & F.col("_image")).alias("images"), F.coalesce(F.sum(F.when(own, F.col("_bytes"))), F.lit(0)).alias("image_bytes"),
        F.count_if(own & F.col("_big").isNotNull()).alias("large"), F.coalesce(F.sum(F.when(own, F.col("_big"))), F.lit(0)).alias("large_tokens"),
    )


HINTED = "array<string>"


def hints(blocks: DataFrame) -> DataFrame:
    """session, idx, decisions, questions of rows whose texts hint at some, in the order of their blocks."""
    if "text" not in blocks.columns:
        none = F.lit(None).cast(HINTED)
        return blocks.select("session", "idx", none.alias("decisions"), none.alias("questions")).limit(0)
    said = F.when(F.col("row_type") == "assistant", _hint(F.col("text")))
    asked = F.when(F.col("row_type") == "user", _question(F.col("text")))
    texts = blocks.filter("kind = 'text'").select("session", "idx", "block_idx", said.alias("said"), asked.alias("asked")).filter("said is not null or asked is not null")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("block_idx", F.col(c).alias("v"))))), lambda x: x["v"])
    return texts.groupBy("session", "idx").agg(listed("said").alias("decisions"), listed("asked").alias("questions"))


def _told(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """`entries` with COUNTS, missing, decisions and questions.

    What blocks and links tell of a row is put beside it by one exchange of all of it by session, in the order in
    which the session's windows then read the rows; joins would deal the rows by (session, idx) and sort them anew.
    """
    known = "follows" in entries.columns
    told = [c for c in COUNTS if not known or c not in PICTURES]
    more = {"_counts": block_facts(blocks, not known).select("session", "idx", F.struct(*told).alias("_counts"))}
    if not known:
        more["_hints"] = hints(blocks).select("session", "idx", F.struct("decisions", "questions").alias("_hints"))
    more["_lost"] = noise.missing_parents(entries).select("session", "idx", F.lit(True).alias("_lost"))
    rows = entries.withColumn("_row", F.lit(True))
    for other in more.values():
        rows = rows.unionByName(other, allowMissingColumns=True)
    row = Window.partitionBy("session", "idx")
    here = {c: F.first(c, ignorenulls=True).over(row) for c in more}
    rows = dealt(rows, "session").withColumns(here).filter("_row")
    beside = {c: F.coalesce(F.col("_counts")[c], F.lit(0)) for c in told} | ({} if known else {c: F.col("_hints")[c] for c in ("decisions", "questions")})
    return rows.withColumns(beside | {"missing": F.coalesce("_lost", F.lit(False))}).drop("_row", *more)


def _frame(entries: DataFrame, blocks: DataFrame, prices: DataFrame | None, gap: str) -> DataFrame:
    """The rows of `marks`; windows in the order of idx come first, so that the session is sorted once for them."""
    used = [c for c in ("project", "ts", "type", "uuid", "parent_uuid", "cwd", "model", "ctx", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "raw_size", "is_sidechain", "text", "tools", "refs", "path", "tool", *PICTURES, "decisions", "questions", "follows") if c in entries.columns]
    rows = sequence.branch_rows(_told(entries.select("session", "idx", *used), blocks), gap)
    rows = rows.withColumn("turn", F.sum((F.col("type") == "assistant").cast("long")).over(sequence.so_far()))
    flagged = F.coalesce(F.col("is_sidechain"), F.lit(False)) if "is_sidechain" in entries.columns else F.lit(False)
    rows = rows.withColumn("side", flagged | F.col("missing") | (F.col("orphans") > 0)).withColumn("t", noise.tokens())
    rows = rows.withColumn("new_chain", F.col("side") & ~F.coalesce(F.lag("side").over(sequence.by_idx()), F.lit(False)))
    if prices is not None:
        prices = cost.price_table(prices)
        own = cost.priced(F.coalesce("model", F.lit("unknown")), prices)
        first = F.first(F.when(F.col("type") == "assistant", F.col("model")), ignorenulls=True).over(Window.partitionBy("session").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.withColumn("first_model", first).withColumn("dollars", F.when(F.col("ctx").isNotNull(), own))
        rows = rows.withColumn("drift_dollars", F.when(F.col("ctx").isNotNull() & (F.col("type") == "assistant"), cost.priced(F.coalesce("first_model", F.lit("unknown")), prices)))
    else:
        rows = rows.withColumns({"first_model": F.lit(None).cast("string"), "dollars": F.lit(None).cast("double"), "drift_dollars": F.lit(None).cast("double")})
    rows = sequence.tangent_marks(rows)
    keep = [c for c in ("session", "project", "idx", "ts", "type", "uuid", "parent_uuid", "model", "ctx", "output_tokens", "raw_size", "text", "tools", "refs") if c in rows.columns]
    return rows.select(
        *keep, "t", "epoch", "branch", "compacted", "turn", "first_model", "dollars", "drift_dollars", "n_ext", "n_home", "repos", "tangent", "tangent_tokens", "island", "drift_island",
        "missing", "side", "new_chain", *COUNTS, "decisions", "questions",
    )


def marks(entries: DataFrame, blocks: DataFrame, prices: DataFrame | None = None, gap: str = "30 minutes") -> DataFrame:
    """The frame of `entries` and their `blocks`, written; dollars are null without `prices`."""
    return written(_frame(entries, blocks, prices, gap), "marks")


def share() -> Column:
    """The part of a row's paths that lies outside."""
    return F.when(F.col("n_ext") + F.col("n_home") > 0, F.col("n_ext") / (F.col("n_ext") + F.col("n_home"))).otherwise(0.0)


def money(column: Column) -> Column:
    return F.sum(column.cast("decimal(20,9)"))


def epoch_facts(m: DataFrame) -> DataFrame:
    """A row for each session and epoch of a frame: what its rows add up to.

    Numbers are taken by `max_by` and counts, as a maximum of structs or a list has every row of the frame sorted once more.
    """
    used_ctx = F.col("ctx").isNotNull()
    n = lambda t: F.count_if(F.col("type") == t)
    both = F.col("n_ext") + F.col("n_home") > 0
    size = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("raw_size"))), F.lit(0))
    noisy = (F.col("stale_tags") > 0) | (F.col("retry_tags") > 0) | F.col("tangent") | F.col("side")
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("idx", F.col(c).alias("v"))))), lambda x: x["v"]))
    spent = F.when(F.coalesce(F.col("output_tokens"), F.lit(0)) > 0, F.col("output_tokens")).otherwise(F.col("t"))
    talk = F.col("type").isin("user", "assistant")
    return m.groupBy("session", "epoch").agg(
        F.first("project", ignorenulls=True).alias("project") if "project" in m.columns else F.lit(None).cast("string").alias("project"),
        F.count("*").alias("entries"), n("user").alias("user_rows"), n("assistant").alias("assistant_rows"), n("progress").alias("progress_rows"), n("file-history-snapshot").alias("snapshot_rows"),
        F.sum("raw_size").alias("bytes"), F.sum(F.when(F.col("type") == "progress", F.col("t")).otherwise(0)).alias("progress_tokens"), size("file-history-snapshot").alias("snapshot_bytes"),
        F.count_if(talk).alias("talk"), F.count_if(used_ctx).alias("uses"), F.max("ctx").alias("peak_ctx"), F.max_by("ctx", F.when(used_ctx, F.col("idx"))).alias("last_ctx"), F.min_by("ctx", F.when(used_ctx, F.col("idx"))).alias("first_ctx"),
        F.min_by("ts", "idx").alias("start_ts"), F.max_by("ts", "idx").alias("end_ts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("first_model").alias("first_model"),
        money(F.col("dollars")).alias("dollars"), money(F.col("drift_dollars") * share()).alias("drift_dollars"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.floor(F.coalesce(F.sum(F.when(both, (1 - share()).cast("decimal(20,9)"))), F.lit(0)) + F.lit(0.5).cast("decimal(20,9)")).cast("long").alias("in_scope"),
        F.floor(F.coalesce(F.sum(F.when(both, share().cast("decimal(20,9)"))), F.lit(0)) + F.lit(0.5).cast("decimal(20,9)")).cast("long").alias("out_scope"), F.count_if((F.col("n_ext") > 0) & (F.col("n_home") > 0)).alias("mixed_scope"),
        F.sum("stale").alias("stale"), F.sum(F.col("stale_tags") * F.col("t")).alias("stale_tokens"), F.sum("retries").alias("retries"), F.sum(F.col("retry_tags") * F.col("t")).alias("retry_tokens"),
        F.count_if("tangent").alias("tangent_rows"), F.sum(F.when(F.col("tangent"), F.col("tangent_tokens")).otherwise(0)).alias("tangent_tokens"), F.sum(F.when(F.col("tangent"), F.col("t")).otherwise(0)).alias("tangent_full"),
        F.count_if("side").alias("side_rows"), F.sum(F.when(F.col("side"), F.col("t")).otherwise(0)).alias("side_tokens"), F.count_if("new_chain").alias("side_groups"), F.sum(F.when(noisy, F.col("t")).otherwise(0)).alias("union_tokens"), F.count_if(noisy).alias("noisy_rows"),
        F.sum("images").alias("images"), F.sum("image_bytes").alias("image_bytes"), F.sum("large").alias("large"), F.sum("large_tokens").alias("large_tokens"), F.count_if("missing").alias("missing"), F.sum("orphans").alias("orphans"),
        F.least(F.sum(F.greatest(F.coalesce(F.size("decisions"), F.lit(0)), F.lit(0))), F.lit(HINTS)).alias("n_decisions"), F.slice(flat("decisions"), 1, HINTS).alias("decisions"), F.slice(flat("questions"), 1, QUESTIONS).alias("questions"), F.array_sort(F.flatten(F.collect_set("tools"))).alias("tool_set"),
        F.sum(F.when(F.col("type") == "assistant", spent)).alias("spent_tokens"), F.max(F.when(F.col("compacted"), F.col("text"))).alias("summary"), F.max(F.when(F.col("compacted"), F.col("idx"))).alias("opened_at"),
    )


def facts(epochs: DataFrame) -> DataFrame:
    """A row a session of `epoch_facts`, with growth, noise and what the scores need."""
    closed = epochs.withColumn("_top", F.max("epoch").over(Window.partitionBy("session")))
    hinted = F.when(F.col("epoch") < F.col("_top"), F.col("n_decisions")).otherwise(0)
    sums = [
        "entries", "user_rows", "assistant_rows", "progress_rows", "snapshot_rows", "bytes", "progress_tokens", "snapshot_bytes", "talk", "uses", "dollars", "drift_dollars", "in_scope", "out_scope", "mixed_scope", "stale", "stale_tokens", "retries", "retry_tokens",
        "tangent_rows", "tangent_tokens", "tangent_full", "side_rows", "side_tokens", "side_groups", "union_tokens", "noisy_rows", "images", "image_bytes", "large", "large_tokens", "missing", "orphans",
    ]
    s = closed.groupBy("session").agg(
        F.max("project").alias("project"), *[F.sum(c).alias(c) for c in sums], F.max("epoch").alias("compactions"), F.coalesce(F.max("peak_ctx"), F.lit(0)).alias("max_ctx"), F.coalesce(F.max_by("last_ctx", F.when(F.col("last_ctx").isNotNull(), F.col("epoch"))), F.lit(0)).alias("current_ctx"), F.max_by("uses", "epoch").alias("_uses"), F.max_by("first_ctx", "epoch").alias("_start"),
        F.min_by("start_ts", "epoch").alias("_a"), F.max_by("end_ts", "epoch").alias("_b"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("first_model").alias("first_model"), F.sum(hinted).alias("decisions"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("epoch") < F.col("_top"), F.col("tool_set")))))).alias("tools"),
    )
    since = F.col("_uses") - 1
    rate = F.when((F.col("compactions") > 0) & (since >= 1), (F.col("current_ctx") - F.col("_start")) / since).when(F.col("talk") > 0, F.col("current_ctx") / F.col("talk")).otherwise(F.lit(0.0))
    seconds = (F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 1e6
    s = s.withColumn("growth_rate", rate).withColumns({
        "turns_left": sequence.distance(F.col("current_ctx"), F.col("growth_rate")), "usage_percent": F.col("current_ctx") * 100.0 / sequence.WINDOW,
        "since_cleanup": F.when(F.col("_uses") > 0, F.col("_uses")).otherwise(F.col("talk")),
        "drift": F.when(F.col("in_scope") + F.col("out_scope") > 0, F.col("out_scope") / (F.col("in_scope") + F.col("out_scope"))).otherwise(0.0),
        "snapshot_tokens": F.floor(F.col("snapshot_bytes") / 4), "image_tokens": F.floor(F.col("image_bytes") / IMAGE_TOKEN), "dollars": F.coalesce(F.col("dollars").cast("double"), F.lit(0.0)),
        "seconds": F.when(F.col("entries") < 2, 0.0).otherwise(F.coalesce(seconds, F.lit(0.0))),
    })
    unindexed = F.col("progress_tokens") + F.col("snapshot_tokens") + F.col("image_tokens") + F.col("large_tokens")
    s = s.withColumn("noise_tokens", F.col("union_tokens") + unindexed).withColumn("overlap_tokens", F.col("stale_tokens") + F.col("retry_tokens") + F.col("tangent_full") + F.col("side_tokens") - F.col("union_tokens"))
    biggest = F.array_sort(F.transform(F.filter(_items(), lambda i: i["rows"] > 0), lambda i: F.struct((-i["tokens"]).alias("t"), i["category"].alias("c"))))
    return s.withColumn("biggest", F.when(F.size(biggest) > 0, F.get(biggest, F.lit(0))["c"])).drop("_uses", "_start", "_a", "_b")


def _items() -> Column:
    """Every kind of cleanable content with its rows and tokens."""
    kinds = {
        "progress": ("progress_rows", "progress_tokens"), "snapshots": ("snapshot_rows", "snapshot_tokens"), "stale_reads": ("stale", "stale_tokens"), "images": ("images", "image_tokens"), "large_outputs": ("large", "large_tokens"),
        "failed_retries": ("retries", "retry_tokens"), "sidechains": ("side_rows", "side_tokens"), "tangents": ("tangent_rows", "tangent_tokens"),
    }
    return F.array(*[F.struct(F.lit(k).alias("category"), F.col(n).cast("long").alias("rows"), F.col(t).cast("long").alias("tokens")) for k, (n, t) in kinds.items()])


def derived(entries: DataFrame, blocks: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """The facts of entries and blocks, not written: a query that reads them once derives only the columns that it asks for."""
    return facts(epoch_facts(_frame(entries, blocks, prices, "30 minutes")))


def of(entries: DataFrame, blocks: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """The facts of entries and blocks, written."""
    return written(derived(entries, blocks, prices), "facts")


def recommend(s: DataFrame) -> DataFrame:
    """session, rank, category, rows, tokens, turns_gained: what cleaning would save, the most tokens first, ties by name."""
    each = s.select("session", "growth_rate", F.explode(F.filter(_items(), lambda i: i["rows"] > 0)).alias("i")).select("session", "growth_rate", "i.*")
    gained = F.when(F.col("growth_rate") > 0, F.floor(F.col("tokens") / F.col("growth_rate"))).otherwise(0).cast("long")
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("tokens"), "category")).cast("long")
    return each.select("session", rank.alias("rank"), "category", "rows", "tokens", gained.alias("turns_gained"))


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def noise_columns() -> dict[str, Column]:
    """What `noise_ledger` tells of a session's facts."""
    after = F.greatest(F.col("current_ctx") - F.col("noise_tokens"), F.lit(0)) * 100.0 / sequence.WINDOW
    return {
        "stale_reads": F.col("stale_tokens"), "failed_retries": F.col("retry_tokens"), "tangents": F.col("tangent_full"), "sidechains": F.col("side_tokens"), "noisy_rows": F.col("noisy_rows"),
        "union_tokens": F.col("union_tokens"), "overlap_tokens": F.col("overlap_tokens"), "total_tokens": F.col("noise_tokens"), "projected_percent": F.round(after, 4),
    }


def noise_ledger(s: DataFrame) -> DataFrame:
    """session, tokens of each indexed category with repeats, union_tokens with each row once, overlap_tokens, total with the other categories, projected_percent."""
    return s.select("session", *_named(noise_columns()))


def signal() -> Column:
    return F.when(F.col("current_ctx") <= 0, 100.0).otherwise(F.greatest(F.col("current_ctx") - F.col("noise_tokens"), F.lit(0)) * 100.0 / F.col("current_ctx"))


def health_columns() -> dict[str, Column]:
    """What `health` tells of a session's facts."""
    some = F.col("current_ctx") > 0
    return {
        "noise_tokens": F.when(some, F.col("noise_tokens")).otherwise(0), "signal_tokens": F.when(some, F.greatest(F.col("current_ctx") - F.col("noise_tokens"), F.lit(0))).otherwise(0),
        "signal_percent": F.round(signal(), 4), "grade": cost.grade(signal()), "biggest": F.when(some, F.col("biggest")),
    }


def health(s: DataFrame) -> DataFrame:
    """session, noise_tokens, signal_tokens, signal_percent, grade, biggest: how much of the context is signal; without context all of it."""
    return s.select("session", *_named(health_columns()))


def entropy_columns() -> dict[str, Column]:
    """What `entropy` tells of a session's facts."""
    orphans = F.when(F.col("current_ctx") > 0, F.least(F.col("side_tokens") / F.col("current_ctx"), F.lit(1.0))).otherwise(0.0)
    score = 100 * (
        0.30 * (1 - cost.grade_ratio(cost.grade(signal()))) + 0.25 * F.least(F.greatest(F.col("current_ctx"), F.lit(0)) / sequence.LIMIT, F.lit(1.0)) + 0.20 * F.col("drift")
        + 0.15 * orphans + 0.10 * F.least("compactions", F.lit(10)) / 10
    )
    rounded = F.round(score, 9)
    return {"score": rounded, "level": F.when(rounded <= 20, "LOW").when(rounded <= 50, "MEDIUM").when(rounded <= 75, "HIGH").otherwise("CRITICAL")}


def entropy(s: DataFrame) -> DataFrame:
    """session, score, level from the grade of the signal, fullness, drift, side chains' tokens and compactions."""
    return s.select("session", *_named(entropy_columns()))
