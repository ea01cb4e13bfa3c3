"""What lasts from epoch to epoch: dead tokens and their half-life, and how tools and files shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence, tools


def _turns(entries: DataFrame) -> DataFrame:
    """The assistant rows with epoch, their session's last epoch, spent (output tokens, without them bytes div 4) and paths that calls name."""
    rows = sequence.assign_epochs(entries).withColumn("last", F.max("epoch").over(Window.partitionBy("session"))).filter("type = 'assistant'")
    spent = F.when(F.coalesce(F.col("output_tokens"), F.lit(0)) > 0, F.col("output_tokens")).otherwise(F.floor(F.col("raw_size") / 4))
    named = F.transform(F.filter("refs", lambda r: ~r["tool"].isin(*tools.BASH)), lambda r: r["path"])
    return rows.select("session", "idx", "epoch", "last", spent.cast("long").alias("spent"), F.array_distinct(named).alias("paths"), "tools")


def half_life(entries: DataFrame) -> DataFrame:
    """session, epoch, turns, tokens, files, decay, dead_percent, half_life, dead_share, by epoch; sessions of under two turns are left out.

    decay is the share of an epoch's files that no later epoch touches; dead_percent weighs it by the epoch's age.
    half_life is the number of turns of the epoch in which the dead tokens so far reach half of all tokens, one at
    least, or all turns where they never do. The row at which a context is compacted ends its turn in the epoch before.
    """
    rows = _turns(entries)
    per = rows.groupBy("session", "epoch").agg(F.max("last").alias("last"), F.count("*").alias("n"), F.sum("spent").alias("tokens"))
    files = rows.select("session", "epoch", F.explode("paths").alias("path")).distinct()
    files = files.withColumn("ends", F.max("epoch").over(Window.partitionBy("session", "path")))
    files = files.groupBy("session", "epoch").agg(F.count("*").alias("files"), F.count_if(F.col("ends") == F.col("epoch")).alias("left"))
    e = per.join(files, ["session", "epoch"], "left").na.fill(0, ["files", "left"])
    open_, at = F.col("epoch") < F.col("last"), Window.partitionBy("session")
    e = e.withColumn("turns", F.col("n") - (F.col("epoch") > 0).cast("long") + open_.cast("long"))
    e = e.withColumn("decay", F.when(open_ & (F.col("files") > 0), F.col("left") / F.col("files")).otherwise(0.0))
    e = e.withColumn("dead_percent", F.when(open_, F.col("decay") * ((F.col("last") - F.col("epoch")) / F.col("last")) * 100).otherwise(0.0))
    e = e.withColumn("dead", F.floor(F.col("tokens") * F.col("dead_percent") / 100).cast("long"))
    e = e.withColumn("so_far", F.sum("dead").over(at.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))).withColumns({"all": F.sum("tokens").over(at), "every": F.sum("n").over(at)})
    met = F.min(F.when(F.col("so_far") >= F.floor(F.col("all") / 2), F.struct("epoch", "turns"))).over(at)
    share = F.when(F.col("all") > 0, F.sum("dead").over(at) / F.col("all") * 100).otherwise(0.0)
    e = e.withColumn("half_life", F.when(met.isNull(), F.col("every")).otherwise(F.greatest(met["turns"], F.lit(1)))).withColumn("dead_share", F.round(share, 6)).filter("every >= 2")
    return e.select("session", "epoch", "turns", "tokens", "files", F.round("decay", 6).alias("decay"), F.round("dead_percent", 6).alias("dead_percent"), "half_life", "dead_share")


def direction(before: Column, after: Column) -> Column:
    """new, dropped, increased or decreased; null where nothing changed."""
    return F.when(before == after, None).when(before == 0, "new").when(after == 0, "dropped").when(after > before, "increased").otherwise("decreased")


def tool_shifts(entries: DataFrame) -> DataFrame:
    """session, epoch, rank, tool, before, after, direction: calls of a tool against the epoch before; the largest changes first, ties by name."""
    calls = _turns(entries).select("session", "epoch", "last", F.explode("tools").alias("tool")).groupBy("session", "epoch", "last", "tool").agg(F.count("*").alias("n"))
    own = calls.filter("epoch > 0").select("session", "epoch", "tool", F.lit(0).cast("long").alias("b"), F.col("n").alias("a"))
    ahead = calls.filter("epoch < last").select("session", (F.col("epoch") + 1).alias("epoch"), "tool", F.col("n").alias("b"), F.lit(0).cast("long").alias("a"))
    both = own.unionByName(ahead).groupBy("session", "epoch", "tool").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
    both = both.withColumn("direction", direction(F.col("before"), F.col("after"))).filter("direction is not null")
    w = Window.partitionBy("session", "epoch").orderBy(F.desc(F.abs(F.col("after") - F.col("before"))), "tool")
    return both.select("session", "epoch", F.row_number().over(w).cast("long").alias("rank"), "tool", "before", "after", "direction")


def scope_word(added: Column, dropped: Column) -> Column:
    return F.when((added > 0) & (dropped > 0), "shifted").when(added > 0, "expanded").when(dropped > 0, "contracted").otherwise("stable")


def scope_shifts(entries: DataFrame) -> DataFrame:
    """session, epoch, added, dropped, kept, scope, token_delta: files and tokens of an epoch's calls against the epoch before."""
    per = _turns(entries).groupBy("session", "epoch").agg(F.array_distinct(F.flatten(F.collect_list("paths"))).alias("files"), F.sum("spent").alias("tokens"))
    w = Window.partitionBy("session").orderBy("epoch")
    pairs = per.withColumns({"was": F.lag("files").over(w), "had": F.lag("tokens").over(w)}).filter("was is not null")
    n = lambda c: F.size(c).cast("long")
    pairs = pairs.withColumns({"added": n(F.array_except("files", "was")), "dropped": n(F.array_except("was", "files")), "kept": n(F.array_intersect("files", "was"))})
    return pairs.select("session", "epoch", "added", "dropped", "kept", scope_word(F.col("added"), F.col("dropped")).alias("scope"), (F.col("tokens") - F.col("had")).alias("token_delta"))
