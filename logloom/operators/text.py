"""Text mining over turns and documents, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(turns: DataFrame, query: str, width: int = 40) -> DataFrame:
    """conv_id, turn, place, snippet: turns that hold a literal, case folded; place is its first, from 0."""
    at = F.locate(query.lower(), F.lower("text")) - 1
    start = F.greatest(F.col("place") - width // 2, F.lit(0))
    hit = turns.withColumn("place", at.cast("long")).filter("place >= 0")
    return hit.select("conv_id", "turn", "place", F.expr("text").substr((start + 1).cast("int"), F.lit(width)).alias("snippet"))


def estimate_tokens(turns: DataFrame) -> DataFrame:
    """conv_id, turns, tokens: bytes / 4 of each turn, cut off for each."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.floor(F.octet_length("text") / 4)).alias("tokens"))


def content_preview(turns: DataFrame, n: int = 60) -> DataFrame:
    """conv_id, turn, preview: the text, cut to n characters with an ellipsis."""
    cut = F.when(F.length("text") <= n, F.col("text")).otherwise(F.concat(F.substring("text", 1, n - 3), F.lit("...")))
    return turns.select("conv_id", "turn", cut.alias("preview"))


def hint(text: Column, keywords: list[str], limit: int = 120) -> Column:
    """The text around the first keyword of the list that it holds: from 20 before where there are so many."""
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        at = F.locate(k, F.lower(text))
        start = F.when(at - 1 > 20, at - 20).otherwise(at)
        piece = F.trim(text.substr(start, F.length(text)))
        cut = F.when(F.length(piece) <= limit, piece).otherwise(F.concat(F.substring(piece, 1, limit - 3), F.lit("...")))
        out = F.when(at > 0, cut).otherwise(out)
    return out


def decision_hints(turns: DataFrame, keywords: list[str]) -> DataFrame:
    """conv_id, turn, hint of turns that hold a keyword."""
    return turns.withColumn("hint", hint(F.col("text"), keywords)).filter("hint is not null").select("conv_id", "turn", "hint")


def coalesce_preview(turns: DataFrame) -> DataFrame:
    """conv_id, grp, role, turns, chars: runs of one role in a row."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.col("role") != F.lag("role").over(w)).cast("long"), F.lit(0))
    runs = turns.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "grp").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


def tasks(turns: DataFrame, todo: str, question: str) -> DataFrame:
    """kind, item, turns: lines that match a pattern or hold a question mark, once for each normalised text."""
    lines = turns.filter("role = 'user'").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    kind = F.when(F.lower("line").rlike(todo), "todo").when(F.col("line").contains("?") | F.lower("line").rlike(question), "question")
    item = F.lower(F.regexp_replace(F.trim("line"), r"\s+", " "))
    return lines.select(kind.alias("kind"), item.alias("item")).filter("kind is not null and item != ''").groupBy("kind", "item").agg(F.count("*").alias("turns"))


#: Lines that are rules of box-drawing or ASCII characters.
RULE = r"^\s*([─━═╌╍╴╶╸╺]{20,}|[-=~_]{40,})\s*$"


def strip_separators(docs: DataFrame) -> DataFrame:
    """doc_id, lines, stripped: lines that are rules of box-drawing or ASCII characters."""
    lines = F.split("text", "\n")
    return docs.select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x.rlike(RULE))).cast("long").alias("stripped"))


def truncate_outputs(docs: DataFrame, threshold: int = 4096, keep: int = 10) -> DataFrame:
    """doc_id, lines, kept_lines, kept_sha: texts of `threshold` bytes and over 2 keep + 1 lines lose their middle."""
    lines = F.split("text", "\n")
    long = (F.octet_length("text") >= threshold) & (F.size(lines) > 2 * keep + 1)
    n = F.size(lines)
    short = F.concat(F.slice(lines, 1, keep), F.array(F.concat(F.lit("["), (n - 2 * keep).cast("string"), F.lit(" lines left out]"))), F.slice(lines, -keep, keep))
    cut = F.when(long, F.array_join(short, "\n")).otherwise(F.col("text"))
    return docs.select("doc_id", n.cast("long").alias("lines"), F.when(long, F.lit(2 * keep + 1)).otherwise(n).cast("long").alias("kept_lines"), F.md5(cut).alias("kept_md5"))


def sections(docs: DataFrame, mark: str = "# ") -> DataFrame:
    """doc_id, section, heading, tokens: parts of a text that start with a heading line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith(mark)
    lines = lines.withColumn("section", F.sum(head.cast("long")).over(w)).filter("section > 0")
    return lines.groupBy("doc_id", "section").agg(F.min_by("line", "line_no").alias("heading"), F.sum(F.floor(F.octet_length("line") / 4)).alias("tokens"))


def heading_dedupe(parts: DataFrame) -> DataFrame:
    """doc_id, section, heading: the first section of each heading, by document and place."""
    first = parts.groupBy("heading").agg(F.min(F.struct("doc_id", "section")).alias("f"))
    return first.select("f.doc_id", "f.section", "heading")


def repeated_texts(docs: DataFrame, least: int = 100, key: str = "source") -> DataFrame:
    """text_md5, owners, copies, tokens: normalised texts of `least` bytes or more that several owners hold."""
    text = F.lower(F.regexp_replace(F.trim("text"), r"[ \n\t]+", " "))
    rows = docs.filter(F.octet_length("text") >= least).select(F.md5(text).alias("text_md5"), key, F.floor(F.octet_length("text") / 4).alias("t"))
    per = rows.groupBy("text_md5").agg(F.count_distinct(key).alias("owners"), F.count("*").alias("copies"), (F.sum("t") - F.min("t")).alias("tokens"))
    return per.filter("owners >= 2")


def comment_scan(pages: DataFrame, phrases: list[str]) -> DataFrame:
    """page_id, comments, hits: HTML comments, and those that hold a phrase."""
    found = F.regexp_extract_all(F.col("html"), F.lit("<!--(.*?)-->"), F.lit(1))
    hits = F.filter(found, lambda c: _any(c, phrases))
    return pages.select("page_id", F.size(found).cast("long").alias("comments"), F.size(hits).cast("long").alias("hits"))


def _any(column: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(column).contains(p)
    return out
