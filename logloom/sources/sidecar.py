"""Files beside session logs: markers, savings, snapshots and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINT = "struct<uuid:string,timestamp:string,goal:string,decisions:array<string>,constraints:array<string>,questions:array<string>,files:array<string>>"
MARKERS = f"version int, markers map<string,string>, phases map<string,string>, commit_points array<{POINT}>, bookmarks map<string,struct<type:string,label:string>>"
SAVINGS = "session_id string, slug string, timestamp string, tokens_removed long, turns_remaining long, model string, avoided_tokens long, avoided_cost double"


def _files(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(path)
    return rows.withColumn("session", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[a-z-]+)*\.json$", 1))


def scan_markers(spark: SparkSession, path: str, pattern: str = "*.json") -> dict[str, DataFrame]:
    """markers, phases (session, uuid, label), bookmarks (session, uuid, type, label) and commit_points of all marker files.

    Files without a part give no rows of it; a file that is no JSON gives none at all.
    """
    files = _files(spark, path, MARKERS, pattern)

    def labels(part: str) -> DataFrame:
        return files.select("session", F.explode(part).alias("uuid", "label"))

    marks = files.select("session", F.explode("bookmarks").alias("uuid", "b")).select("session", "uuid", "b.type", "b.label")
    points = files.select("session", F.explode("commit_points").alias("p")).select("session", "p.*").withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return {"markers": labels("markers"), "phases": labels("phases"), "bookmarks": marks, "commit_points": points.withColumnRenamed("timestamp", "ts")}


def scan_savings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Savings events of JSON array files or, with `lines`, of the JSON lines that `append_savings` writes."""
    rows = spark.read.schema(SAVINGS).option("multiLine", str(not lines).lower()).json(path)
    return rows.filter("session_id is not null").withColumn("ts", F.try_to_timestamp("timestamp")).drop("timestamp", "batch")


def _append(rows: DataFrame, path: str, batch: str | int | None) -> None:
    """Adds rows to a folder of JSON lines; a batch has a folder of its own, which a second run of it replaces."""
    out = rows.write.option("lineSep", "\n")
    if batch is None:
        out.mode("append").json(path)
    else:
        out.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def append_savings(events: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Adds events (columns of `scan_savings`) to a folder and rewrites none of another batch.

    With `batch`, which names the run (a stream's batch id), running it again does not double its events; a folder takes
    either batches or plain appends.
    """
    kept = events.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    _append(kept.select("session_id", "slug", "timestamp", "tokens_removed", "turns_remaining", "model", "avoided_tokens", "avoided_cost"), path, batch)


def append_snapshots(snapshots: DataFrame, path: str, batch: str | int) -> None:
    """Adds a batch of snapshots to a folder; running the batch again replaces it."""
    _append(snapshots, path, batch)


def scan_snapshots(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The snapshots that `append_snapshots` has written, with the columns of `schema`."""
    return spark.read.schema(schema).json(path).select(*schema.names)


def scan_commits(lines: DataFrame) -> DataFrame:
    """hash, ts, path, added, deleted of an exported log: lines (hash, ts, line) of tab-separated numstat; binary rows go."""
    parts = F.split("line", "\t", 3)
    rows = lines.filter(F.size(parts) == 3).select("hash", "ts", F.element_at(parts, 3).alias("path"), parts[0].try_cast("long").alias("added"), parts[1].try_cast("long").alias("deleted"))
    return rows.filter("added is not null and deleted is not null")


def export_snapshots_csv(snapshots: DataFrame, path: str) -> None:
    """Snapshots as CSV with a header: dollars to four places, other doubles to two, in the order of the columns."""
    cols = [F.format_string("%.4f" if c in ("cost", "dollars") else "%.2f", c).alias(c) if t == "double" else F.col(c) for c, t in snapshots.dtypes if not t.startswith(("map", "array", "struct"))]
    snapshots.select(*cols).write.option("header", "true").csv(path)
