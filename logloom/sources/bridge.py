"""Session-log tables derived from generic event tables.

`entries` has one row per log line, `blocks` one per content block (tool call or tool result), so every
operator can be run, and checked by SQL, on tables that hold no logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


COMMANDS = (" git diff", " ls -l", " cat")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, idx, ts, type, uuid, parent_uuid, cwd, ctx and token counters, model, raw_size, tool, path, command, pattern, is_error, result_for, is_sidechain, project; tools and refs hold the one call of a row."""
    w = Window.partitionBy("session").orderBy("ts", "event_id")
    call = F.col("event_type").isin("click", "purchase")
    answer = F.col("event_type").isin("view", "error")
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), "event_id", "ts", "event_type", "value", "user_id",
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )
    rows = base.select(
        "session",
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        "ts",
        F.when(call, "assistant").when(answer, "user").otherwise("progress").alias("type"),
        F.col("event_id").alias("uuid"),
        F.when(F.col("k") == 13, F.col("event_id") + 1000000).otherwise(F.lag("event_id").over(w)).alias("parent_uuid"),
        F.lit("/w/r0").alias("cwd"),
        F.when(call, F.floor(F.col("value") * 400)).alias("ctx"),
        (F.lit(200) + F.col("k") * 40).cast("long").alias("raw_size"),
        F.when(F.col("event_type") == "click", F.when(F.col("k") % 10 == 4, "Bash").when(F.col("k") % 10 == 5, "Grep").otherwise("Read"))
        .when(F.col("event_type") == "purchase", F.when(F.col("k") % 4 == 1, "Write").otherwise("Edit")).alias("tool"),
        F.when(call, F.concat(F.lit("/w/r"), F.floor(F.col("k") / 25).cast("string"), F.lit("/f"), (F.col("k") % 10).cast("string"))).alias("path"),
        (F.col("k") == 29).alias("is_sidechain"),
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"),
        (F.col("event_type") == "error").alias("is_error"),
        F.when(answer, F.when(F.col("k") == 17, -F.col("event_id")).otherwise(F.max(F.when(call, F.col("event_id"))).over(w))).alias("result_for"),
    )
    part = lambda n: F.floor(F.col("ctx") / n)
    rows = rows.withColumn("command", F.when(F.col("tool") == "Bash", F.concat(F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("raw_size") % 3 + 1).cast("int")), F.lit(" /etc/hosts '"), "path", F.lit("' "))))
    rows = rows.withColumn("path", F.coalesce(F.element_at(paths.bash_paths(F.col("command")), 1), "path"))
    rows = rows.withColumn("pattern", F.when(F.col("tool") == "Grep", F.concat(F.lit("p"), (F.col("raw_size") % 3).cast("string"))))
    held = F.struct("path", "tool")
    rows = rows.withColumn("tools", F.when(F.col("tool").isNotNull(), F.array("tool")).otherwise(F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("refs", F.when(F.col("path").isNotNull(), F.array(held)).otherwise(F.slice(F.array(held), 1, 0)))
    return rows.withColumns({
        "input_tokens": part(10), "cache_creation_tokens": part(5), "cache_read_tokens": F.col("ctx") - part(10) - part(5),
        "output_tokens": F.when(F.col("ctx").isNotNull(), F.col("raw_size") - 200),
        "model": F.when(F.col("ctx").isNotNull(), F.when(F.col("raw_size") % 3 == 0, "m-large").when(F.col("raw_size") % 3 == 1, "m-mid-2026").otherwise("other")),
    })


def blocks(rows: DataFrame) -> DataFrame:
    """session, idx, kind, name, path, id, tool_use_id, is_error, raw_size, command, pattern of each tool call and tool result; the last two are null where `rows` has none."""
    kind = F.when(F.col("tool").isNotNull(), "tool_use").when(F.col("result_for").isNotNull(), "tool_result")
    found = rows.select(
        "session", "idx", kind.alias("kind"), F.col("tool").alias("name"), "path",
        F.when(F.col("tool").isNotNull(), F.col("uuid")).alias("id"), F.col("result_for").alias("tool_use_id"), "is_error", "raw_size",
        *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("command", "pattern")],
    )
    return found.filter("kind is not null")


def prices(spark: SparkSession) -> DataFrame:
    """Dollars for a million tokens by model prefix; the empty prefix is the default."""
    rows = [("m-large", 15.0, 75.0, 3.75, 0.75), ("m-mid", 3.0, 15.0, 0.75, 0.15), ("", 15.0, 75.0, 3.75, 0.75)]
    return spark.createDataFrame(rows, "prefix string, p_in double, p_out double, p_write double, p_read double")


#: The same tables for DuckDB.
SQL = """
e0 AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, ts, event_type, value, CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS k FROM events),
e1 AS (SELECT session, CAST(row_number() OVER w - 1 AS BIGINT) AS idx, ts,
  CASE WHEN event_type IN ('click','purchase') THEN 'assistant' WHEN event_type IN ('view','error') THEN 'user' ELSE 'progress' END AS type,
  event_id AS uuid, CASE WHEN k=13 THEN event_id+1000000 ELSE lag(event_id) OVER w END AS parent_uuid, '/w/r0' AS cwd,
  CASE WHEN event_type IN ('click','purchase') THEN CAST(floor(value*400) AS BIGINT) END AS ctx, CAST(200+k*40 AS BIGINT) AS raw_size,
  CASE event_type WHEN 'click' THEN CASE k%10 WHEN 4 THEN 'Bash' WHEN 5 THEN 'Grep' ELSE 'Read' END WHEN 'purchase' THEN CASE WHEN k%4=1 THEN 'Write' ELSE 'Edit' END END AS tool,
  k=29 AS is_sidechain, 'p'||CAST(CAST(session AS BIGINT)%10 AS VARCHAR) AS project,
  CASE WHEN event_type IN ('click','purchase') THEN '/w/r'||CAST(CAST(floor(k/25.0) AS INT) AS VARCHAR)||'/f'||CAST(k%10 AS VARCHAR) END AS path,
  event_type='error' AS is_error,
  CASE WHEN event_type IN ('view','error') THEN CASE WHEN k=17 THEN -event_id ELSE max(CASE WHEN event_type IN ('click','purchase') THEN event_id END) OVER w END END AS result_for
  FROM e0 WINDOW w AS (PARTITION BY session ORDER BY ts, event_id)),
e AS (SELECT *, CAST(floor(ctx/10.0) AS BIGINT) AS input_tokens, CAST(floor(ctx/5.0) AS BIGINT) AS cache_creation_tokens,
  ctx - CAST(floor(ctx/10.0) AS BIGINT) - CAST(floor(ctx/5.0) AS BIGINT) AS cache_read_tokens,
  CASE WHEN ctx IS NOT NULL THEN raw_size-200 END AS output_tokens,
  CASE WHEN ctx IS NOT NULL THEN CASE raw_size%3 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-mid-2026' ELSE 'other' END END AS model FROM e1),
b AS (SELECT session, idx, CASE WHEN tool='Bash' THEN 'Bash:'||(['git diff','ls -l','cat'])[raw_size%3+1]||' /etc/hosts '''||path||'''' WHEN tool='Grep' THEN 'Grep:p'||CAST(raw_size%3 AS VARCHAR)||':'||path ELSE tool||':'||path END AS sig, CASE WHEN tool IS NOT NULL THEN 'tool_use' ELSE 'tool_result' END AS kind, tool AS name, path,
  CASE WHEN tool IS NOT NULL THEN uuid END AS id, result_for AS tool_use_id, is_error, raw_size FROM e WHERE tool IS NOT NULL OR result_for IS NOT NULL),
c AS (SELECT session, idx, before_ctx, ctx FROM (SELECT session, idx, ctx, lag(ctx) OVER (PARTITION BY session ORDER BY idx) AS before_ctx FROM e WHERE ctx IS NOT NULL AND type='assistant')
  WHERE before_ctx > 0 AND before_ctx - ctx > 50000),
ep AS (SELECT e.*, CAST(sum(CASE WHEN c.idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.session ORDER BY e.idx) AS BIGINT) AS epoch
  FROM e LEFT JOIN c ON e.session=c.session AND e.idx=c.idx),
cost AS (SELECT *, CASE WHEN model='m-mid-2026' THEN (input_tokens*3.0+output_tokens*15.0+cache_creation_tokens*0.75+cache_read_tokens*0.15)/1e6
  ELSE (input_tokens*15.0+output_tokens*75.0+cache_creation_tokens*3.75+cache_read_tokens*0.75)/1e6 END AS dollars FROM ep WHERE ctx IS NOT NULL)
"""
