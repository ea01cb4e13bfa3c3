"""Session logs with many blocks a row, derived from the event table as JSON lines.

`LINES` is SQL that Spark and DuckDB both read; it makes one line of an agent's log of each event. Spark scans and parses the
lines; `SQL` has, for DuckDB, the tables that the parser should find in them: `le` entries, `lb` blocks, `lr` references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridge, jsonl
from .scratch import dealt, split_methods, written

CALLS = 3


def _call(j: int) -> dict[str, str]:
    """Tool, path as typed, clean path, command and pattern of a row's call number `j`."""
    n = f"((k + {j}) % 10)"
    tool = f"CASE WHEN et = 'purchase' THEN CASE WHEN k % 4 = 1 THEN 'Write' ELSE 'Edit' END WHEN {n} = 4 THEN 'Bash' WHEN {n} = 5 THEN 'Grep' WHEN {n} = 7 THEN 'Write' ELSE 'Read' END"
    folder = f"concat('/w/r', cast(cast(floor((k + {30 * j}) / 25) as int) % 4 as string), '/')"
    file = f"concat('f', cast((k + {j}) % 4 as string))"
    typed = f"CASE WHEN k % 6 = 4 THEN concat({folder}, './x/../', {file}) ELSE concat({folder}, {file}) END"
    return {"tool": tool, "typed": typed, "path": f"concat({folder}, {file})", "id": f"concat('t', cast(eid as string), '_{j}')"}


_C = [_call(j) for j in range(CALLS)]
_ANSWERS = "et IN ('view', 'error') AND k % 9 <> 2"
_RESULT = "CASE WHEN k % 11 = 0 THEN 'Error: No such file' WHEN k > 80 THEN repeat('ab ', 1500) ELSE concat('line ', repeat('x', k * 20)) END"

#: One row an event: what its line says. Dialects agree on all of it.
_G = f"""g0 AS (SELECT cast(user_id as string) AS session, event_id AS eid, ts, event_type AS et, value AS v, cast(regexp_extract(props, '[0-9]+', 0) as int) AS k, user_id FROM {{events}}),
g1 AS (SELECT *, cast(row_number() OVER w - 1 as bigint) AS idx, lag(eid) OVER w AS up, et IN ('click', 'purchase') AS calls, {_ANSWERS} AS answers,
 max(CASE WHEN et IN ('click', 'purchase') THEN eid END) OVER w AS last_call FROM g0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, eid)),
g AS (SELECT *, CASE WHEN calls THEN CASE WHEN et = 'purchase' THEN 1 ELSE 1 + k % 3 END ELSE 0 END AS n_calls,
 CASE WHEN calls THEN 'assistant' WHEN et IN ('view', 'error') OR k % 4 = 2 THEN 'user' WHEN k % 4 = 0 THEN 'progress' WHEN k % 4 = 1 THEN 'file-history-snapshot' ELSE 'system' END AS type,
 CASE WHEN k = 13 THEN concat('gone', cast(eid as string)) WHEN up IS NOT NULL THEN concat('u', cast(up as string)) END AS parent_uuid,
 CASE WHEN k % 17 = 3 THEN '/w/r1' WHEN k % 5 = 1 THEN '' ELSE '/w/r0' END AS cwd,
 cast(floor(v * 40) as bigint) AS t_in, cast(floor(v * 80) as bigint) AS t_write, cast(floor(v * 280) as bigint) AS t_read, cast(k * 40 as bigint) AS t_out,
 CASE k % 3 WHEN 0 THEN 'm-large' WHEN 1 THEN 'm-mid-2026' ELSE 'other' END AS model,
 CASE WHEN calls AND k % 5 = 0 THEN concat('We decided to use plan ', cast(k as string), ' here.') WHEN calls AND k % 5 = 3 THEN concat('Found that file ', cast(k % 7 as string), ' must not change.')
  WHEN et IN ('view', 'error') AND NOT ({_ANSWERS}) THEN concat('What about part ', cast(k as string), '?') WHEN et = 'signup' AND k % 4 = 2 THEN 'See this picture' END AS words,
 {_RESULT} AS result, et = 'error' AS failed, lpad(cast(k as string), 4, '0') AS picture FROM g1)"""


def _use(j: int) -> str:
    c = _C[j]
    bash = f"""concat('"command":"cat ', {c["typed"]}, ' /etc/hosts"')"""
    grep = f"""concat('"path":"', {c["typed"]}, '","pattern":"p', cast(k % 3 as string), '"')"""
    given = f"CASE {c['tool']} WHEN 'Bash' THEN {bash} WHEN 'Grep' THEN {grep} ELSE concat('\"file_path\":\"', {c['typed']}, '\"') END"
    return f"""CASE WHEN n_calls > {j} THEN concat(',{{{{"id":"', {c["id"]}, '","input":{{{{', {given}, '}}}},"name":"', {c["tool"]}, '","type":"tool_use"}}}}') ELSE '' END"""


def _answer(j: int) -> str:
    return f"""concat(',{{{{"content":"', result, CASE WHEN failed AND {j} = 0 THEN '","is_error":true' ELSE '"' END, ',"tool_use_id":"t', coalesce(cast(last_call as string), 'none'), '_{j}","type":"tool_result"}}}}')"""


_TEXT = """concat(',{{"text":"', words, '","type":"text"}}')"""
_IMAGE = """',{{"source":{{"data":"', repeat(picture, 400), '","media_type":"image/png","type":"base64"}},"type":"image"}}'"""
_LIST = f"""concat('[', substr(concat(CASE WHEN words IS NOT NULL THEN {_TEXT} ELSE '' END, {", ".join(_use(j) for j in range(CALLS))}), 2), ']')"""
_CONTENT = f"""CASE WHEN calls THEN {_LIST} WHEN answers THEN concat('[', substr(concat({_answer(0)}, CASE WHEN k % 3 = 0 THEN {_answer(1)} ELSE '' END), 2), ']')
 WHEN et = 'signup' AND k % 4 = 2 THEN concat('[', substr(concat({_TEXT}, {_IMAGE}), 2), ']') ELSE concat('"', words, '"') END"""
_USAGE = """CASE WHEN calls THEN concat(',"model":"', model, '","usage":{{"input_tokens":', cast(t_in as string), ',"output_tokens":', cast(t_out as string), ',"cache_creation_input_tokens":', cast(t_write as string), ',"cache_read_input_tokens":', cast(t_read as string), '}}') ELSE '' END"""
_TWO = "lpad(cast({}(ts) as string), 2, '0')"
_STAMP = "concat(cast(year(ts) as string), '-', " + ", '-', ".join(_TWO.format(p) for p in ("month", "day")) + ", 'T', " + ", ':', ".join(_TWO.format(p) for p in ("hour", "minute", "second")) + ", 'Z')"
#: session, project, line, raw of every line.
LINES = f"""{_G},
raw AS (SELECT *, concat('{{{{"type":"', type, '","uuid":"u', cast(eid as string), '"', CASE WHEN parent_uuid IS NOT NULL THEN concat(',"parentUuid":"', parent_uuid, '"') ELSE '' END, ',"timestamp":"', {_STAMP}, '"',
 CASE WHEN cwd <> '' THEN concat(',"cwd":"', cwd, '"') ELSE '' END, CASE WHEN k = 29 THEN ',"isSidechain":true' ELSE '' END,
 CASE WHEN type IN ('assistant', 'user') THEN concat(',"message":{{{{"role":"', type, '","content":', {_CONTENT}, {_USAGE}, '}}}}') ELSE '' END, '}}}}') AS raw FROM g)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, project, modified, line, raw of the log that the events make."""
    text = "WITH " + LINES + " SELECT session, concat('p', cast(user_id % 10 as string)) AS project, ts AS modified, idx + 1 AS line, raw FROM raw"
    return spark.sql(text, events=dealt(bridge.table(spark, sf_dir, "events"), "user_id"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the log, parsed and written."""
    with split_methods(spark):
        return written(jsonl.parse(lines(spark, sf_dir)), "entries")


def folded(spark: SparkSession, sf_dir: str, own: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The rows of the log with small blocks (see `jsonl.fold`) and what `own` adds to them, parsed and written."""
    with split_methods(spark):
        return written(own(jsonl.fold(lines(spark, sf_dir))), "entries")


def _for_duckdb(text: str) -> str:
    return text.replace("{events}", "events").replace("{{", "{").replace("}}", "}")


_BLOCKS = " UNION ALL ".join(
    [
        "SELECT session, idx, 0 AS block_idx, 'text' AS kind, NULL AS name, NULL AS id, NULL AS tool_use_id, NULL AS path, NULL AS command, NULL AS pattern, false AS is_error, words AS text, NULL AS result, NULL AS data FROM g WHERE words IS NOT NULL AND type IN ('assistant', 'user')",
        *[
            f"SELECT session, idx, {j} + CASE WHEN words IS NULL THEN 0 ELSE 1 END, 'tool_use', {c['tool']}, {c['id']}, NULL, CASE WHEN ({c['tool']}) <> 'Bash' THEN {c['path']} END, CASE WHEN ({c['tool']}) = 'Bash' THEN concat('cat ', {c['typed']}, ' /etc/hosts') END, CASE WHEN ({c['tool']}) = 'Grep' THEN concat('p', cast(k % 3 as string)) END, false, NULL, NULL, NULL FROM g WHERE n_calls > {j}"
            for j, c in enumerate(_C)
        ],
        *[
            f"SELECT session, idx, {j}, 'tool_result', NULL, NULL, concat('t', coalesce(cast(last_call as string), 'none'), '_{j}'), NULL, NULL, NULL, (failed AND {j} = 0) OR k % 11 = 0, NULL, result, NULL FROM g WHERE answers AND ({j} = 0 OR k % 3 = 0)"
            for j in range(2)
        ],
        "SELECT session, idx, 1, 'image', NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL, repeat(picture, 400) FROM g WHERE et = 'signup' AND k % 4 = 2",
    ]
)
_REFS = " UNION ALL ".join(f"SELECT session, idx, {j} + CASE WHEN ({c['tool']}) = 'Bash' THEN 10 ELSE 0 END AS place, {c['tool']} AS tool, {c['path']} AS path FROM g WHERE n_calls > {j}" for j, c in enumerate(_C))
SQL = f"""{_for_duckdb(LINES)},
le AS (SELECT session, 'p' || CAST(user_id % 10 AS VARCHAR) AS project, idx, date_trunc('second', ts) AS ts, type, 'u' || eid AS uuid, parent_uuid, cwd, k = 29 AS is_sidechain, CASE WHEN calls THEN model END AS model,
 CASE WHEN calls THEN t_in + t_write + t_read END AS ctx, CASE WHEN calls THEN t_in END AS input_tokens, CASE WHEN calls THEN t_out END AS output_tokens, CASE WHEN calls THEN t_write END AS cache_creation_tokens, CASE WHEN calls THEN t_read END AS cache_read_tokens,
 CAST(strlen(raw) AS BIGINT) AS raw_size, raw, words AS text, type IN ('assistant', 'user') AS conv, k FROM raw),
lb AS MATERIALIZED ({_BLOCKS}),
lr AS MATERIALIZED ({_REFS})"""


def with_sql(body: str, *more: str) -> str:
    """DuckDB SQL over `le`, `lb`, `lr` and further CTEs."""
    return "WITH " + ",\n".join([SQL, *more]) + "\n" + body
