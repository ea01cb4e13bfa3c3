"""Queries that clean whole logs and follow what lasts from epoch to epoch, and their SQL.

`clean_log` and `clean_log_audit` cascade between phases; they have no SQL and are tested against logs made by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decay, nearness, phases
from ..sources import eventlog, jsonl
from ..sources.eventlog import with_sql
from . import logs


def _rows(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(eventlog.entries(spark, d))


def _coalesced(rows: DataFrame) -> DataFrame:
    n = F.coalesce(F.size(jsonl.content_blocks(F.col("content"))), F.lit(0))
    return phases.coalesce(rows).select("session", "idx", "uuid", "parent_uuid", F.greatest(n, F.lit(0)).cast("long").alias("blocks"), "merged", "stripped")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "coalesce_log": _rows(_coalesced),
    "clean_log": _rows(lambda e: phases.clean_log(e)[0].select("session", "idx", "uuid", "parent_uuid", "type", "raw_size")),
    "clean_log_audit": _rows(lambda e: phases.clean_log(e)[1]),
    "half_life_epochs": _rows(decay.half_life),
    "tool_shifts": _rows(decay.tool_shifts),
    "scope_shifts": _rows(decay.scope_shifts),
    "temporal_classes": _rows(nearness.temporal_classes),
}

_W = "PARTITION BY session ORDER BY idx"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
#: Runs of one role, the rows that stand for them, their blocks and the calls that answers may refer to.
_RUNS = [
    "q0 AS (SELECT session, idx, uuid, parent_uuid, CASE WHEN conv THEN type END AS role, type IN ('system','queue-operation','progress') AS clear, coalesce(conv AND type='user' AND text LIKE 'What about%', false) AS plain FROM le)",
    f"q1 AS (SELECT *, last_value(CASE WHEN NOT clear THEN coalesce(role,'') END IGNORE NULLS) OVER ({_W} {_BEFORE}) AS earlier FROM q0)",
    f"q2 AS (SELECT *, NOT clear AND (role IS NULL OR earlier IS NULL OR earlier<>role) AS opens, sum(CASE WHEN NOT clear AND (role IS NULL OR earlier IS NULL OR earlier<>role) THEN 1 ELSE 0 END) OVER ({_W}) AS grp FROM q1)",
    "q3 AS (SELECT session, grp, count(*) AS n, min(idx) AS head, arg_min(uuid, idx) AS uuid FROM q2 WHERE role IS NOT NULL GROUP BY session, grp HAVING count(*)>1)",
    """q4 AS (SELECT q.session, q.idx AS old, q.uuid, q.role, CASE WHEN q.opens THEN coalesce(p.uuid, q.parent_uuid) ELSE q.parent_uuid END AS parent_uuid, CASE WHEN q.idx=g.head THEN g.n-1 ELSE 0 END AS merged,
 g.n IS NULL AND q.plain AS plain, CAST(row_number() OVER (PARTITION BY q.session ORDER BY q.grp, g.n IS NOT NULL AND q.role IS NOT NULL, q.idx)-1 AS BIGINT) AS idx
 FROM q2 q LEFT JOIN q3 g ON g.session=q.session AND g.grp=q.grp LEFT JOIN q3 p ON p.session=q.session AND p.grp+1=q.grp WHERE g.n IS NULL OR q.role IS NULL OR q.idx=g.head)""",
    "qb AS (SELECT b.session, b.kind, b.id, b.tool_use_id, coalesce(CASE WHEN q.role IS NOT NULL THEN g.head END, b.idx) AS old FROM lb b JOIN q2 q ON q.session=b.session AND q.idx=b.idx LEFT JOIN q3 g ON g.session=q.session AND g.grp=q.grp)",
    f"q5 AS (SELECT *, lag(old) OVER ({_W}) AS call_row, lag(role) OVER ({_W}) AS call_role FROM q4 WHERE role IS NOT NULL AND NOT plain)",
    """q6 AS (SELECT q.session, q.old, count(*) AS lost FROM q5 q JOIN qb b ON b.session=q.session AND b.old=q.old AND b.kind='tool_result'
 WHERE NOT coalesce(q.role='user' AND q.call_role='assistant' AND EXISTS (SELECT 1 FROM qb u WHERE u.session=q.session AND u.old=q.call_row AND u.kind='tool_use' AND u.id=b.tool_use_id), false) GROUP BY ALL)""",
    "q7 AS (SELECT session, old, count(*) AS n FROM qb GROUP BY ALL)",
]
#: Turns with epoch and spent tokens, and the files that their calls name.
_TURNS = [
    "tu AS (SELECT session, idx, epoch, max(epoch) OVER (PARTITION BY session) AS last, type, CASE WHEN output_tokens>0 THEN output_tokens ELSE raw_size//4 END AS spent FROM lq)",
    "ta AS (SELECT * FROM tu WHERE type='assistant')",
    "fi AS (SELECT DISTINCT session, epoch, path FROM lr JOIN ta USING (session, idx) WHERE tool<>'Bash')",
    "pe AS (SELECT session, epoch, max(last) AS last, count(*) AS n, CAST(sum(spent) AS BIGINT) AS tokens FROM ta GROUP BY ALL)",
]

ORACLE_SQL: dict[str, str] = {
    "coalesce_log": with_sql(
        """SELECT q4.session, q4.idx, q4.uuid, q4.parent_uuid, CASE WHEN coalesce(q7.n,0)>0 AND coalesce(q7.n,0)=coalesce(lost,0) THEN 1 ELSE coalesce(q7.n,0)-coalesce(lost,0) END AS blocks, merged, coalesce(lost,0) AS stripped
        FROM q4 LEFT JOIN q6 USING (session, old) LEFT JOIN q7 USING (session, old)""",
        *_RUNS,
    ),
    "half_life_epochs": with_sql(
        """SELECT session, epoch, turns, tokens, files, round(decay,6) AS decay, round(dead_percent,6) AS dead_percent, CASE WHEN met IS NULL THEN every ELSE greatest(min(CASE WHEN epoch=met THEN turns END) OVER s, 1) END AS half_life, round(CASE WHEN total>0 THEN sum(dead) OVER s/total*100 ELSE 0 END,6) AS dead_share
        FROM (SELECT *, min(CASE WHEN so_far>=total//2 THEN epoch END) OVER (PARTITION BY session) AS met FROM hs) WHERE every>=2 WINDOW s AS (PARTITION BY session)""",
        logs.ROWS,
        *_TURNS,
        "fl AS (SELECT session, epoch, count(*) AS files, count(*) FILTER (WHERE ends=epoch) AS gone FROM (SELECT *, max(epoch) OVER (PARTITION BY session, path) AS ends FROM fi) GROUP BY ALL)",
        "hd AS (SELECT pe.*, coalesce(files,0) AS files, n - CAST(epoch>0 AS BIGINT) + CAST(epoch<last AS BIGINT) AS turns, CASE WHEN epoch<last AND coalesce(files,0)>0 THEN gone/CAST(files AS DOUBLE) ELSE 0 END AS decay FROM pe LEFT JOIN fl USING (session, epoch))",
        "hp AS (SELECT *, CASE WHEN epoch<last THEN decay*((last-epoch)/CAST(last AS DOUBLE))*100 ELSE 0 END AS dead_percent FROM hd)",
        "hc AS (SELECT *, CAST(floor(tokens*dead_percent/100) AS BIGINT) AS dead, CAST(sum(tokens) OVER (PARTITION BY session) AS BIGINT) AS total, CAST(sum(n) OVER (PARTITION BY session) AS BIGINT) AS every FROM hp)",
        "hs AS (SELECT *, CAST(sum(dead) OVER (PARTITION BY session ORDER BY epoch) AS BIGINT) AS so_far FROM hc)",
    ),
    "tool_shifts": with_sql(
        """SELECT session, epoch, row_number() OVER (PARTITION BY session, epoch ORDER BY abs(after-before) DESC, tool) AS rank, tool, before, after,
        CASE WHEN before=0 THEN 'new' WHEN after=0 THEN 'dropped' WHEN after>before THEN 'increased' ELSE 'decreased' END AS direction FROM sh WHERE before<>after""",
        logs.ROWS,
        *_TURNS,
        "cn AS (SELECT session, epoch, last, name AS tool, count(*) AS n FROM lb JOIN ta USING (session, idx) WHERE kind='tool_use' GROUP BY ALL)",
        """sh AS (SELECT session, epoch, tool, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM (SELECT session, epoch, tool, 0 AS b, n AS a FROM cn WHERE epoch>0
        UNION ALL SELECT session, epoch+1, tool, n, 0 FROM cn WHERE epoch<last) GROUP BY ALL)""",
    ),
    "scope_shifts": with_sql(
        """SELECT session, epoch, added, dropped, kept, CASE WHEN added>0 AND dropped>0 THEN 'shifted' WHEN added>0 THEN 'expanded' WHEN dropped>0 THEN 'contracted' ELSE 'stable' END AS scope, token_delta FROM
        (SELECT p.session, p.epoch, (SELECT count(*) FROM fi x WHERE x.session=p.session AND x.epoch=p.epoch AND NOT EXISTS (SELECT 1 FROM fi y WHERE y.session=x.session AND y.epoch=p.epoch-1 AND y.path=x.path)) AS added,
        (SELECT count(*) FROM fi x WHERE x.session=p.session AND x.epoch=p.epoch-1 AND NOT EXISTS (SELECT 1 FROM fi y WHERE y.session=x.session AND y.epoch=p.epoch AND y.path=x.path)) AS dropped,
        (SELECT count(*) FROM fi x JOIN fi y ON y.session=x.session AND y.path=x.path AND y.epoch=x.epoch-1 WHERE x.session=p.session AND x.epoch=p.epoch) AS kept, p.tokens-o.tokens AS token_delta
        FROM pe p JOIN pe o ON o.session=p.session AND o.epoch=p.epoch-1)""",
        logs.ROWS,
        *_TURNS,
    ),
    "temporal_classes": with_sql(
        """SELECT x.project, x.session, count(*) FILTER (WHERE y.a<x.a) AS starts_before, count(*) FILTER (WHERE y.b<=x.b) AS ends_at, count(*) FILTER (WHERE y.a<=x.b+INTERVAL 1 DAY) AS reach, count(*) FILTER (WHERE y.b<x.a-INTERVAL 1 DAY) AS passed,
        count(*) FILTER (WHERE y.session<>x.session AND y.a<=x.b+INTERVAL 1 DAY AND y.b>=x.a-INTERVAL 1 DAY) AS links FROM sp x JOIN sp y ON y.project=x.project GROUP BY ALL""",
        "sp AS (SELECT project, session, min(ts) AS a, max(ts) AS b FROM le GROUP BY ALL)",
    ),
}
