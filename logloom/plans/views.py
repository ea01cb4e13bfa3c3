"""Queries of the session views with their SQL; `build` takes the pieces that the catalog shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost, cross, scoring, views
from ..sources import bridge

_BRANCHES = """br AS (SELECT *, CAST(sum(CASE WHEN cut OR quiet THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY idx) AS BIGINT) AS branch FROM
 (SELECT *, coalesce(lag(epoch) OVER w <> epoch,false) AS cut, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR,false) AS quiet FROM ep WINDOW w AS (PARTITION BY session ORDER BY idx)))"""
_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, {0} ORDER BY n DESC, repo) AS k FROM (SELECT session, {0}, regexp_extract(path,'^/w/r[0-9]+',0) AS repo, count(*) AS n FROM {1} WHERE path IS NOT NULL AND NOT starts_with(path,'/w/r0/') GROUP BY ALL)) WHERE k=1"
_BRANCH_COSTS = f"""SELECT p.session, p.branch, p.entries, coalesce(d.dollars,0) AS dollars, r.repo FROM (SELECT session, branch, count(*) AS entries FROM br GROUP BY ALL) p
 LEFT JOIN (SELECT br.session, br.branch, round(CAST(sum(CAST(cost.dollars AS DECIMAL(20,9))) AS DOUBLE),9) AS dollars FROM br JOIN cost ON cost.session=br.session AND cost.idx=br.idx GROUP BY ALL) d ON d.session=p.session AND d.branch=p.branch
 LEFT JOIN ({_BEST.format("branch", "br")}) r ON r.session=p.session AND r.branch=p.branch"""
_NEXT = "SELECT session, lead(session) OVER (PARTITION BY project ORDER BY a, session) AS next_session FROM (SELECT project, session, min(ts) AS a FROM e GROUP BY ALL)"
_LIGHT = """lw AS (SELECT session, arg_max(struct_pack(p := parent_uuid), idx).p AS p, 0 AS d, true AS ok FROM e GROUP BY session
 UNION ALL SELECT lw.session, k.parent_uuid, lw.d+1, k.uuid IS NOT NULL FROM lw LEFT JOIN e k ON k.session=lw.session AND k.uuid=lw.p WHERE lw.p IS NOT NULL AND lw.ok AND lw.d<5)"""
_WALK = """walk AS (SELECT session, uuid, parent_uuid, 0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY idx DESC) AS r FROM e) WHERE r=1
 UNION ALL SELECT e.session, e.uuid, e.parent_uuid, w.d+1 FROM walk w JOIN e ON e.session=w.session AND e.uuid=w.parent_uuid)"""
_CLASSES = "(VALUES ('Read','file_read'),('Read','native'),('Grep','grep_like'),('Grep','native'),('Bash','bash'),('Bash','modifying'),('Edit','file_write'),('Edit','write'),('Edit','modifying'),('Edit','native'),('Write','file_write'),('Write','write'),('Write','modifying'),('Write','native')) v(tool, class)"


def build(entries, blocks, both, priced, scored, of, sql, tangent, pieces: dict[str, str], oracle: dict[str, str]) -> tuple[dict, dict]:
    """(queries, SQL). The arguments are the catalog's helpers, its shared pieces of SQL and its SQL so far."""

    def all_three(f):
        def run(spark, d):
            rows = bridge.entries(spark, d)
            return f(rows, bridge.blocks(rows), bridge.prices(spark))

        return run

    def recursive(text: str) -> str:
        return text.replace("WITH ", "WITH RECURSIVE ", 1)

    queries = {
        "tool_class_pred": entries(views.tool_class_pred),
        "bash_paths": blocks(views.command_paths),
        "distinct_tools": entries(views.distinct_tools),
        "cache_read_cost": entries(views.cache_read_cost),
        "input_purity": blocks(views.input_purity),
        "branch_costs": priced(lambda e, p: views.branch_costs(e, p, "12 hours")),
        "drift_entries": entries(views.drift_entries),
        "chain_light": entries(views.chain_light),
        "filter_noise": entries(lambda e: views.filter_noise(e).select("session", "idx", "uuid")),
        "list_recent": entries(views.list_recent),
        "filter_active": entries(lambda e: views.filter_active(e, "12 hours")),
        "filter_project": entries(lambda e: views.filter_project(e, "P3")),
        "alias_session_counts": entries(views.alias_session_counts),
        "sessions_for_cwd": entries(lambda e: views.sessions_for_cwd(e, "/w/r0")),
        "gc_candidates": entries(lambda e: views.gc_candidates(e, 1, 400)),
        "split_range": entries(lambda e: views.split_range(e, 5, 25).select("session", "idx", "uuid")),
        "tombstone": of("conversations", lambda t: views.tombstone(t, (F.col("role") == "user") & (F.length("text") > 100)).select("conv_id", "turn", F.md5("text").alias("text_md5"))),
        "session_diff": entries(views.session_diff),
        "decision_edges": entries(lambda e: views.decision_edges(e.filter("tool = 'Write' and raw_size > 3000").select(F.col("uuid").alias("point"), "session", "path"), e.filter("path is not null").select("session", "path"))),
        "project_graph": entries(views.project_graph),
        "continuity_suggestions": blocks(lambda b: views.continuity_suggestions(cross.continuity_files(b))),
        "session_quick_view": priced(views.session_quick_view),
        "collect_topics": priced(lambda e, p: views.collect_topics(e, p, "12 hours")),
    }
    found = {
        "tool_class_pred": sql(f"SELECT session, class, count(*) AS calls FROM e JOIN {_CLASSES} ON v.tool=e.tool GROUP BY ALL"),
        "bash_paths": sql("SELECT session, idx, path FROM b WHERE name='Bash'"),
        "distinct_tools": sql("SELECT session, count(DISTINCT CASE WHEN epoch<le THEN tool END) AS tools FROM (SELECT *, max(epoch) OVER (PARTITION BY session) AS le FROM ep) GROUP BY session"),
        "cache_read_cost": sql("SELECT session, round(coalesce(sum(cache_read_tokens),0)/1e6*0.75,9) AS dollars FROM e GROUP BY session"),
        "input_purity": sql(
            """SELECT session, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(comp) AS BIGINT) AS compressible, round(greatest((1-CAST(sum(comp) AS DOUBLE)/CAST(sum(t) AS DOUBLE))*100,0),6) AS score FROM
            (SELECT r.session, r.raw_size//4 AS t, CAST(CASE WHEN u.name='Bash' AND u.raw_size%3=0 THEN floor((r.raw_size//4)*CAST(0.7 AS DOUBLE)) WHEN u.name='Bash' AND u.raw_size%3=1 THEN floor((r.raw_size//4)*CAST(0.6 AS DOUBLE))
            WHEN u.name<>'Bash' THEN 0 WHEN r.raw_size//4>2000 THEN floor((r.raw_size//4)*CAST(0.3 AS DOUBLE)) ELSE 0 END AS BIGINT) AS comp
            FROM b r LEFT JOIN b u ON u.session=r.session AND u.kind='tool_use' AND u.id=r.tool_use_id WHERE r.kind='tool_result' AND r.raw_size//4>0) GROUP BY session"""
        ),
        "branch_costs": sql(_BRANCH_COSTS, _BRANCHES),
        "drift_entries": sql(f"SELECT t.session, t.idx, r.repo FROM tg t JOIN ({_BEST.format('isl', 'tg')}) r ON r.session=t.session AND r.isl=t.isl", tangent("ext AND NOT m")),
        "chain_light": recursive(sql("SELECT session, bool_and(ok) AS whole FROM lw GROUP BY session", _LIGHT)),
        "filter_noise": sql("SELECT session, row_number() OVER (PARTITION BY session ORDER BY idx)-1 AS idx, uuid FROM e WHERE type<>'progress' AND NOT is_sidechain"),
        "list_recent": sql("SELECT session, project, max(ts) AS modified, count(*) AS rows FROM e GROUP BY ALL ORDER BY modified DESC, session LIMIT 20"),
        "filter_active": sql("SELECT session, modified FROM (SELECT session, max(ts) AS modified FROM e GROUP BY session) WHERE modified >= (SELECT max(ts) FROM e) - INTERVAL 12 HOUR"),
        "filter_project": sql("SELECT DISTINCT session, project FROM e WHERE contains(lower(project),'p3')"),
        "alias_session_counts": sql("SELECT project, count(DISTINCT session) AS sessions FROM e GROUP BY project"),
        "sessions_for_cwd": sql("SELECT session, count(*) AS rows FROM e WHERE cwd='/w/r0' GROUP BY session"),
        "gc_candidates": sql(
            """SELECT session, rows, age_days FROM (SELECT session, count(*) FILTER (WHERE type IN ('user','assistant')) AS rows, max(epoch) AS cuts,
            CAST(floor((floor(epoch((SELECT max(ts) FROM e)))-floor(epoch(max(ts))))/86400) AS BIGINT) AS age_days FROM ep GROUP BY session) WHERE age_days>=1 AND rows<=400 AND cuts=0"""
        ),
        "split_range": sql("SELECT session, row_number() OVER (PARTITION BY session ORDER BY idx)-1 AS idx, uuid FROM e WHERE idx BETWEEN 5 AND 25"),
        "tombstone": "SELECT conv_id, turn, md5(CASE WHEN role='user' AND length(text)>100 THEN '[removed]' ELSE text END) AS text_md5 FROM conversations",
        "session_diff": sql(
            """SELECT p.session, p.next_session, count(*) FILTER (WHERE u.new AND NOT u.old) AS added, count(*) FILTER (WHERE u.old AND NOT u.new) AS dropped, count(*) FILTER (WHERE u.old AND u.new) AS kept
            FROM pr p LEFT JOIN (SELECT session, path, bool_or(n=1) AS old, bool_or(n=2) AS new FROM (SELECT p.session, f.path, 1 AS n FROM pr p JOIN fl f ON f.session=p.session
            UNION ALL SELECT p.session, f.path, 2 FROM pr p JOIN fl f ON f.session=p.next_session) GROUP BY ALL) u ON u.session=p.session WHERE p.next_session IS NOT NULL GROUP BY ALL""",
            "fl AS (SELECT DISTINCT session, path FROM (SELECT *, max(epoch) OVER (PARTITION BY session) AS le FROM ep) WHERE epoch=le AND path IS NOT NULL)",
            f"pr AS ({_NEXT})",
        ),
        "decision_edges": sql("SELECT DISTINCT p.uuid AS point, t.session FROM e p JOIN e t ON t.path=p.path AND t.session<>p.session WHERE p.tool='Write' AND p.raw_size>3000"),
        "project_graph": sql(
            f"""SELECT 'project' AS kind, project AS src, session AS dst, count(*) AS weight FROM e GROUP BY ALL
            UNION ALL SELECT 'file', path, session, n FROM (SELECT *, count(*) OVER (PARTITION BY path) AS k FROM (SELECT path, session, count(*) AS n FROM e WHERE path IS NOT NULL GROUP BY ALL HAVING count(*)>=2)) WHERE k>=2
            UNION ALL SELECT 'next', session, next_session, 1 FROM ({_NEXT}) WHERE next_session IS NOT NULL"""
        ),
        "continuity_suggestions": sql("SELECT path, count(*) AS sessions, CAST(sum(tokens)-min(tokens) AS BIGINT) AS tokens FROM fr GROUP BY path HAVING count(*)>3 AND sum(tokens)-min(tokens)>1000", pieces["first"]),
    }
    found["session_quick_view"] = recursive(sql(
        f"""SELECT session, p AS usage_percent, last_in, last_out, dollars, turns_left, CASE WHEN p>92 THEN 'emergency' WHEN p>75 THEN 'degrading' ELSE 'healthy' END AS state, whole FROM
        (SELECT l.session, round(last_in*100.0/200000,4) AS p, last_in, last_out, coalesce(q.dollars,0) AS dollars, g.fast_turns_left AS turns_left, h.whole FROM
        (SELECT session, coalesce(arg_max(ctx,idx) FILTER (WHERE ctx IS NOT NULL),0) AS last_in, coalesce(arg_max(output_tokens,idx) FILTER (WHERE ctx IS NOT NULL),0) AS last_out FROM e GROUP BY session) l
        LEFT JOIN ({oracle['quick_cost']}) q ON q.session=l.session JOIN ({oracle['growth_rate']}) g ON g.session=l.session JOIN (SELECT session, bool_and(ok) AS whole FROM lw GROUP BY session) h ON h.session=l.session)""",
        _LIGHT,
    ))
    found["collect_topics"] = "WITH " + bridge.SQL.strip().replace("e AS (SELECT *, CAST(floor(ctx/10.0)", "e2 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY session ORDER BY idx)-1 AS idx) FROM e1 WHERE type<>'progress' AND NOT is_sidechain),\ne AS (SELECT *, CAST(floor(ctx/10.0)").replace("END END AS model FROM e1)", "END END AS model FROM e2)") + f""",
{_BRANCHES}, bc AS ({_BRANCH_COSTS})
SELECT project, row_number() OVER (PARTITION BY project ORDER BY first_ts, session, branch) AS topic, session, branch, entries, dollars FROM
(SELECT br.project, br.session, br.branch, min(br.ts) AS first_ts, any_value(bc.entries) AS entries, any_value(bc.dollars) AS dollars FROM br JOIN bc ON bc.session=br.session AND bc.branch=br.branch GROUP BY ALL)"""
    return queries, found
