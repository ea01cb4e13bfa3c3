"""Queries over the log with many blocks a row, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frame, overview, scoring, sequence, views
from ..sources import bridge, eventlog, jsonl
from ..sources.eventlog import with_sql
from ..sources.scratch import split_methods, written

_W = "PARTITION BY session ORDER BY idx"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _price(model: str) -> str:
    return f"""(CASE WHEN {model} LIKE 'm-mid%' THEN input_tokens*3.0+output_tokens*15.0+cache_creation_tokens*0.75+cache_read_tokens*0.15
 ELSE input_tokens*15.0+output_tokens*75.0+cache_creation_tokens*3.75+cache_read_tokens*0.75 END)/1e6"""


#: Entries with active folder, epoch, tokens and dollars.
ROWS = f"""lc AS (SELECT *, coalesce(last_value(nullif(cwd,'') IGNORE NULLS) OVER ({_W}), first_value(nullif(cwd,'') IGNORE NULLS) OVER ({_W} {_ALL})) AS home_dir,
 last_value(CASE WHEN type='assistant' THEN ctx END IGNORE NULLS) OVER ({_W} {_BEFORE}) AS before_ctx, raw_size//4 AS t,
 first_value(CASE WHEN type='assistant' THEN model END IGNORE NULLS) OVER ({_W} {_ALL}) AS first_model FROM le),
lp AS (SELECT *, coalesce(before_ctx>0 AND before_ctx-ctx>50000,false) AS cut, {_price("model")} AS dollars, {_price("first_model")} AS drift_dollars FROM lc),
lq AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER ({_W}) AS BIGINT) AS epoch, CAST(count(*) FILTER (WHERE type='assistant') OVER ({_W}) AS BIGINT) AS turn FROM lp)"""

#: Scopes and islands.
SCOPES = f"""rx AS (SELECT r.*, NOT (r.path=home_dir OR starts_with(r.path, home_dir||'/')) AS away, regexp_extract(r.path,'^/w/r[0-9]+') AS root FROM lr r JOIN lc USING (session, idx)),
sx AS (SELECT lq.*, coalesce(n_ext,0) AS n_ext, coalesce(n_home,0) AS n_home, coalesce(m,false) AS m FROM lq LEFT JOIN (SELECT session, idx, count(*) FILTER (WHERE away) AS n_ext, count(*) FILTER (WHERE NOT away) AS n_home,
 bool_or(NOT away AND tool IN ('Write','Edit','Bash')) AS m FROM rx GROUP BY ALL) USING (session, idx)),
ix AS (SELECT *, coalesce(last_value(CASE WHEN conv THEN n_ext>0 END IGNORE NULLS) OVER ({_W} {_BEFORE}),false) AS earlier, CASE WHEN n_ext+n_home>0 THEN n_ext/(n_ext+n_home) ELSE 0 END AS share FROM sx),
iy AS (SELECT *, m OR (n_home>0 AND n_ext=0) OR (conv AND n_ext+n_home=0 AND NOT earlier) AS brk, n_ext>0 AND NOT m AS st,
 CASE WHEN n_ext>0 AND n_home>0 THEN CAST(floor(t*round(share,12)) AS BIGINT) ELSE t END AS tok FROM ix),
iz AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER ({_W}) AS isl FROM iy),
il AS (SELECT *, NOT brk AND max(CASE WHEN st AND n_home=0 THEN 1 ELSE 0 END) OVER (PARTITION BY session, isl ORDER BY idx)=1 AS pure, NOT brk AND max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY session, isl ORDER BY idx)=1 AS any_on FROM iz),
tn AS (SELECT *, pure AND count(*) FILTER (WHERE pure) OVER (PARTITION BY session, isl)>=2 AND sum(CASE WHEN pure THEN tok END) OVER (PARTITION BY session, isl)>=100 AS tangent FROM il)"""

#: Noise of blocks and links, by row.
NOISE = """lf AS (SELECT b.session, b.idx, b.block_idx, path, id, name IN ('Write','Edit') AS w, name FROM lb b WHERE kind='tool_use' AND path IS NOT NULL AND name IN ('Read','Write','Edit')),
lv AS (SELECT *, sum(CASE WHEN w THEN 1 ELSE 0 END) OVER (PARTITION BY session, path ORDER BY idx, block_idx) AS version FROM lf),
ls AS (SELECT * FROM (SELECT *, lead(idx) OVER (PARTITION BY session, path, version ORDER BY idx, block_idx) AS again FROM lv WHERE NOT w) WHERE again IS NOT NULL),
st AS (SELECT s.session, s.path, s.idx, s.block_idx, coalesce(min(r.idx),-1) AS result_idx FROM ls s LEFT JOIN lb r ON r.session=s.session AND r.kind='tool_result' AND r.tool_use_id=s.id AND r.idx>s.idx AND r.idx<=s.idx+4 GROUP BY ALL),
sg AS (SELECT *, CASE WHEN name IN ('Read','Write','Edit') THEN name||':'||path WHEN name='Bash' THEN 'Bash:'||command WHEN name='Grep' THEN 'Grep:'||pattern||':'||path END AS sig FROM lb WHERE kind='tool_use'),
rt AS (SELECT f.session, f.idx AS error_idx, f.block_idx, f.call_idx, min(n.idx) AS retry_idx FROM (SELECT e.session, e.idx, e.block_idx, max(u.idx) AS call_idx, arg_max(u.sig,u.idx) AS sig FROM lb e JOIN sg u ON u.session=e.session AND u.id=e.tool_use_id AND u.idx<e.idx AND u.idx>=e.idx-5
 WHERE e.kind='tool_result' AND e.is_error GROUP BY ALL) f JOIN sg n ON n.session=f.session AND n.sig=f.sig AND n.idx>f.idx AND n.idx<=f.idx+6 GROUP BY ALL),
orp AS (SELECT session, idx, count(*) AS n FROM lb b WHERE kind='tool_result' AND NOT EXISTS (SELECT 1 FROM lb k WHERE k.kind='tool_use' AND k.session=b.session AND k.id=b.tool_use_id) GROUP BY ALL),
mp AS (SELECT session, idx FROM le WHERE parent_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM le k WHERE k.session=le.session AND k.uuid=le.parent_uuid)),
bg AS (SELECT session, idx, count(*) AS n, CAST(sum(strlen(result)//4) AS BIGINT) AS tokens FROM lb b WHERE kind='tool_result' AND strlen(result)>=4096 AND EXISTS (SELECT 1 FROM lb k WHERE k.kind='tool_use' AND k.name='Bash' AND k.session=b.session AND k.id=b.tool_use_id) GROUP BY ALL),
im AS (SELECT session, idx, count(*) AS n, CAST(sum(strlen(data)*3//4) AS BIGINT) AS bytes FROM lb WHERE kind='image' GROUP BY ALL),
tg AS (SELECT session, idx, count(*) FILTER (WHERE k='s') AS stale_tags, count(*) FILTER (WHERE k='r') AS retry_tags FROM (SELECT session, idx, 's' AS k FROM st UNION ALL SELECT session, result_idx, 's' FROM st WHERE result_idx>=0 UNION ALL SELECT session, call_idx, 'r' FROM rt UNION ALL SELECT session, error_idx, 'r' FROM rt) GROUP BY ALL),
mk AS (SELECT tn.*, coalesce(tg.stale_tags,0) AS stale_tags, coalesce(tg.retry_tags,0) AS retry_tags, (SELECT count(*) FROM st s WHERE s.session=tn.session AND s.idx=tn.idx) AS stale, (SELECT count(*) FROM rt s WHERE s.session=tn.session AND s.call_idx=tn.idx) AS retries,
 mp.idx IS NOT NULL AS missing, coalesce(orp.n,0) AS orphans, is_sidechain OR mp.idx IS NOT NULL OR orp.n IS NOT NULL AS side, coalesce(bg.n,0) AS large, coalesce(bg.tokens,0) AS large_tokens, coalesce(im.n,0) AS images, coalesce(im.bytes,0) AS image_bytes
 FROM tn LEFT JOIN tg USING (session, idx) LEFT JOIN mp USING (session, idx) LEFT JOIN orp USING (session, idx) LEFT JOIN bg USING (session, idx) LEFT JOIN im USING (session, idx)),
mn AS (SELECT *, stale_tags>0 OR retry_tags>0 OR tangent OR side AS noisy, side AND NOT coalesce(lag(side) OVER (PARTITION BY session ORDER BY idx),false) AS new_chain, max(epoch) OVER (PARTITION BY session) AS last_epoch,
 CASE WHEN type='assistant' AND contains(lower(text),'decided') THEN CASE WHEN strpos(lower(text),'decided')-1>20 THEN substr(text, strpos(lower(text),'decided')-20) ELSE substr(text, strpos(lower(text),'decided')) END END AS hint,
 CASE WHEN type='user' AND text LIKE '%?' THEN text END AS question FROM mk)"""

#: One row an epoch, and one a session.
FACTS = """ep AS (SELECT session, epoch, max(last_epoch) AS last_epoch, max(first_model) AS first_model, count(*) AS entries, count(*) FILTER (WHERE conv) AS talk, count(*) FILTER (WHERE ctx IS NOT NULL) AS uses, max(ctx) AS peak_ctx, arg_max(ctx,idx) FILTER (WHERE ctx IS NOT NULL) AS end_ctx, arg_min(ctx,idx) FILTER (WHERE ctx IS NOT NULL) AS start_ctx,
 sum(CAST(dollars AS DECIMAL(20,9))) AS dollars, sum(CAST(drift_dollars*share AS DECIMAL(20,9))) AS drift_dollars, CAST(floor(coalesce(sum(CASE WHEN n_ext+n_home>0 THEN CAST(1-share AS DECIMAL(20,9)) END),0)+0.5) AS BIGINT) AS in_scope, CAST(floor(coalesce(sum(CASE WHEN n_ext+n_home>0 THEN CAST(share AS DECIMAL(20,9)) END),0)+0.5) AS BIGINT) AS out_scope,
 count(*) FILTER (WHERE n_ext>0 AND n_home>0) AS mixed_scope, least(count(hint),5) AS hints, least(count(question),10) AS questions, min(idx) AS lo, max(idx) AS hi, min(ts) AS first_ts FROM mn GROUP BY session, epoch),
sf AS (SELECT session, count(*) AS entries, count(*) FILTER (WHERE type='progress') AS progress_rows, CAST(coalesce(sum(t) FILTER (WHERE type='progress'),0) AS BIGINT) AS progress_tokens, count(*) FILTER (WHERE type='file-history-snapshot') AS snapshot_rows,
 CAST(coalesce(sum(raw_size) FILTER (WHERE type='file-history-snapshot'),0)//4 AS BIGINT) AS snapshot_tokens, count(*) FILTER (WHERE conv) AS talk, CAST(sum(stale) AS BIGINT) AS stale, CAST(sum(stale_tags*t) AS BIGINT) AS stale_tokens, CAST(sum(retries) AS BIGINT) AS retries, CAST(sum(retry_tags*t) AS BIGINT) AS retry_tokens,
 count(*) FILTER (WHERE tangent) AS tangent_rows, CAST(coalesce(sum(tok) FILTER (WHERE tangent),0) AS BIGINT) AS tangent_tokens, CAST(coalesce(sum(t) FILTER (WHERE tangent),0) AS BIGINT) AS tangent_full, count(*) FILTER (WHERE side) AS side_rows, CAST(coalesce(sum(t) FILTER (WHERE side),0) AS BIGINT) AS side_tokens, count(*) FILTER (WHERE new_chain) AS side_groups,
 CAST(coalesce(sum(t) FILTER (WHERE noisy),0) AS BIGINT) AS union_tokens, count(*) FILTER (WHERE noisy) AS noisy_rows, CAST(sum(images) AS BIGINT) AS images, CAST(sum(image_bytes)//750 AS BIGINT) AS image_tokens, CAST(sum(large) AS BIGINT) AS large, CAST(sum(large_tokens) AS BIGINT) AS large_tokens,
 coalesce(max(ctx),0) AS max_ctx, coalesce(arg_max(ctx,idx) FILTER (WHERE ctx IS NOT NULL),0) AS current_ctx, max(last_epoch) AS compactions, round(epoch(arg_max(ts,idx))-epoch(arg_min(ts,idx)),3) AS seconds FROM mn GROUP BY session),
sm AS (SELECT session, coalesce(CAST(sum(dollars) AS DOUBLE),0) AS dollars, CAST(sum(in_scope) AS BIGINT) AS in_scope, CAST(sum(out_scope) AS BIGINT) AS out_scope, CAST(coalesce(sum(hints) FILTER (WHERE epoch<last_epoch),0) AS BIGINT) AS decisions, max(uses) FILTER (WHERE epoch=last_epoch) AS last_uses, max(start_ctx) FILTER (WHERE epoch=last_epoch) AS last_start FROM ep GROUP BY session),
s1 AS (SELECT *, CASE WHEN compactions>0 AND last_uses-1>=1 THEN (current_ctx-last_start)/CAST(last_uses-1 AS DOUBLE) WHEN talk>0 THEN current_ctx/CAST(talk AS DOUBLE) ELSE 0 END AS growth_rate, CASE WHEN in_scope+out_scope>0 THEN out_scope/CAST(in_scope+out_scope AS DOUBLE) ELSE 0 END AS drift,
 progress_tokens+snapshot_tokens+image_tokens+large_tokens+union_tokens AS noise_tokens, stale_tokens+retry_tokens+tangent_full+side_tokens-union_tokens AS overlap_tokens, CASE WHEN last_uses>0 THEN last_uses ELSE talk END AS since FROM sf JOIN sm USING (session)),
items AS (SELECT session, category, n, tokens, row_number() OVER (PARTITION BY session ORDER BY tokens DESC, category) AS rank FROM (SELECT session, unnest(['progress','snapshots','stale_reads','images','large_outputs','failed_retries','sidechains','tangents']) AS category,
 unnest([progress_rows,snapshot_rows,stale,images,large,retries,side_rows,tangent_rows]) AS n, unnest([progress_tokens,snapshot_tokens,stale_tokens,image_tokens,large_tokens,retry_tokens,side_tokens,tangent_tokens]) AS tokens FROM s1) WHERE n>0),
s AS (SELECT s1.*, current_ctx*100.0/200000 AS usage_percent, CASE WHEN growth_rate<=0 THEN -1 WHEN current_ctx>=165000 THEN 0 ELSE CAST(floor((165000-current_ctx)/growth_rate) AS BIGINT) END AS turns_left,
 CASE WHEN current_ctx<=0 THEN 100.0 ELSE greatest(current_ctx-noise_tokens,0)*100.0/current_ctx END AS p, i.category AS biggest, CASE WHEN current_ctx>0 THEN noise_tokens/CAST(current_ctx AS DOUBLE) ELSE 0 END AS ratio FROM s1 LEFT JOIN items i ON i.session=s1.session AND i.rank=1),
gd AS (SELECT *, CASE WHEN p>90 THEN 'A' WHEN p>75 THEN 'B' WHEN p>60 THEN 'C' WHEN p>40 THEN 'D' ELSE 'F' END AS grade FROM s)"""


def _sql(body: str) -> str:
    return with_sql(body, ROWS, SCOPES, NOISE, FACTS)


#: Fields of a line that no query on this log asks for; they are neither shuffled nor written.
UNASKED = ("modified", "line", "role", "slug", "custom_title", "tool_use_result")


def log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, what their blocks tell, and prices."""
    rows = eventlog.folded(spark, d, lambda rows: frame.own(rows).drop(*UNASKED))
    return rows.drop("blocks"), jsonl.block_rows(rows).hint("merge"), bridge.prices(spark)


def _log(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(*log(spark, d))


def _facts(f) -> Callable[[SparkSession, str], DataFrame]:
    """Queries on the facts alone."""
    return _facts_and_rows(lambda s, rows: f(s))


def _facts_and_rows(f) -> Callable[[SparkSession, str], DataFrame]:
    """Queries on the facts and the log's rows; what they do not ask of the facts is not derived."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, blocks, prices = log(spark, d)
        out = f(frame.derived(rows, blocks, prices), rows)
        with split_methods(spark):
            return written(out, "facts")

    return run


def _framed(f) -> Callable[[SparkSession, str], DataFrame]:
    """Queries on the facts, the frame and the blocks."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, blocks, prices = log(spark, d)
        m = frame.marks(rows, blocks, prices)
        return f(written(frame.facts(frame.epoch_facts(m)), "facts"), m, blocks)

    return run


def _pruned(s: DataFrame) -> DataFrame:
    return scoring.prune_verdict(s.select("session", "compactions", "dollars"), s.select("session", F.col("talk").alias("entries"), F.col("decisions").alias("commit_points"), F.lit(0).alias("bookmarks")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "find_tangents": _log(lambda e, b, p: sequence.find_tangents(e)),
    "noise_ledger": _facts(frame.noise_ledger),
    "recommend": _facts(frame.recommend),
    "health": _facts(frame.health),
    "entropy": _facts(frame.entropy),
    "decision_economics": _facts(scoring.decision_economics),
    "gauge": _facts(scoring.gauge),
    "cadence": _facts(scoring.cadence),
    "budget_risk": _facts(lambda s: scoring.budget_risk(s, 100.0, 85.0)),
    "noise_multiplier": _facts(scoring.noise_multiplier),
    "grade_ratio": _facts(lambda s: s.select("session", views.grade_ratio(frame.health_columns()["grade"]).alias("ratio"))),
    "active_health": _facts(lambda s: views.active_health(frame.health(s))),
    "projected_savings": _facts(views.projected_savings),
    "prune_verdict": _facts(_pruned),
    "budget_actions": _framed(lambda s, m, b: overview.budget_actions(s, overview.tangent_dollars(m), 100.0, 85.0)),
    "fleet_health": _facts_and_rows(overview.fleet_health),
    "search_space": _framed(lambda s, m, b: views.search_space(s, m)),
    "session_summary": _framed(views.session_summary),
    "session_report": _framed(views.session_report),
}

_DE = """de AS (SELECT session, decisions, round(CASE WHEN decisions>0 THEN dollars/decisions ELSE 0 END,6) AS cpd, CASE WHEN decisions>0 THEN talk//decisions ELSE 0 END AS ttc,
 round(CASE WHEN decisions>0 AND talk>0 THEN decisions/CAST(talk AS DOUBLE) ELSE 0 END,6) AS density, CASE WHEN decisions>0 THEN round(drift,9) ELSE 0 END AS cdr, usage_percent, compactions FROM gd)"""


def _scored(body: str) -> str:
    return with_sql(body, ROWS, SCOPES, NOISE, FACTS, _DE)


ORACLE_SQL: dict[str, str] = {
    "find_tangents": _sql("SELECT session, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS entries, CAST(sum(tok) AS BIGINT) AS tokens, count(*) FILTER (WHERE n_ext>0 AND n_home>0) AS mixed, max(roots) AS roots FROM tn JOIN (SELECT session, isl, count(DISTINCT root) AS roots FROM tn JOIN rx USING (session, idx) WHERE pure AND away GROUP BY ALL) USING (session, isl) WHERE tangent GROUP BY session, isl"),
    "noise_ledger": _sql("SELECT session, stale_tokens AS stale_reads, retry_tokens AS failed_retries, tangent_full AS tangents, side_tokens AS sidechains, noisy_rows, union_tokens, overlap_tokens, noise_tokens AS total_tokens, round(greatest(current_ctx-noise_tokens,0)*100.0/200000,4) AS projected_percent FROM s"),
    "recommend": _sql("SELECT session, rank, category, n AS rows, tokens, CASE WHEN growth_rate>0 THEN CAST(floor(tokens/growth_rate) AS BIGINT) ELSE 0 END AS turns_gained FROM items JOIN s1 USING (session)"),
    "health": _sql("SELECT session, CASE WHEN current_ctx>0 THEN noise_tokens ELSE 0 END AS noise_tokens, CASE WHEN current_ctx>0 THEN greatest(current_ctx-noise_tokens,0) ELSE 0 END AS signal_tokens, round(p,4) AS signal_percent, grade, CASE WHEN current_ctx>0 THEN biggest END AS biggest FROM gd"),
    "entropy": _sql("""SELECT session, score, CASE WHEN score<=20 THEN 'LOW' WHEN score<=50 THEN 'MEDIUM' WHEN score<=75 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM (SELECT session, round(100*(0.30*(1-CASE grade WHEN 'A' THEN 0.95 WHEN 'B' THEN 0.80 WHEN 'C' THEN 0.65 WHEN 'D' THEN 0.45 ELSE 0.20 END)
     + 0.25*least(greatest(current_ctx,0)/165000.0,1)+0.20*drift+0.15*CASE WHEN current_ctx>0 THEN least(side_tokens/CAST(current_ctx AS DOUBLE),1) ELSE 0 END+0.10*least(compactions,10)/10.0),9) AS score FROM gd)"""),
    "decision_economics": _scored("SELECT session, decisions, cpd, ttc, density, cdr FROM de"),
    "gauge": _scored("""SELECT session, score AS gauge, CASE WHEN score>=3 THEN 'emergency' WHEN score=2 THEN 'unstable' WHEN score=1 THEN 'degrading' ELSE 'healthy' END AS state, CASE WHEN score>=3 THEN 'amputate' WHEN score=2 THEN 'split or distill' WHEN score=1 THEN 'clean --all' ELSE 'continue' END AS action FROM
     (SELECT session, CAST(greatest(CASE WHEN usage_percent>92 THEN 4 ELSE CAST(usage_percent>75 AS INT)+CAST(cpd>15 AS INT)+CAST(ttc>90 AS INT)+CAST(cdr>0.35 AS INT) END, CASE WHEN decisions>0 AND density<0.05 THEN 2 ELSE 0 END, CASE WHEN cdr>0.35 THEN 2 ELSE 0 END, CASE WHEN compactions>0 AND decisions=0 THEN 1 ELSE 0 END) AS BIGINT) AS score FROM de)"""),
    "cadence": _scored("""SELECT session, round(sc,9) AS score, CASE l4 WHEN 2 THEN 'overdue' WHEN 1 THEN 'due' ELSE 'clean' END AS status, CASE WHEN l4=0 THEN 'monitor' WHEN (turns_left>=0 AND turns_left<5) OR usage_percent>=85 OR compactions>=3 THEN 'export decisions then amputate' WHEN biggest='tangents' THEN 'split tangent range first' ELSE 'quick-clean --live' END AS action FROM
     (SELECT *, CASE WHEN since>50 AND noise_tokens>10000 AND l3=0 THEN 1 ELSE l3 END AS l4 FROM (SELECT *, CASE WHEN turns_left>=0 AND turns_left<10 AND noise_tokens>5000 THEN 2 ELSE l2 END AS l3 FROM (SELECT *, CASE WHEN ratio>0.30 THEN 2 WHEN ratio>0.15 THEN greatest(l1,1) ELSE l1 END AS l2 FROM
     (SELECT *, CASE WHEN sc>=70 THEN 2 WHEN sc>=40 THEN 1 ELSE 0 END AS l1 FROM (SELECT *, least(least(ratio/0.30,1)*40 + CASE WHEN turns_left<0 THEN 0 WHEN turns_left<=10 THEN 1 ELSE greatest(least((30-turns_left)/20.0,1),0) END*30 + greatest(least(growth_rate/2000,1),0)*20 + least(since/50.0,1)*10, 100.0) AS sc FROM gd)))))"""),
    "budget_risk": _scored("""SELECT session, CASE WHEN n>=2 THEN 'high' WHEN n=1 THEN 'medium' ELSE 'low' END AS risk, to_compaction FROM (SELECT session, CAST(turns_left>0 AND turns_left<10 AS INT)+CAST(ratio>0.15 AS INT)+1 AS n, round(dollars/greatest(talk,1)*greatest(turns_left,0),6) AS to_compaction FROM gd)"""),
    "noise_multiplier": _scored("SELECT session, round(ratio,6) AS multiplier, noise_tokens*greatest(turns_left,0) AS projected_tokens FROM gd"),
}

_HOPS = 5
#: The last row's parents, step by step.
_LIGHT = ",\n".join(
    ["l0 AS (SELECT session, arg_max(struct_pack(p := parent_uuid), idx).p AS p, true AS ok FROM le GROUP BY session)"]
    + [f"l{i + 1} AS (SELECT l.session, k.parent_uuid AS p, l.ok AND (l.p IS NULL OR k.uuid IS NOT NULL) AS ok FROM l{i} l LEFT JOIN le k ON k.session=l.session AND k.uuid=l.p)" for i in range(_HOPS)]
    + [f"wh AS (SELECT session, ok AS whole FROM l{_HOPS})"]
)
_TOP = "tf AS (SELECT session, path FROM (SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, path) AS r FROM lr WHERE tool IN ('Write','Edit') GROUP BY session, path) WHERE r=1)"
_PURE = """pu AS (SELECT session, round(greatest((1-CAST(sum(comp) AS DOUBLE)/CAST(sum(t) AS DOUBLE))*100,0),6) AS purity FROM (SELECT r.session, q.t, CAST(CASE WHEN u.name IS NOT NULL AND u.name<>'Bash' THEN 0
 WHEN q.t>2000 THEN floor(q.t*CAST(0.3 AS DOUBLE)) ELSE 0 END AS BIGINT) AS comp FROM lb r JOIN lq q ON q.session=r.session AND q.idx=r.idx LEFT JOIN lb u ON u.session=r.session AND u.kind='tool_use' AND u.id=r.tool_use_id WHERE r.kind='tool_result' AND q.t>0) GROUP BY session)"""
#: The score of a gauge from economics.
_GAUGE = """ga AS (SELECT session, CAST(greatest(CASE WHEN usage_percent>92 THEN 4 ELSE CAST(usage_percent>75 AS INT)+CAST(cpd>15 AS INT)+CAST(ttc>90 AS INT)+CAST(cdr>0.35 AS INT) END,
 CASE WHEN decisions>0 AND density<0.05 THEN 2 ELSE 0 END, CASE WHEN cdr>0.35 THEN 2 ELSE 0 END, CASE WHEN compactions>0 AND decisions=0 THEN 1 ELSE 0 END) AS BIGINT) AS gauge FROM de)"""
_SUMMARY = """su AS (SELECT gd.session, gd.dollars, gd.talk AS turns, gd.usage_percent, gd.compactions, gd.noise_tokens AS cleanable, gd.grade, gd.seconds, de.cpd, de.ttc, ga.gauge,
 CASE WHEN gauge>=3 THEN 'emergency' WHEN gauge=2 THEN 'unstable' WHEN gauge=1 THEN 'degrading' ELSE 'healthy' END AS state, tf.path AS top_file, coalesce(pu.purity,100.0) AS purity, wh.whole
 FROM gd JOIN de USING (session) JOIN ga USING (session) LEFT JOIN tf USING (session) LEFT JOIN pu USING (session) LEFT JOIN wh USING (session))"""
# Each row of this log follows the one before, so any missing parent breaks the last row's chain.
_SPACE = """sq AS (SELECT s1.session, s1.decisions, CAST(s1.decisions AS DOUBLE) AS d, s1.compactions AS cuts, s1.noise_tokens, s1.max_ctx AS peak, s1.side_groups AS groups, s1.tangent_rows AS tangents, s1.stale, coalesce(h.n,0) AS ghosts, coalesce(o.n,0) AS tools, coalesce(w.broken,false) AS broken FROM s1
 LEFT JOIN (SELECT session, count(*) AS n FROM (SELECT DISTINCT a.session, a.epoch, a.path FROM rf a JOIN rf z ON z.session=a.session AND z.epoch=a.epoch+1 AND z.path=a.path AND z.tool IN ('Edit','Write')) GROUP BY session) h USING (session)
 LEFT JOIN (SELECT session, count(DISTINCT name) AS n FROM lb JOIN mn USING (session, idx) WHERE kind='tool_use' AND epoch<last_epoch GROUP BY session) o USING (session)
 LEFT JOIN (SELECT DISTINCT session, true AS broken FROM mp) w USING (session) WHERE s1.decisions>0),
sr AS (SELECT *, round(greatest(least(CAST(1.8 AS DOUBLE)+least(cuts/d*0.8::DOUBLE,1.5)+least(groups/d*0.4::DOUBLE,1.5)+least(tangents/d*0.08::DOUBLE,1.0)+CASE WHEN tools>3 THEN least((tools-3)*0.12::DOUBLE,1.2) ELSE 0 END,8.0),2.0),9) AS f,
 round(greatest(least(CAST(1.0 AS DOUBLE)+least(cuts*0.07::DOUBLE,1.2)+CASE WHEN broken THEN 0.35::DOUBLE ELSE 0 END+least(ghosts/d*0.08::DOUBLE,0.5)+least(noise_tokens/CAST(greatest(peak,1) AS DOUBLE)*0.5::DOUBLE,0.6)+least(stale/d*0.1::DOUBLE,0.35),3.5),1.0),9) AS r FROM sq)"""


def _report() -> str:
    """SQL of `session_report`: facts under their parts' names, then the other queries' columns."""
    facts = {
        "context": {c: f"gd.{c}" for c in ("entries", "progress_rows", "snapshot_rows", "progress_tokens", "current_ctx", "max_ctx", "images", "large")} | {c: f"ct.{c}" for c in ("user_rows", "assistant_rows", "bytes")},
        "growth": {c: f"gd.{c}" for c in ("growth_rate", "turns_left", "compactions")} | {"since_cleanup": "gd.since"}, "drift": {c: f"gd.{c}" for c in ("in_scope", "out_scope", "drift")} | {"mixed_scope": "ct.mixed_scope"},
    }
    own = ", ".join(f"{c} AS {n}_{k}" for n, columns in facts.items() for k, c in columns.items())
    parts = {"noise": ORACLE_SQL["noise_ledger"], "health": ORACLE_SQL["health"], "entropy": ORACLE_SQL["entropy"], "summary": _scored_more("SELECT * FROM su", _GAUGE, _TOP, _PURE, _LIGHT, _SUMMARY)}
    joins = " ".join(f"LEFT JOIN (SELECT session AS s_{n}, COLUMNS(* EXCLUDE session) AS '{n}_\\0' FROM ({q})) {n} ON s_{n}=f.session" for n, q in parts.items())
    counts = "ct AS (SELECT session, count(*) FILTER (WHERE type='user') AS user_rows, count(*) FILTER (WHERE type='assistant') AS assistant_rows, CAST(sum(raw_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE n_ext>0 AND n_home>0) AS mixed_scope FROM mn GROUP BY session)"
    base = _scored_more(f"SELECT gd.session, {own} FROM gd JOIN ct USING (session)", counts)
    return f"SELECT * EXCLUDE ({', '.join(f's_{n}' for n in parts)}) FROM ({base}) f {joins}"


def _scored_more(body: str, *more: str) -> str:
    return with_sql(body, ROWS, SCOPES, NOISE, FACTS, _DE, *more)


ORACLE_SQL |= {
    "grade_ratio": _sql("SELECT session, CASE grade WHEN 'A' THEN 0.95 WHEN 'B' THEN 0.80 WHEN 'C' THEN 0.65 WHEN 'D' THEN 0.45 ELSE 0.20 END::DOUBLE AS ratio FROM gd"),
    "active_health": _sql("SELECT count(*) FILTER (WHERE p>75) AS healthy, count(*) FILTER (WHERE NOT p>75) AS other FROM gd"),
    "projected_savings": _sql("SELECT session, noise_tokens*greatest(turns_left,0) AS tokens, round(noise_tokens*greatest(turns_left,0)/1e6*0.75,9) AS dollars FROM gd"),
    "prune_verdict": _sql("SELECT session, CASE WHEN talk<=2 THEN 'empty' WHEN compactions>=2 OR decisions>=3 OR dollars>5 THEN 'substantive' WHEN compactions>0 OR decisions>0 THEN 'has-content' ELSE 'throwaway' END AS verdict FROM gd"),
    "budget_actions": _scored_more(
        """SELECT session, row_number() OVER (PARTITION BY session ORDER BY dollars DESC, n) AS rank, action, dollars FROM (SELECT session, unnest([0,1,2,3]) AS n, unnest(['clean noise now','split tangent range','start new session with branch export','offload mechanical work to cheaper agents or CI']) AS action,
        unnest([clean, away, round(ahead*CAST(0.40 AS DOUBLE),6), round(ahead*CAST(0.25 AS DOUBLE),6)]) AS dollars FROM (SELECT gd.session, round(noise_tokens*greatest(turns_left,0)/1e6*0.75,9) AS clean, coalesce(tw.away,0) AS away, round(dollars/greatest(talk,1)*greatest(turns_left,0),6) AS ahead FROM gd LEFT JOIN tw USING (session)))""",
        "tw AS (SELECT session, round(CAST(sum(CAST(dollars AS DECIMAL(20,9))) AS DOUBLE),9) AS away FROM tn WHERE any_on GROUP BY session)",
    ),
    "search_space": _scored_more("SELECT session, floor(decisions*f*r*10+0.5)/10 AS probes, floor(f*r*10+0.5)/10 AS ratio, floor(f*10+0.5)/10 AS branch_factor, floor(r*10+0.5)/10 AS reexploration FROM sr", "rf AS (SELECT lr.session, lr.path, lr.tool, lq.epoch FROM lr JOIN lq USING (session, idx))", _SPACE),
    "session_summary": _scored_more("SELECT * FROM su", _GAUGE, _TOP, _PURE, _LIGHT, _SUMMARY),
    "session_report": _report(),
    "fleet_health": _scored_more(
        f"""SELECT (SELECT count(*) FROM wh) AS sessions, (SELECT count(*) FROM wh WHERE NOT whole) AS broken, (SELECT count(*) FROM s1 WHERE side_rows>0) AS sidechain_sessions, (SELECT CAST(sum(side_rows) AS BIGINT) FROM s1) AS sidechain_rows,
        (SELECT session FROM en ORDER BY score DESC, session LIMIT 1) AS entropy_leader, (SELECT max(score) FROM en) AS entropy_score, (SELECT session FROM cd ORDER BY score DESC, session LIMIT 1) AS cadence_leader, (SELECT max(score) FROM cd) AS cadence_score""",
        _LIGHT, f"en AS ({ORACLE_SQL['entropy']})", f"cd AS ({ORACLE_SQL['cadence']})",
    ),
}
