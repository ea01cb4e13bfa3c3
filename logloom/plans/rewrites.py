"""Queries of rewriting, notes and overviews with their SQL; `build` takes the pieces that the catalog shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost, notes, overview, rewrite, scoring, sequence, text
from ..sources import bridge

#: Words that occur in the conversations, besides the operators' own.
DECISIONS, CONSTRAINTS, FINDINGS = [*notes.DECISIONS, "tion"], [*notes.CONSTRAINTS, "the"], [*notes.FINDINGS, "an"]
LEADS = ["89504E470D0A", "FFD8FFE00010", "474946383961", "524946460000", ""]
TYPES = ["image/png", "image/jpeg", "image/gif"]
ANCHOR = "1995-01-04"


def _images(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, media_type, data: texts as image data, some with the first bytes of an image, and a type that may not fit."""
    docs = bridge.table(spark, d, "documents")
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("doc_id") % 5 + 1).cast("int"))
    data = F.regexp_replace(F.base64(F.concat(F.unhex(lead), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), r"\s", "")  # base64 may break lines
    return docs.select("doc_id", "source", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 3 + 1).cast("int")).alias("media_type"), data.alias("data"))


def _contents(spark: SparkSession, d: str, change) -> DataFrame:
    """doc_id, content_md5 of a changed list of a text and an image."""
    image = F.format_string('[{"text":"d%d","type":"text"},{"source":{"data":"%s","media_type":"%s","type":"base64"},"type":"image"}]', "doc_id", "data", "media_type")
    return _images(spark, d).select("doc_id", F.md5(change(image)).alias("content_md5"))


_IM = f"""im AS (SELECT doc_id, source, ['{"','".join(TYPES)}'][doc_id%3+1] AS media_type, to_base64(unhex(['{"','".join(LEADS)}'][doc_id%5+1]) || encode(coalesce(text,''))) AS data FROM documents),
id AS (SELECT *, CAST(floor(length(data)*3/4.0) AS BIGINT) AS bytes, CASE WHEN length(data)>=8 THEN CASE WHEN h LIKE '89504E47%' THEN 'image/png' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '47494638%' THEN 'image/gif' WHEN h LIKE '52494646%' THEN 'image/webp' END END AS detected
 FROM (SELECT *, hex(from_base64(CASE WHEN length(data)>=8 THEN left(data,8) ELSE '' END)) AS h FROM im))"""
_BLOCK = """'{"source":{"data":"'||data||'","media_type":"'||%s||'","type":"base64"},"type":"image"}'"""
_HOLDER = f"""'{{"text":"{rewrite.PLACEHOLDER}","type":"text"}}'"""


def _content(block: str) -> str:
    return f"""WITH {_IM} SELECT doc_id, md5('[{{"text":"d'||doc_id||'","type":"text"}},'||{block}||']') AS content_md5 FROM id"""


def _hint(words: list[str]) -> str:
    k = "CASE " + " ".join(f"WHEN strpos(lower(text),'{w}')>0 THEN strpos(lower(text),'{w}')" for w in words) + " ELSE 0 END"
    p = f"trim(substr(text, CASE WHEN ({k})-1>20 THEN ({k})-20 ELSE ({k}) END))"
    return f"CASE WHEN role='assistant' AND ({k})>0 THEN {_short(p)} END"


def _short(p: str) -> str:
    return f"CASE WHEN length({p})<=120 THEN {p} ELSE substr({p},1,117)||'...' END"


_TRIM = r"regexp_replace(text,'^\s+|\s+$','','g')"


def _ranked(parts: dict[str, tuple[str, int]], source: str = "conversations") -> str:
    union = " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS kind, {c} AS text, {n} AS most FROM {source}" for k, (c, n) in parts.items())
    return f"SELECT conv_id, kind, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn, text) AS rank FROM ({union}) WHERE text<>'') WHERE rank<=most"


_CANON = _ranked({
    "goal": (f"CASE WHEN role='user' AND {_TRIM}<>'' THEN {_short(_TRIM)} END", 1), "question": (f"CASE WHEN role='user' AND {_TRIM} LIKE '%?' THEN {_short(_TRIM)} END", 10),
    "decision": (_hint(DECISIONS), 10), "constraint": (_hint(CONSTRAINTS), 10),
})


def _check(a: int, b: int, c: int, source: str = "conversations") -> str:
    size = f"strlen({_TRIM})"
    return _ranked({"decision": (_hint(DECISIONS), a), "finding": (_hint(FINDINGS), b), "question": (f"CASE WHEN role='user' AND {size}>5 AND {size}<500 THEN {_short(_TRIM)} END", c)}, source)


def _items(t: DataFrame) -> DataFrame:
    """Notes of conversations as a project's items: the canonical ones first."""
    first = notes.canonical_state(t, DECISIONS, CONSTRAINTS).filter("kind != 'goal'").withColumn("priority", F.lit(0))
    then = notes.checkpoint_data(t, DECISIONS, FINDINGS).filter("kind != 'finding'").withColumn("priority", F.lit(1))
    return first.unionByName(then).withColumn("project", F.col("conv_id") % 10)


def _halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of even documents and of the odd ones after them, with one key a pair."""
    parts = text.sections(docs, "The ").select(F.floor(F.col("doc_id") / 2).alias("key"), "doc_id", F.col("section").alias("place"), F.substring("heading", 1, 12).alias("heading"), F.col("tokens").alias("body"))
    return parts.filter("doc_id % 2 = 0").drop("doc_id"), parts.filter("doc_id % 2 = 1").drop("doc_id")


def _points(e: DataFrame) -> DataFrame:
    return e.filter("tool = 'Write'").groupBy("session").agg(F.max_by("uuid", "idx").alias("uuid"))


def _candidates(e: DataFrame) -> DataFrame:
    return e.filter("is_error or type = 'progress'").select("session", "uuid")


def _stats(e: DataFrame) -> DataFrame:
    used = F.when(F.col("ctx").isNotNull(), F.col("idx"))
    per = e.groupBy("session").agg((F.min_by("type", "idx") == "progress").alias("starts_queued"), F.sum("raw_size").alias("bytes"), F.coalesce(F.max_by("ctx", used), F.lit(0)).alias("current_ctx"), F.count_if(F.col("type") == "assistant").alias("assistant_rows"))
    cuts = sequence.detect_compactions(e).groupBy("session").agg(F.count("*").alias("compactions"))
    return per.join(cuts, "session", "left").na.fill(0, ["compactions"])


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("project"), F.col("o_orderdate").cast("date").alias("ts"))


def build(entries, blocks, both, priced, scored, of, sql, tangent, pieces: dict[str, str], oracle: dict[str, str]) -> tuple[dict, dict]:
    """(queries, SQL). The arguments are the catalog's helpers, its shared pieces of SQL and its SQL so far."""

    def all_three(f):
        def run(spark, d):
            rows = bridge.entries(spark, d)
            return f(rows, bridge.blocks(rows), bridge.prices(spark))

        return run

    def quick(e, b):
        held = cost.health(e, b).select("session", F.floor("signal_percent").alias("signal_percent"))
        return overview.quick_list_scores(_stats(e).select("session", "current_ctx", "compactions").join(held, "session"))

    def conversations(f):
        return of("conversations", f)

    queries = {
        "media_type_audit": lambda s, d: rewrite.media_type_audit(_images(s, d)),
        "image_stats": lambda s, d: rewrite.image_stats(_images(s, d), "source"),
        "replace_images": lambda s, d: _contents(s, d, rewrite.replace_images),
        "replace_oversized": lambda s, d: _contents(s, d, lambda c: rewrite.replace_oversized(c, 2000)),
        "fix_media_types": lambda s, d: _contents(s, d, rewrite.fix_media_types),
        "collapse_preview": entries(lambda e: rewrite.collapse_preview(e, _candidates(e), _points(e))),
        "collapse": entries(lambda e: rewrite.collapse(e, _candidates(e), _points(e)).select("session", "idx", "uuid", "parent_uuid")),
        "patch_parents": entries(lambda e: rewrite.patch_parents(e, e.filter("is_error or raw_size > 4000").select("session", "uuid")).select("session", "idx", "uuid", "parent_uuid")),
        "reconnect_sidechains": both(lambda e, b: rewrite.reconnect_sidechains(e, b).select("session", "idx", "uuid", "parent_uuid")),
        "canonical_state": conversations(lambda t: notes.canonical_state(t, DECISIONS, CONSTRAINTS)),
        "checkpoint_data": conversations(lambda t: notes.checkpoint_data(t, DECISIONS, FINDINGS)),
        "preserve_data": conversations(lambda t: notes.preserve_data(t, t.filter("turn % 3 = 0"), DECISIONS, FINDINGS)),
        "decision_lineage": conversations(lambda t: notes.decision_lineage(notes.canonical_state(t, DECISIONS, CONSTRAINTS), "TION")),
        "vector_items": conversations(lambda t: notes.vector_items(_items(t))),
        "section_merge": of("documents", lambda t: notes.section_merge(*_halves(t))),
        "timeline": priced(lambda e, p: overview.timeline(e, p, e.filter("is_error").select("session", "uuid", F.lit("keep").alias("marker")))),
        "record_snapshot": all_three(overview.record_snapshot),
        "quick_list_scores": both(quick),
        "zombie": entries(lambda e: scoring.zombie(_stats(e), 60_000, 0)),
        "filter_snapshots": lambda s, d: overview.filter_snapshots(_orders(s, d), "180 days").select("session", "project"),
        "weekly_savings": lambda s, d: overview.weekly_savings(bridge.table(s, d, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("avoided")), ANCHOR),
    }
    gone = "(is_error OR type='progress')"
    taken = f"gone AS (SELECT e.session, e.uuid, e.parent_uuid FROM e JOIN (SELECT session, max(idx) AS at FROM e WHERE tool='Write' GROUP BY session) p ON p.session=e.session AND e.idx<p.at WHERE {gone})"
    stats = """(SELECT q.*, coalesce(k.n,0) AS cuts FROM (SELECT session, arg_min(type,idx)='progress' AS queued, CAST(sum(raw_size) AS BIGINT) AS bytes, coalesce(arg_max(ctx,idx) FILTER (WHERE ctx IS NOT NULL),0) AS cur, count(*) FILTER (WHERE type='assistant') AS talk FROM e GROUP BY session) q
     LEFT JOIN (SELECT session, count(*) AS n FROM c GROUP BY session) k ON k.session=q.session)"""
    swept = oracle["cadence"][oracle["cadence"].index("SELECT session, round(x,9) AS score"):].replace("FROM mx", "FROM qk")
    slices = "(SELECT *, 0 AS part FROM ep WHERE idx<20 UNION ALL SELECT *, 1 FROM ep)"
    found = {
        "media_type_audit": f"WITH {_IM} SELECT doc_id, source, media_type, detected FROM id WHERE detected<>media_type",
        "image_stats": f"WITH {_IM} SELECT source, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes)//750 AS BIGINT) AS tokens FROM id GROUP BY source",
        "replace_images": _content(_HOLDER),
        "replace_oversized": _content(f"CASE WHEN bytes>2000 THEN {_HOLDER} ELSE {_BLOCK % 'media_type'} END"),
        "fix_media_types": _content(_BLOCK % "coalesce(detected,media_type)"),
        "collapse_preview": sql("SELECT session, count(*) AS rows FROM gone GROUP BY session", taken),
        "collapse": sql(
            """SELECT k.session, k.idx, k.uuid, CASE WHEN p.uuid IS NULL THEN k.parent_uuid ELSE t.target END AS parent_uuid FROM (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.session=e.session AND g.uuid=e.uuid)) k
            LEFT JOIN gone p ON p.session=k.session AND p.uuid=k.parent_uuid
            LEFT JOIN (SELECT session, origin, arg_max(struct_pack(p := parent_uuid),d).p AS target FROM up GROUP BY ALL) t ON t.session=k.session AND t.origin=k.parent_uuid""",
            taken,
            """up AS (SELECT session, uuid AS origin, parent_uuid, 0 AS d FROM gone
            UNION ALL SELECT u.session, u.origin, g.parent_uuid, u.d+1 FROM up u JOIN gone g ON g.session=u.session AND g.uuid=u.parent_uuid)""",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "patch_parents": sql(
            """SELECT session, idx, uuid, CASE WHEN is_error OR raw_size>4000 OR EXISTS (SELECT 1 FROM lost l WHERE l.session=e.session AND l.parent_uuid=e.parent_uuid) THEN NULL ELSE parent_uuid END AS parent_uuid FROM e""",
            "lost AS (SELECT session, parent_uuid FROM e WHERE (is_error OR raw_size>4000) AND parent_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e k WHERE k.session=e.session AND k.uuid=e.parent_uuid))",
        ),
        "reconnect_sidechains": sql(f"SELECT e.session, e.idx, e.uuid, CASE WHEN d.class='repairable' AND contains(d.reasons,'missing_parent') THEN d.reconnect_to ELSE e.parent_uuid END AS parent_uuid FROM e LEFT JOIN ({oracle['detect_sidechains']}) d ON d.session=e.session AND d.idx=e.idx"),
        "canonical_state": _CANON,
        "checkpoint_data": _check(20, 20, 15),
        "preserve_data": _check(50, 50, 30, "(SELECT * FROM conversations WHERE turn%3=0)"),
        "decision_lineage": f"SELECT conv_id, count(*) AS hits FROM ({_CANON}) WHERE kind IN ('goal','decision') AND contains(lower(text),'tion') GROUP BY conv_id",
        "vector_items": rf"""SELECT project, kind, text, priority, conv_id FROM (SELECT *, row_number() OVER (PARTITION BY project, kind, key ORDER BY priority, conv_id, rank, text) AS r FROM (SELECT *, conv_id%10 AS project, lower(trim(regexp_replace(text,'\s+',' ','g'))) AS key FROM
        (SELECT *, 0 AS priority FROM ({_CANON}) WHERE kind<>'goal' UNION ALL SELECT *, 1 FROM ({_check(20, 20, 15)}) WHERE kind<>'finding')) WHERE key<>'') WHERE r=1""",
        "section_merge": f"""WITH pt AS (SELECT doc_id//2 AS key, doc_id%2 AS odd, section AS place, substr(heading,1,12) AS heading, tokens AS body, trim(regexp_replace(regexp_replace(lower(substr(heading,1,12)),'[^a-z0-9 _-]','','g'),'[ _-]+',' ','g')) AS norm FROM ({oracle['section_split']})),
        hd AS (SELECT key, heading, any_value(norm) AS norm, arg_max(body,place) AS body, min(place) AS f FROM pt WHERE odd=0 GROUP BY ALL),
        so AS (SELECT s.*, coalesce(x.heading, l.heading) AS hit FROM pt s LEFT JOIN hd x ON x.key=s.key AND x.heading=s.heading LEFT JOIN (SELECT key, norm, arg_min(heading,f) AS heading FROM hd GROUP BY ALL) l ON l.key=s.key AND l.norm=s.norm WHERE s.odd=1),
        nw AS (SELECT key, hit, arg_max(body,place) AS body FROM so WHERE hit IS NOT NULL GROUP BY ALL)
        SELECT t.key, 'target' AS part, t.place, t.heading, CASE WHEN n.hit IS NULL THEN h.body ELSE n.body END AS body, CASE WHEN n.hit IS NULL THEN 'keep' ELSE 'replace' END AS action FROM pt t JOIN hd h ON h.key=t.key AND h.heading=t.heading LEFT JOIN nw n ON n.key=t.key AND n.hit=t.heading WHERE t.odd=0
        UNION ALL SELECT key, 'source', place, heading, body, 'append' FROM so WHERE hit IS NULL""",
        "timeline": sql(
            f"""SELECT k.session, k.epoch, k.turns, k.peak_ctx, k.dollars, coalesce(d.dir, CASE WHEN t.tool='Bash' THEN 'debugging/testing' WHEN t.tool='Read' THEN 'code exploration' WHEN t.tool IN ('Edit','Write') THEN 'implementation' ELSE 'tool focus: '||t.tool END, 'epoch '||k.epoch) AS topic,
            coalesce(s.out_scope,0) AS out_scope, round(coalesce(s.out_scope,0)/CAST(greatest(coalesce(s.in_scope,0)+coalesce(s.out_scope,0),1) AS DOUBLE),6) AS drift, coalesce(g.n,0) AS ghosts, coalesce(m.n,0) AS marks, k.epoch=max(k.epoch) OVER (PARTITION BY k.session) AS active FROM ({oracle['epoch_cost']}) k
            LEFT JOIN (SELECT session, epoch, dir FROM (SELECT *, row_number() OVER (PARTITION BY session, epoch ORDER BY n DESC, dir) AS r FROM (SELECT session, epoch, regexp_replace(path,'/[^/]*$','') AS dir, count(DISTINCT path) AS n FROM ep WHERE path IS NOT NULL GROUP BY ALL)) WHERE r=1) d ON d.session=k.session AND d.epoch=k.epoch
            LEFT JOIN (SELECT session, epoch, tool FROM (SELECT *, row_number() OVER (PARTITION BY session, epoch ORDER BY n DESC, tool) AS r FROM (SELECT session, epoch, tool, count(*) AS n FROM ep WHERE tool IS NOT NULL GROUP BY ALL)) WHERE r=1) t ON t.session=k.session AND t.epoch=k.epoch
            LEFT JOIN sp s ON s.session=k.session AND s.epoch=k.epoch LEFT JOIN (SELECT session, epoch+1 AS epoch, count(*) AS n FROM ({oracle['ghost_files']}) GROUP BY ALL) g ON g.session=k.session AND g.epoch=k.epoch
            LEFT JOIN (SELECT session, epoch, count(*) AS n FROM ep WHERE is_error GROUP BY ALL) m ON m.session=k.session AND m.epoch=k.epoch""",
            pieces["scope"],
        ),
        "record_snapshot": sql(
            f"""SELECT q.session, q.project, q.turns, q.compactions, x.usage_percent, h.grade AS signal_grade, h.signal_percent, h.noise_tokens, h.biggest AS top_noise, c.dollars, c.per_turn, c.primary_model, d.seconds/3600 AS hours, round(CASE WHEN d.seconds>0 THEN c.dollars/(d.seconds/3600) END,6) AS per_hour
            FROM (SELECT session, project, count(*) FILTER (WHERE type IN ('user','assistant')) AS turns, max(epoch) AS compactions FROM ep GROUP BY ALL) q LEFT JOIN ({oracle['session_duration']}) d ON d.session=q.session LEFT JOIN ({oracle['context_stats']}) x ON x.session=q.session
            LEFT JOIN ({oracle['health']}) h ON h.session=q.session LEFT JOIN ({oracle['session_cost']}) c ON c.session=q.session"""
        ),
        "quick_list_scores": sql(
            f"""SELECT q.session, round(q.score,9) AS entropy, CASE WHEN q.score<=20 THEN 'LOW' WHEN q.score<=50 THEN 'MEDIUM' WHEN q.score<=75 THEN 'HIGH' ELSE 'CRITICAL' END AS level, w.score AS cadence, w.status FROM
            (SELECT session, 100*(0.30::DOUBLE*(1-CASE WHEN sig>90 THEN 0.95 WHEN sig>75 THEN 0.80 WHEN sig>60 THEN 0.65 WHEN sig>40 THEN 0.45 ELSE 0.20 END::DOUBLE)+0.25::DOUBLE*least(current_ctx/165000.0::DOUBLE,1.0)+0.10::DOUBLE*least(cuts,10)/10) AS score FROM qk) q JOIN ({swept}) w ON w.session=q.session""",
            f"""qk AS (SELECT s.session, s.cur AS current_ctx, s.cuts, h.sig, 1200.0::DOUBLE AS growth_rate, greatest(165000-s.cur,0)//1200 AS turns_left, 0 AS since, 0.0::DOUBLE AS usage_percent, CAST(NULL AS VARCHAR) AS biggest, CAST(floor(s.cur*(100-h.sig)/100.0::DOUBLE) AS BIGINT) AS noise_tokens,
            CAST(floor(s.cur*(100-h.sig)/100.0::DOUBLE) AS BIGINT)/CAST(s.cur AS DOUBLE) AS ratio FROM {stats} s JOIN (SELECT session, CAST(floor(signal_percent) AS BIGINT) AS sig FROM ({oracle['health']})) h ON h.session=s.session WHERE s.cur>0)""",
        ),
        "zombie": sql(f"SELECT session, signals, CASE WHEN bytes>60000 AND cur=0 THEN 'large file, lost context' WHEN cuts>0 AND cur=0 THEN 'many compactions, lost context' WHEN bytes>60000 AND cuts>0 THEN 'large file, many compactions' ELSE 'too large' END AS reason FROM (SELECT *, CAST(CAST(bytes>60000 AS INT)+CAST(cur=0 AND talk>10 AS INT)+CAST(cuts>0 AS INT) AS BIGINT) AS signals FROM {stats} WHERE queued) WHERE signals>=2"),
        "filter_snapshots": "SELECT o_orderkey AS session, o_custkey AS project FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - INTERVAL 180 DAY",
        "weekly_savings": f"SELECT CAST(DATE '{ANCHOR}' + CAST(week*7 AS INT) AS DATE) AS week_start, count(*) AS events, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE),2) AS avoided FROM (SELECT *, floor(date_diff('day', DATE '{ANCHOR}', CAST(l_shipdate AS DATE))/7.0) AS week FROM lineitem) GROUP BY week",
        "stream_branches": sql("SELECT session, min(ts) AS first_ts, count(*) AS rows FROM (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, idx) AS g FROM (SELECT *, coalesce(ts-lag(ts) OVER (PARTITION BY session ORDER BY ts, idx) > INTERVAL 12 HOUR,false) AS far FROM e)) GROUP BY session, g"),
        "stream_auto_checkpoint": sql("SELECT session, min(idx) AS idx, epoch, arg_min(ctx,idx) AS ctx FROM ep WHERE ctx>=140000 GROUP BY session, epoch"),
        "stream_expert_trigger": sql(
            f"""SELECT session, idx, ctx, turns_left FROM (SELECT *, CASE WHEN ctx//uses>0 AND ctx<165000 THEN (165000-ctx)//(ctx//uses) ELSE 0 END AS turns_left FROM
            (SELECT part, session, max(idx) AS idx, arg_max(ctx,idx) AS ctx, count(*) FILTER (WHERE epoch=le) AS uses FROM (SELECT *, max(epoch) OVER (PARTITION BY part, session) AS le FROM {slices} WHERE ctx IS NOT NULL) GROUP BY part, session) WHERE part=0 OR idx>=20) WHERE ctx>0 AND (ctx>=160000 OR turns_left<5)"""
        ),
        "stream_changed_sessions": sql(
            """SELECT session, CAST(CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN z IS NOT NULL AND (a IS NULL OR z > a + INTERVAL 30 SECOND) THEN 1 ELSE 0 END AS BIGINT) AS times FROM
            (SELECT session, max(ts) FILTER (WHERE idx<20) AS a, max(ts) FILTER (WHERE idx>=20) AS z FROM e GROUP BY session)"""
        ),
        "stream_savings_totals": "SELECT l_orderkey AS session, count(*) AS events, CAST(sum(floor(l_quantity)) AS BIGINT) AS tokens, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS avoided FROM lineitem GROUP BY l_orderkey",
        "stream_clean": oracle["clean_tiers"],
        "stream_tangent_advisory": f"SELECT session, count(*) AS groups, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(tokens) AS BIGINT) AS tokens FROM ({oracle['find_tangents']}) GROUP BY session",
    }
    return queries, found
