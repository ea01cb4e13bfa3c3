"""The log parsed before its shuffle, and the frame of it, against the plain forms."""

import json

from pyspark.sql import functions as F

from logloom.operators import frame, noise
from logloom.sources import jsonl

ROWS = [
    ("a", 1, {"type": "assistant", "uuid": "u1", "message": {"role": "assistant", "content": [
        {"type": "text", "text": "We decided so"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/w/./a"}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "cat /w/b /etc/hosts"}}]}}),
    ("a", 2, None),
    ("a", 3, {"type": "user", "uuid": "u2", "parentUuid": "u1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t2", "content": "x" * 5000}, {"type": "tool_result", "tool_use_id": "t9", "content": [{"type": "text", "text": "Error: no"}]}]}}),
    ("a", 4, {"type": "assistant", "uuid": "u3", "parentUuid": "gone", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t3", "name": "Read", "input": {"path": "/w/a"}}, {"type": "text", "text": "It was chosen because"}]}}),
    ("a", 5, {"type": "user", "uuid": "u4", "parentUuid": "u3", "isSidechain": True, "message": {"role": "user", "content": "Why?"}}),
    ("a", 6, {"type": "user", "uuid": "u5", "isSidechain": "yes", "message": {"role": "user", "content": "x"}}),
    ("a", 7, {"type": "progress", "uuid": "u6", "isSidechain": None}),
    ("b", 1, {"type": "user", "uuid": "u1", "message": {"role": "user", "content": [{"type": "image", "source": {"type": "base64", "data": "abcd" * 3}}]}}),
]


def lines(spark):
    rows = [(s, "p", None, n, "{broken" if r is None else json.dumps(r)) for s, n, r in ROWS]
    rows.append(("b", "p", None, 2, '{"type":"user","isS\\u0069dechain":"no","message":{"role":"user","content":"x"}}'))
    return spark.createDataFrame(rows, "session string, project string, modified timestamp, line long, raw string")


def test_fold_is_parse_with_small_blocks(spark):
    whole, small = jsonl.parse(lines(spark)), jsonl.fold(lines(spark))
    assert [(r.session, r.line, r.idx) for r in small.orderBy("session", "idx").collect()] == [("a", 1, 0), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("a", 7, 4), ("b", 1, 0)]
    same = [c for c in whole.columns if c not in ("raw", "content", "blocks")]
    assert sorted(map(repr, whole.select(same).collect())) == sorted(map(repr, small.select(same).collect()))
    assert {r.path for row in small.collect() for r in row.refs} == {"/w/a", "/w/b"}
    blocks = jsonl.block_rows(small)
    same = [c for c in blocks.columns if c != "data_size"]
    assert sorted(map(repr, jsonl.explode_blocks(whole).select(same).collect())) == sorted(map(repr, blocks.select(same).collect()))
    assert [r.data_size for r in blocks.filter("kind = 'image'").collect()] == [12]


def test_frame_counts_rows_once(spark):
    rows = jsonl.fold(lines(spark))
    m = frame.marks(rows.drop("blocks"), jsonl.block_rows(rows))
    got = {(r.session, r.idx): r for r in m.collect()}
    assert len(got) == m.count() == 6
    a = [got["a", i] for i in range(5)]
    assert [(r.stale, r.stale_tags) for r in a] == [(1, 1), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert [(r.orphans, r.large, r.large_tokens) for r in a] == [(0, 0, 0), (1, 1, 1250), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert [r.missing for r in a] == [False, False, True, False, False]
    assert [r.side for r in a] == [False, True, True, True, False] and [r.new_chain for r in a] == [False, True, False, False, False]
    assert a[0].decisions == ["decided so"] and a[2].decisions == ["chosen because"] and a[3].questions == ["Why?"] and not a[4].decisions
    assert (got["b", 0].images, got["b", 0].image_bytes) == (1, 9)


def test_frame_is_dealt_by_session_once(spark):
    """Rows, counts and hints meet in one exchange: joins by (session, idx) dealt and sorted the log anew for each."""
    e = spark.createDataFrame([("a", i, "user", f"u{i}", None, "/w", None, 40, "p") for i in range(3)], "session string, idx long, type string, uuid string, parent_uuid string, cwd string, ctx long, raw_size long, project string")
    e = e.withColumns({"ts": F.lit(None).cast("timestamp"), "refs": F.expr("cast(array() as array<struct<path:string,tool:string>>)"), "blocks": F.expr("array(named_struct('text', 'x', 'name', '', 'id', '', 'tool_use_id', '', 'kind', 'text', 'path', '', 'command', '', 'pattern', '', 'is_error', false, 'result_size', 1L, 'data_size', 1))")})
    plan = frame._frame(e.drop("blocks"), jsonl.block_rows(e), None, "30 minutes")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "Join LeftOuter" not in plan and "Join FullOuter" not in plan


def test_a_read_is_stale_where_the_next_call_reads(spark):
    calls = [("Read", "/w/a"), ("Grep", "/w/a"), ("Read", "/w/a"), ("Edit", "/w/a"), ("Read", "/w/a"), ("Read", "/w/b")]
    b = spark.createDataFrame([("s", i, 0, "tool_use", n, f"t{i}", None, p, None, None, False, 40) for i, (n, p) in enumerate(calls)], "session string, idx long, block_idx int, kind string, name string, id string, tool_use_id string, path string, command string, pattern string, is_error boolean, raw_size long")
    assert [r.idx for r in noise.block_marks(b).filter("stale").collect()] == [0]


def test_rows_bring_what_they_tell_alone(spark):
    """Images, hints and parents just before are taken while the blocks are at hand; the frame and its facts are those of rows without them."""
    rows = jsonl.fold(lines(spark))
    more = frame.own(rows)
    got = {(r.session, r.idx): r for r in more.collect()}
    assert [got["a", i].follows for i in range(5)] == [False, True, False, True, False]
    assert (got["b", 0].images, got["b", 0].image_bytes, got["a", 0].decisions, got["a", 3].questions) == (1, 9, ["decided so"], ["Why?"])
    facts = [sorted(map(repr, frame.derived(e.drop("blocks"), jsonl.block_rows(e)).collect())) for e in (rows, more)]
    assert facts[0] == facts[1]
    some = lambda r: r.asDict() | {c: r[c] or None for c in ("decisions", "questions")}
    marks = [sorted(repr(sorted(some(r).items())) for r in frame.marks(e.drop("blocks"), jsonl.block_rows(e)).collect()) for e in (rows, more)]
    assert marks[0] == marks[1]


def test_numbers_of_facts_need_no_sort_of_the_frame(spark):
    """A maximum of structs, or a list, had every row sorted by epoch; scores ask for numbers only."""
    more = frame.own(jsonl.fold(lines(spark)))
    s = frame.derived(more.drop("blocks"), jsonl.block_rows(more))
    plan = s.select("session", "current_ctx", "growth_rate", "decisions", "seconds")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "Join LeftOuter" not in plan
    assert {r.session: r.decisions for r in s.select("session", "decisions").collect()} == {"a": 0, "b": 0}
