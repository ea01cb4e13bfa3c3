import json

from logloom.operators import graphops, noise
from logloom.sources import jsonl, sidecar


def test_markers(spark, tmp_path):
    point = {"uuid": "u3", "timestamp": "2026-03-01T10:00:00Z", "goal": "g", "decisions": ["d"], "files": ["/w/a", "/w/b"]}
    (tmp_path / "s1.json").write_text(json.dumps({"version": 1, "markers": {"u1": "keep", "u2": "noise"}, "phases": {"u1": "decision"}, "commit_points": [point], "bookmarks": {"u1": {"type": "milestone", "label": "x"}}}))
    (tmp_path / "s2.json").write_text(json.dumps({"version": 1, "markers": {"u1": "candidate"}}))
    got = sidecar.scan_markers(spark, str(tmp_path))
    assert sorted(map(tuple, got["markers"].collect())) == [("s1", "u1", "keep"), ("s1", "u2", "noise"), ("s2", "u1", "candidate")]
    assert [tuple(r) for r in got["phases"].collect()] == [("s1", "u1", "decision")]
    assert [tuple(r) for r in got["bookmarks"].collect()] == [("s1", "u1", "milestone", "x")]
    p = got["commit_points"].first()
    assert p.files == ["/w/a", "/w/b"] and p.constraints is None and p.ts is not None


def test_savings_commits_and_snapshots(spark, tmp_path):
    event = {"session_id": "s", "slug": "a", "timestamp": "2026-03-01T10:00:00Z", "tokens_removed": 5, "turns_remaining": 2, "model": "m", "avoided_tokens": 10, "avoided_cost": 0.5}
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "log.json").write_text(json.dumps([event, event | {"session_id": "t"}]))
    old = sidecar.scan_savings(spark, str(tmp_path / "old"))
    assert {r.session_id for r in old.collect()} == {"s", "t"}
    for _ in range(2):
        sidecar.append_savings(old, str(tmp_path / "new"))
    assert sidecar.scan_savings(spark, str(tmp_path / "new"), lines=True).agg({"tokens_removed": "sum"}).first()[0] == 20
    lines = spark.createDataFrame([("h1", 1, "3\t4\ta.py"), ("h1", 1, "-\t-\tb.png"), ("h2", 2, ""), ("h2", 2, "0\t1\tdir/x y")], "hash string, ts int, line string")
    assert [tuple(r) for r in sidecar.scan_commits(lines).orderBy("hash").collect()] == [("h1", 1, "a.py", 3, 4), ("h2", 2, "dir/x y", 0, 1)]
    rows = spark.createDataFrame([("s", 1.23456, 50.0, {"m": 1})], "session string, cost double, signal double, models map<string,int>").coalesce(1)
    sidecar.export_snapshots_csv(rows, str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["session,cost,signal", "s,1.2346,50.00"]


def test_written_sessions_keep_whole_chains(spark, tmp_path):
    """Lines of the rows that stay point at rows that stay, in the line itself."""
    rows = [{"type": "user", "uuid": f"u{i}", "parentUuid": f"u{i - 1}" if i else None, "timestamp": f"2026-03-01T10:00:0{i}Z", "message": {"role": "user", "content": f"says u{i}"}} for i in range(6)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    entries = jsonl.scan_entries(spark, str(tmp_path))
    gone = entries.filter("uuid in ('u1', 'u2', 'u4')").select("session", "uuid")
    parents = graphops.resolve_parents(entries, gone)
    kept = entries.join(gone, ["session", "uuid"], "left_anti").drop("parent_uuid").join(parents, ["session", "uuid"])
    jsonl.write_sessions(kept, f"{tmp_path}/out")
    back = {r["uuid"]: r for r in (json.loads(x.value) for x in spark.read.text(f"{tmp_path}/out").collect())}
    assert {k: v["parentUuid"] for k, v in back.items()} == {"u0": None, "u3": "u0", "u5": "u3"}
    assert back["u3"]["message"] == rows[3]["message"]


def test_cascade_of_any_depth_and_retries(spark):
    n = 3000
    chain = spark.createDataFrame([("s", f"u{i}", f"u{i - 1}" if i else None, i, "user") for i in range(n)], "session string, uuid string, parent_uuid string, idx long, type string")
    none = spark.createDataFrame([], "session string, uuid string, call_uuid string")
    assert graphops.cascade(chain, none, chain.filter("uuid = 'u3'").select("session", "uuid")).count() == n - 3
    calls = [(0, "tool_use", "Bash", "make x", "a", None, False), (1, "tool_result", None, None, None, "a", True), (2, "tool_use", "Bash", "ls", "b", None, False), (3, "tool_use", "Bash", " make x ", "c", None, False)]
    blocks = spark.createDataFrame([("s", i, k, name, None, command, x, r, e, 40) for i, k, name, command, x, r, e in calls], "session string, idx long, kind string, name string, path string, command string, id string, tool_use_id string, is_error boolean, raw_size long")
    assert [(r.call_idx, r.error_idx, r.retry_idx) for r in noise.failed_retries(blocks).collect()] == [(0, 1, 3)]
    assert noise.failed_retries(blocks.filter("idx < 3")).count() == 0
