import json

from logloom.operators import noise, sequence
from logloom.sources import jsonl


def line(**k):
    return json.dumps(k, separators=(",", ":"))


def test_scan_blocks_and_stats(spark, tmp_path):
    usage = {"input_tokens": 100, "output_tokens": 7, "cache_creation_input_tokens": 2000, "cache_read_input_tokens": 3000}
    call = [{"type": "text", "text": "look"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/w/a.py"}}]
    rows = [
        line(type="user", uuid="u1", timestamp="2026-03-01T10:00:00Z", cwd="/w", message={"role": "user", "content": "hello"}),
        "",
        "{broken",
        line(type="assistant", uuid="u2", parentUuid="u1", timestamp="2026-03-01T10:01:00Z", message={"role": "assistant", "model": "m-large", "content": call, "usage": usage}),
        line(type="user", uuid="u3", parentUuid="u2", timestamp="2026-03-01T10:02:00Z", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "text", "is_error": True}]}),
        line(type="user", uuid="bad", timestamp="no time", message={"role": "user", "content": "x"}),
        line(type="progress", data={"a": 1}),
        line(type="file-history-snapshot", snapshot={"b": 2}),
    ]
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "s1.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "proj" / "s2.jsonl").write_text("\n")
    lines = jsonl.scan_lines(spark, str(tmp_path))
    entries = jsonl.parse(lines)
    got = entries.orderBy("session", "idx").collect()
    assert [(r.session, r.idx, r.line, r.type) for r in got] == [("s1", 0, 1, "user"), ("s1", 1, 4, "assistant"), ("s1", 2, 5, "user"), ("s1", 3, 7, "progress"), ("s1", 4, 8, "file-history-snapshot")]
    assert got[1].ctx == 5100 and got[1].model == "m-large" and got[0].ctx is None and got[2].raw_size == len(rows[4])
    blocks = jsonl.explode_blocks(entries)
    assert [(b.idx, b.block_idx, b.type, b.text, b.path) for b in blocks.orderBy("idx", "block_idx").collect()] == [
        (0, 0, "text", "hello", None), (1, 0, "text", "look", None), (1, 1, "tool_use", None, "/w/a.py"), (2, 0, "tool_result", None, None),
    ]
    assert noise.orphan_results(blocks).count() == 0 and noise.missing_parents(entries).count() == 0
    stats = {r.session: r for r in jsonl.session_stats(lines, entries).collect()}
    assert stats["s1"].lines == 8 and stats["s1"].entries == 5 and stats["s1"].current_ctx == 5100 and stats["s1"].client_type == "cli"
    assert stats["s2"].entries is None
    assert jsonl.strip_type(lines, "progress").count() == lines.count() - 1
    assert {r.session for r in jsonl.list_sessions(lines).collect()} == {"s1", "s2"}
    jsonl.write_sessions(entries, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted(r.value for r in back.collect()) == sorted(r.raw for r in got)
    assert sequence.turn_number(entries).count() == 5
