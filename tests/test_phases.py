"""Clean-up in phases on logs made by hand, and what lasts from epoch to epoch."""

import json

import duckdb
import pytest

import __spark_entry__
from logloom.operators import decay, phases
from logloom.sources import jsonl

SMALL = "/root/testdata/sf0.001"
RULE = "-" * 50
LONG = "\n".join("line " + "x" * 200 for _ in range(30))


def line(uuid, parent, kind, content=None, **more):
    message = {} if content is None else {"message": {"role": kind, "content": content}}
    return json.dumps({"type": kind, "cwd": "/w"} | ({"uuid": uuid} if uuid else {}) | ({"parentUuid": parent} if parent else {}) | message | more)


def use(i, name="Read", **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def answer(i, content="x", **more):
    return {"type": "tool_result", "tool_use_id": i, "content": content} | more


def said(text):
    return {"type": "text", "text": text}


MAIN = [
    line("a", None, "user", "hi"),
    line("p", "a", "progress"),
    line(None, None, "file-history-snapshot"),
    line("b", "p", "assistant", [said("first"), use("t1", file_path="/w/x")]),
    line("c", "b", "user", [answer("t1")]),
    line("d", "c", "assistant", [use("t2", file_path="/w/./x")]),
    line("e", "d", "user", [answer("t2")]),
    line("g", "e", "assistant", [use("t3", "Bash", command="make")]),
    line("h", "g", "user", [answer("t3", "bad", is_error=True)]),
    line("i", "h", "assistant", [use("t4", "Bash", command="make")]),
    line("j", "i", "user", [answer("t4", LONG)]),
    line("k", "j", "user", [answer("lost")]),
    line("m", "k", "assistant", [said(f'over\n{RULE}\nquoted "parentUuid":"k"')]),
    line("n", "m", "user", [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "iVBORw0KGgoAAA"}}]),
]
AWAY = [
    line("a", None, "user", "go"),
    line("b", "a", "assistant", [use("t1", file_path="/other/a"), said("y" * 500)]),
    line("c", "b", "user", [answer("t1")]),
    line("d", "c", "assistant", [use("t2", file_path="/other/b")]),
    line("e", "d", "user", [answer("t2")]),
    line("f", "e", "assistant", [use("t3", file_path="/w/x")]),
    line("g", "f", "user", [answer("t3")]),
]
#: A side row's call is answered by a row of the chain, from which more follows.
FALL = [
    line("a", None, "user", "go"),
    line("s", "a", "assistant", [use("t1", file_path="/w/x")], isSidechain=True),
    line("c", "a", "user", [answer("t1"), said("see")]),
    line("d", "c", "assistant", [said("so")]),
    line("z", "a", "assistant", [said("end")]),
]


def log(spark, folder, **sessions):
    (folder / "p").mkdir()
    for name, rows in sessions.items():
        (folder / "p" / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    return jsonl.scan_entries(spark, str(folder / "p"))


def got(rows, session):
    return {r["uuid"]: (r["parent_uuid"], json.loads(r["raw"])) for r in rows.filter(f"session = '{session}'").orderBy("idx").collect()}


def test_all_phases(spark, tmp_path):
    rows = log(spark, tmp_path, main=MAIN, away=AWAY, fall=FALL)
    done, audit = phases.clean_log(rows)
    counts = {r["session"]: r.asDict() for r in audit.collect()}
    main = counts["main"]
    named = {"progress": 1, "snapshots": 1, "sidechains": 1, "stale_reads": 1, "failed_retries": 1, "images": 1, "separators": 1, "outputs": 1, "merged": 1, "stripped": 0, "tangents": 0, "orphans": 0, "keep_skipped": 0}
    assert {k: main[k] for k in named} == named
    assert main["bytes_before"] == sum(len(x) for x in MAIN) and main["tokens_saved"] == (main["bytes_before"] - main["bytes_after"]) // 4
    left = got(done, "main")
    assert list(left) == ["a", "b", "e", "i", "j", "m", "n"]
    assert [left[u][0] for u in left] == [None, "a", "b", "e", "i", "j", "m"]
    assert [left[u][1].get("parentUuid") for u in left] == [None, "a", "b", "e", "i", "j", "m"]
    content = {u: left[u][1]["message"]["content"] for u in left}
    assert content["b"] == [said("first"), use("t2", file_path="/w/./x")]
    assert content["m"] == [said('over\nquoted "parentUuid":"k"')]
    assert content["n"][0]["type"] == "text"
    short = content["j"][0]["content"].split("\n")
    assert len(short) == 21 and "10 lines truncated" in short[10]
    assert main["bytes_after"] == sum(r["raw_size"] for r in done.filter("session = 'main'").collect())
    assert counts["away"]["tangents"] == 4 and list(got(done, "away")) == ["a", "f", "g"]
    assert got(done, "away")["f"][0] == "a"
    fall = counts["fall"]
    assert fall["sidechains"] == 1 and fall["orphans"] == 2 and list(got(done, "fall")) == ["a", "z"]


def test_kept_rows_and_tombstones(spark, tmp_path):
    rows = log(spark, tmp_path, main=MAIN, fall=FALL)
    keep = spark.createDataFrame([("main", "p"), ("main", "c")], "session string, uuid string")
    done, audit = phases.clean_log(rows, keep, tombstone=True)
    counts = {r["session"]: r.asDict() for r in audit.collect()}
    assert counts["main"]["progress"] == 0 and counts["main"]["keep_skipped"] == 1 and counts["main"]["stale_reads"] == 0
    assert {"p", "c"} <= set(got(done, "main"))
    assert counts["fall"]["tombstoned"] == 1 and counts["fall"]["orphans"] == 0
    left = got(done, "fall")
    assert list(left) == ["a", "d"] and left["a"][1]["message"]["content"] == [said("go"), said(phases.ORPHAN)]
    assert left["d"][1]["message"]["content"] == [said("so"), said("end")]


def test_empty_log(spark, tmp_path):
    rows = log(spark, tmp_path, main=MAIN).limit(0)
    done, audit = phases.clean_log(rows)
    assert done.count() == 0 and audit.count() == 0


def test_coalesce(spark, tmp_path):
    rows = [
        line("a", None, "user", "hi"),
        line("s", "a", "system"),
        line("b", "s", "user", [said("there"), answer("none")]),
        line("c", "b", "assistant", [use("t1", file_path="/w/x")]),
        line("q", "c", "progress"),
        line("d", "c", "assistant", [use("t2", file_path="/w/y")]),
        line("e", "d", "user", [answer("t1")]),
        line("f", "e", "user", [answer("t2"), answer("t9")]),
        line("g", "f", "file-history-snapshot"),
        line("h", "f", "user", [answer("t2")]),
    ]
    out = phases.coalesce(log(spark, tmp_path, s=rows)).orderBy("idx").collect()
    assert [(r["uuid"], r["merged"], r["stripped"]) for r in out] == [("s", 0, 0), ("a", 1, 1), ("q", 0, 0), ("c", 1, 0), ("e", 1, 1), ("g", 0, 0), ("h", 0, 1)]
    assert {r["uuid"]: r["parent_uuid"] for r in out} == {"s": "a", "a": None, "q": "c", "c": "a", "e": "c", "g": "e", "h": "f"}
    held = {r["uuid"]: json.loads(r["content"]) for r in out if r["content"]}
    assert held["a"] == [said("hi"), said("there")] and [b["id"] for b in held["c"]] == ["t1", "t2"]
    assert [b["tool_use_id"] for b in held["e"]] == ["t1", "t2"] and held["h"] == [said(phases.EMPTIED)]


def test_parents_change_in_the_line_only(spark, tmp_path):
    rows = log(spark, tmp_path, s=[line("a", None, "user", 'say "parentUuid":"z"'), line("b", "z", "user", [said('"parentUuid":"z"')])])
    out = {r["uuid"]: json.loads(r["raw"]) for r in jsonl.with_parents(rows.selectExpr("* except (parent_uuid)", "'a' as parent_uuid")).collect()}
    assert out["b"]["parentUuid"] == "a" and out["b"]["message"]["content"] == [said('"parentUuid":"z"')]
    assert out["a"]["parentUuid"] == "a" and out["a"]["message"]["content"] == 'say "parentUuid":"z"'


def test_half_life(spark):
    paths = lambda *p: [{"path": x, "tool": "Read"} for x in p]
    rows = [("s", 0, "assistant", 90000, 100, 40, paths("/a", "/b"), ["Read", "Read"]), ("s", 1, "assistant", 95000, 100, 40, paths("/c"), ["Read"]), ("s", 2, "assistant", 20000, 0, 400, paths("/a"), ["Grep"]), ("s", 3, "assistant", 25000, 10, 40, [], [])]
    e = spark.createDataFrame(rows, "session string, idx long, type string, ctx long, output_tokens long, raw_size long, refs array<struct<path:string,tool:string>>, tools array<string>")
    out = [r.asDict() for r in decay.half_life(e).orderBy("epoch").collect()]
    assert [(r["turns"], r["tokens"], r["files"], r["decay"], r["dead_percent"]) for r in out] == [(3, 200, 3, 0.666667, 66.666667), (1, 110, 1, 0.0, 0.0)]
    assert {r["half_life"] for r in out} == {4} and out[0]["dead_share"] == round(133 / 310 * 100, 6)
    assert [tuple(r)[3:] for r in decay.tool_shifts(e).orderBy("rank").collect()] == [("Read", 3, 0, "dropped"), ("Grep", 0, 1, "new")]
    assert [tuple(r)[2:] for r in decay.scope_shifts(e).collect()] == [(0, 2, 1, "contracted", -90)]


@pytest.mark.parametrize("name", ["coalesce_log", "half_life_epochs", "tool_shifts", "scope_shifts"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    out = __spark_entry__.queries()[name](spark, SMALL).select(*names)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want.fetchall()))
