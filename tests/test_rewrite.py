"""Rewriting of parsed JSON lines: what is written back parses again, and what was not named stays."""

import base64
import json

from pyspark.sql import functions as F

from logloom.operators import notes, rewrite
from logloom.sources import jsonl

PNG = base64.b64encode(bytes.fromhex("89504E470D0A1A0A") + b"x" * 20).decode()


def line(uuid, parent, kind, content, **more):
    return json.dumps({"type": kind, "uuid": uuid, "parentUuid": parent, "zeta": {"b": [1, None], "a": 1.5}, "message": {"role": kind, "content": content, "more": 1}} | more)


def image(kind):
    return {"type": "image", "source": {"type": "base64", "media_type": kind, "data": PNG}}


def call(name):
    return {"type": "tool_use", "id": name, "name": "Read", "input": {"file_path": "/a"}}


def answer(name):
    return {"type": "tool_result", "tool_use_id": name, "content": "x"}


def log(spark, tmp_path):
    rows = [
        line("a", None, "user", "hello"),
        line("b", "a", "user", [image("image/jpeg"), {"type": "text", "text": "see"}]),
        line("c", "b", "assistant", [call("t1"), call("t2")]),
        line("d", "c", "user", [answer("t1")]),
        line("e", "d", "user", [answer("lost")]),
        line("f", "e", "assistant", [{"type": "text", "text": "done"}]),
        line("g", "nowhere", "assistant", "off"),
        line("h", "nowhere", "user", "off too"),
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.jsonl").write_text("\n".join(rows) + "\n")
    return jsonl.scan_entries(spark, str(tmp_path / "p"))


def raw(rows):
    return {r["uuid"]: json.loads(r["raw"]) for r in rows.select("uuid", "raw").collect()}


def test_images(spark, tmp_path):
    rows = log(spark, tmp_path)
    before = raw(rows)
    after = raw(rewrite.with_content(rows, rewrite.replace_images(F.col("content"))))
    assert after["b"]["message"]["content"] == [{"type": "text", "text": rewrite.PLACEHOLDER}, {"type": "text", "text": "see"}]
    assert after["b"]["message"]["more"] == 1 and after["b"]["zeta"] == before["b"]["zeta"]
    assert {k: v for k, v in after.items() if k != "b"} == {k: v for k, v in before.items() if k != "b"}
    fixed = raw(rewrite.with_content(rows, rewrite.fix_media_types(F.col("content"))))
    assert fixed["b"]["message"]["content"][0] == image("image/png")
    assert raw(rewrite.with_content(rows, rewrite.replace_oversized(F.col("content")))) == before
    assert raw(rewrite.with_content(rows, rewrite.replace_oversized(F.col("content"), 10)))["b"]["message"]["content"][0]["type"] == "text"


def test_surgery_drops_emptied_rows(spark, tmp_path):
    rows = log(spark, tmp_path)
    gone = spark.createDataFrame([("s", 2, 0), ("s", 4, 0)], "session string, idx long, block_idx int")
    out = rewrite.content_surgery(rows, gone)
    assert raw(out)["c"]["message"]["content"] == [call("t2")]
    parents = {r["uuid"]: r["parent_uuid"] for r in out.collect()}
    assert "e" not in parents and parents["f"] == "d" and parents["d"] == "c"
    assert json.loads(jsonl.with_parents(out.filter("uuid = 'f'")).first()["raw"])["parentUuid"] == "d"


def test_repair(spark, tmp_path):
    rows = log(spark, tmp_path)
    out = rewrite.repair(rows, jsonl.explode_blocks(rows))
    parents = {r["uuid"]: r["parent_uuid"] for r in out.collect()}
    assert parents == {"a": None, "b": "a", "c": "b", "d": "c", "f": "d", "g": "f", "h": "f"}
    assert raw(out)["b"]["message"]["content"][0] == image("image/png")


def test_rows_without_uuid_or_with_a_shared_one_stay_once(spark):
    rows = spark.createDataFrame(
        [("s", 0, "a", None), ("s", 1, "b", "a"), ("s", 2, None, "b"), ("s", 3, "c", "b"), ("s", 4, "c", "a"), ("s", 5, None, None)], "session string, idx long, uuid string, parent_uuid string"
    ).withColumn("type", F.lit("user"))
    gone = spark.createDataFrame([("s", "b")], "session string, uuid string")
    out = sorted((r["idx"], r["uuid"], r["parent_uuid"]) for r in rewrite.clean.delete_rows(rows, gone).collect())
    assert out == [(0, "a", None), (2, None, "a"), (3, "c", "a"), (4, "c", "a"), (5, None, None)]


def test_patch_takes_rows_that_share_a_missing_parent(spark):
    rows = spark.createDataFrame([("s", 0, "a", "x"), ("s", 1, "b", "x"), ("s", 2, "c", "y"), ("s", 3, "d", "a")], "session string, idx long, uuid string, parent_uuid string")
    out = rewrite.patch_parents(rows, rows.filter("uuid = 'a'").select("session", "uuid"))
    assert sorted((r["uuid"], r["parent_uuid"]) for r in out.collect()) == [("a", None), ("b", None), ("c", "y"), ("d", "a")]


def test_section_merge(spark):
    schema = "key long, place long, heading string, body string"
    target = spark.createDataFrame([(1, 1, "Goals", "old"), (1, 2, "Open-Questions", "q"), (1, 3, "Rest", "r")], schema)
    source = spark.createDataFrame([(1, 1, "open questions!", "new"), (1, 2, "Goals", "g1"), (1, 3, "Goals", "g2"), (1, 4, "More", "m")], schema)
    out = {(r["part"], r["heading"]): (r["body"], r["action"]) for r in notes.section_merge(target, source).collect()}
    assert out == {("target", "Goals"): ("g2", "replace"), ("target", "Open-Questions"): ("new", "replace"), ("target", "Rest"): ("r", "keep"), ("source", "More"): ("m", "append")}


def test_notes_of_empty_and_null_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", " \n "), (1, 2, "user", " Why? "), (1, 3, "assistant", "we chose it"), (1, 4, "assistant", "")], schema)
    out = sorted((r["kind"], r["text"]) for r in notes.canonical_state(turns).collect())
    assert out == [("decision", "chose it"), ("goal", "Why?"), ("question", "Why?")]
    assert notes.canonical_state(spark.createDataFrame([], schema)).count() == 0
