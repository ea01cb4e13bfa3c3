"""Sessions within a day of each other against all pairs, and appends that a second run does not double."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from logloom.operators import nearness
from logloom.sources import sidecar

SMALL = "/root/testdata/sf0.001"
DAY = 86400


def test_no_link_is_lost(spark):
    rng = random.Random(3)
    zero = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    spans = {f"s{i}": (rng.choice("pq"), rng.randrange(40) * DAY // 4, rng.randrange(6) * DAY // 4) for i in range(60)}
    rows = [(p, s, zero + dt.timedelta(seconds=a + x)) for s, (p, a, n) in spans.items() for x in (0, n)]
    entries = spark.createDataFrame(rows + [("p", "none", None), (None, "lone", zero)], "project string, session string, ts timestamp")
    got = {r["session"]: r for r in nearness.temporal_classes(entries).collect()}
    assert set(got) == set(spans)
    for s, (p, a, n) in spans.items():
        near = {o for o, (q, c, m) in spans.items() if o != s and q == p and max(c - a - n, a - c - m, 0) <= DAY}
        assert got[s]["links"] == len(near)
        told = {o for o in spans if o != s and spans[o][0] == p and got[o]["starts_before"] < got[s]["reach"] and got[o]["ends_at"] > got[s]["passed"]}
        assert told == near


def test_temporal_classes_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["temporal_classes"])
    names = [c[0] for c in want.description]
    out = __spark_entry__.queries()["temporal_classes"](spark, SMALL).select(*names)
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "savings")
    events = spark.createDataFrame([("s1", 5), ("s2", 7)], "session_id string, tokens_removed long")
    for c, t in (("slug", "string"), ("ts", "timestamp"), ("turns_remaining", "long"), ("model", "string"), ("avoided_tokens", "long"), ("avoided_cost", "double")):
        events = events.withColumn(c, F.lit(None).cast(t))
    sidecar.append_savings(events, path, batch="b1")
    sidecar.append_savings(events.filter("session_id = 's1'"), path, batch="b2")
    sidecar.append_savings(events, path, batch="b1")
    out = sidecar.scan_savings(spark, path, lines=True)
    assert sorted((r["session_id"], r["tokens_removed"]) for r in out.collect()) == [("s1", 5), ("s1", 5), ("s2", 7)]
    assert "batch" not in out.columns


def test_snapshots_once(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    first = spark.createDataFrame([("s1", "A", 1.5)], "session string, grade string, dollars double")
    for _ in range(2):
        sidecar.append_snapshots(first, path, batch=0)
    sidecar.append_snapshots(first.withColumn("grade", F.lit("B")), path, batch=1)
    got = sidecar.scan_snapshots(spark, path, first.schema).collect()
    assert sorted(map(tuple, got)) == [("s1", "A", 1.5), ("s1", "B", 1.5)]
