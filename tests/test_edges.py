"""Pairs of decisions and sessions, and chains that are walked, against plain loops."""

import random

from pyspark.sql import functions as F

from logloom.operators import cross, graphops, views


def test_decision_edges_match_all_pairs(spark):
    r = random.Random(3)
    points = [(r.choice([None, *range(12)]), r.choice(["a", "b", "c", None]), r.choice(["f", "g", "h", None])) for _ in range(25)]
    points += [(100 + i, "a", f) for i in range(20) for f in ("f", "g")]
    touches = [(r.choice(["a", "b", "c", "d", "e", None]), r.choice(["f", "g", "i", None])) for _ in range(30)]
    want = {(p, s) for p, own, f in points for s, g in touches if f == g and None not in (f, own, s) and s != own}
    df = views.decision_edges(spark.createDataFrame(points, "point long, session string, path string"), spark.createDataFrame(touches, "session string, path string"))
    got = [tuple(x) for x in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_broken_chains_leave_out_whole_ones(spark):
    rows = [("whole", 0, 1, None), ("whole", 1, 2, 1), ("lost", 0, 1, 9), ("lost", 1, 2, 1), ("ring", 0, 1, 2), ("ring", 1, 2, 1), ("aside", 0, 1, 9), ("aside", 1, 2, None)]
    m = spark.createDataFrame([(s, i, u, p, "user", p == 9) for s, i, u, p in rows], "session string, idx long, uuid long, parent_uuid long, type string, missing boolean")
    all_of = {x.session: x.broken for x in graphops.chain_integrity(m).collect()}
    some = {x.session: x.broken for x in views.broken_chains(m).collect()}
    assert all_of == {"whole": False, **some} and "whole" not in some and some["ring"] and some["lost"]


def test_pairs_of_a_hot_key_are_made_in_blocks(spark):
    a = spark.createDataFrame([(k, i) for k in ("x", "y", None) for i in range(40)] + [("left", 1)], "k string, a long")
    b = spark.createDataFrame([(k, i) for k in ("x", "z", None) for i in range(50)] + [("y", 7), ("y", 7)], "k string, b long")
    pairs = cross.blocked(a, b, ["k"], parts=3, rows=10, hub=4)
    want = [("x", i, j) for i in range(40) for j in range(50)] + [("y", i, 7) for i in range(40)] * 2
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert not any(d in pairs._jdf.queryExecution().executedPlan().toString() for d in ("Cartesian", "NestedLoop"))


def test_pairs_of_decisions_and_sessions_are_not_dealt(spark):
    """The join that makes pairs comes last, so that no exchange or sort takes them."""
    points = spark.createDataFrame([("p", 1, "/a/x"), ("q", 2, "/a/y")], "session string, ts long, path string")
    touches = spark.createDataFrame([(f"s{i}", 3, "/a/x") for i in range(9)], "session string, ts long, path string")
    edges = views.decision_edges(points.select(F.col("ts").alias("point"), "session", "path"), touches.select("session", "path"))
    for df, least in ((cross.decision_conflicts(points, touches), 18), (edges, 9)):
        assert df.count() == least
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        above = plan[: plan.index("Join [")]
        assert "Exchange" not in above and "Sort " not in above and "_part" in plan.split("Join [")[1].split("]")[0]
