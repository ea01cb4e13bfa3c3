import random

from logloom.operators import cross


def test_conflicts_in_nested_folders(spark):
    points = [
        ("p", 1, "/a/b/x", True), ("q", 1, "/r", False),
        ("under", 0, "/a/b/c/d/z", False), ("over", 0, "/a/z", False), ("beside", 0, "/a/bc/z", False),
    ]
    touches = [(s, 5, "/a/b/c/f", False) for s in ("new", "under", "over", "beside")]
    touches += [("early", 0, "/a/b/c/f", False), ("flat", 5, "/a/b/y", False), ("other", 5, "/a/bc/y", False), ("gone", 5, "/a/b/x", True), ("root", 5, "/r", False)]
    p = spark.createDataFrame(points, "session string, ts long, path string, constrained boolean")
    t = spark.createDataFrame(touches, "session string, ts long, path string, deleted boolean")
    got = {tuple(r) for r in cross.decision_conflicts(p, t).filter("point_session in ('p', 'q')").collect()}
    want = {("p", s, "/a/b", "warning") for s in ("new", "beside", "flat", "gone")}
    want |= {("p", s, "/a/b", "info") for s in ("new", "beside", "flat", "gone", "under", "over")}
    want |= {("p", "gone", "/a/b/x", "alert"), ("q", "root", "/r", "warning")}
    assert got == want
    plain = cross.decision_conflicts(p.drop("constrained"), t.drop("deleted"))
    assert {r.severity for r in plain.collect()} == {"warning"}


def test_commits_of_sessions(spark):
    from datetime import datetime, timedelta

    r = random.Random(7)
    start = datetime(2026, 1, 1)
    at = lambda: start + timedelta(hours=r.randint(0, 24 * 40))
    sessions = []
    for i in range(200):
        a = at()
        sessions.append((i % 190, r.choice([1, 2, 3, None]), a, a + timedelta(hours=r.choice([-2, 0, 1, 30, 480]))))
    sessions.append((500, 1, None, start))
    commits = [(r.choice([1, 2, 3, 4, None]), r.choice([at(), at(), None]), r.choice([None, 1, 5])) for _ in range(300)]
    want = {}
    for s, p, a, b in sessions:
        for q, ts, n in commits:
            if p == q and None not in (p, a, ts) and a <= ts <= b + timedelta(minutes=30):
                have = want.setdefault(s, [0, None])
                have[0] += 1
                have[1] = have[1] if n is None else (have[1] or 0) + n
    left = spark.createDataFrame(sessions, "session long, project long, created timestamp, modified timestamp")
    found = cross.commit_session_join(left, spark.createDataFrame(commits, "project long, ts timestamp, lines long"))
    assert {x.session: [x.commits, x.lines] for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
