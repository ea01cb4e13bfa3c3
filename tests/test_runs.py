"""Walks over runs of rows that follow their parent, against plain loops on odd graphs."""

import random

import pytest

from logloom.operators import graphops, phases


@pytest.fixture(scope="module")
def graph(spark):
    """Sessions with lost, late and looping parents, shared and missing uuids, and what cascades in them."""
    r = random.Random(5)
    rows, owners, seeds, keep = [], [], [], []
    for s in range(120):
        n, mode = r.randint(1, 25), s % 4
        for i in range(n):
            u = None if r.random() < 0.05 else f"u{r.randint(0, i) if mode == 3 and r.random() < 0.2 else i}"
            x = r.random()
            p = None if x < 0.05 else "lost" if x < 0.1 else f"u{r.randint(0, n)}" if x < 0.1 + 0.1 * mode else f"u{i - 1}" if i else None
            rows.append((f"s{s}", u, p, i, r.choice(["user", "assistant"])))
            if u and r.random() < 0.1:
                owners.append((f"s{s}", u, f"u{r.randint(0, n - 1)}"))
            if r.random() < 0.08:
                seeds.append((f"s{s}", r.choice([f"u{i}", "lost"])))
            if r.random() < 0.05:
                keep.append((f"s{s}", f"u{i}"))
    make = spark.createDataFrame
    pairs = "session string, uuid string"
    tables = make(rows, f"{pairs}, parent_uuid string, idx long, type string"), make(owners, f"{pairs}, call_uuid string"), make(seeds, pairs), make(keep, pairs)
    links = {(s, u): (p, i) for s, u, p, i, _ in rows if u}
    return tables, links, owners, seeds, keep


@pytest.mark.parametrize("spared", [False, True])
def test_cascade(graph, spared):
    (rows, results, seeds, keep), links, owners, first, kept = graph
    kept = set(kept) if spared else set()
    gone, before = set(first) - kept, None
    while before != len(gone):
        before = len(gone)
        gone |= {k for k, (p, _) in links.items() if k not in kept and (k[0], p) in gone}
        gone |= {(s, u) for s, u, call in owners if (s, u) not in kept and (s, call) in gone}
    got = [tuple(x) for x in graphops.cascade(rows, results, seeds, keep if spared else None).collect()]
    assert len(got) == len(set(got)) and set(got) == gone


def test_targets(graph):
    (rows, _, _, gone), links, *_, removed = graph
    removed = {k for k in removed if k in links}
    want = {}
    for s, u in removed:
        at, seen = (s, u), set()
        while at in removed and at not in seen:
            seen.add(at)
            at = (s, links[at][0])
        want[s, u] = None if at in seen else at[1]
    got = graphops.targets(rows, gone).collect()
    assert len(got) == len(want) and {(x.session, x.parent_uuid): x.target for x in got} == want and all(x.was_gone for x in got)


def test_active_chain(graph):
    (rows, *_), links, *_ = graph
    want = set()
    for session in {s for s, _ in links}:
        at = max((k for k in links if k[0] == session), key=lambda k: links[k][1])
        step = 0
        while at in links and (*at, step) not in want and not any((*at, n) in want for n in range(step)):
            want.add((*at, step))
            at, step = (session, links[at][0]), step + 1
    got = [(x.session, x.uuid, x.step) for x in phases.active_chain(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_that_follow_ask_for_few_jobs(spark):
    """Pointers between rows would double twelve times here, each with jobs of its own."""
    chain = spark.createDataFrame([("s", f"u{i}", f"u{i - 1}" if i else None, i, "user") for i in range(3000)], "session string, uuid string, parent_uuid string, idx long, type string")
    some = chain.filter("idx between 3 and 2000").select("session", "uuid")
    none = spark.createDataFrame([], "session string, uuid string, call_uuid string")
    walks = {"cascade": lambda: graphops.cascade(chain, none, some), "targets": lambda: graphops.targets(chain, some), "chain": lambda: phases.active_chain(chain)}
    sizes = {"cascade": 2997, "targets": 1998, "chain": 3000}
    for name, walk in walks.items():
        spark.sparkContext.setJobGroup(name, name)
        assert walk().count() == sizes[name]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) < 40
