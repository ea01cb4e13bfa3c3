"""Window forms against plain loops on random sequences."""

import random

from logloom.operators import noise, sequence

COLUMNS = "session string, idx long, type string, uuid long, parent_uuid long, cwd string, ctx long, raw_size long, tool string, path string, is_error boolean, result_for long"


def logs(seed, sessions=40):
    r = random.Random(seed)
    rows = []
    for s in range(sessions):
        for i in range(r.randint(0, 40)):
            kind = r.choice(["assistant", "user", "progress"])
            path = r.choice(["/w/r0/a", "/w/r1/b", "/w/r0", "/w/r00/c", None]) if kind == "assistant" else None
            tool = r.choice(["Read", "Edit"]) if path else None
            ctx = r.choice([None, 0, 5000, 90000, 160000]) if kind == "assistant" else None
            rows.append((str(s), i, kind, i, r.choice([None, i - 1, 999]), "/w/r0", ctx, 4 * r.randint(1, 200), tool, path, r.random() < 0.3, r.choice([None, r.randint(0, 40)]) if kind == "user" else None))
    return rows


def by_session(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return out


def epochs_loop(rows):
    out, last, epoch = {}, None, 0
    for x in rows:
        if x[2] == "assistant" and x[6] is not None:
            if last and last > 0 and last - x[6] > 50000:
                epoch += 1
            last = x[6]
        out[x[1]] = epoch
    return out


def tangents_loop(rows, mixed):
    """Islands by walking the rows."""
    out, island, before = [], None, False
    for x in rows:
        conv, path = x[2] in ("user", "assistant"), x[9]
        home = path is not None and (path == "/w/r0" or path.startswith("/w/r0/"))
        ext = path is not None and not home
        breaks = (x[8] == "Edit" and home) or (home and not ext) or (conv and not ext and not home and not before)
        if breaks:
            island = None
        elif island is not None:
            island.append(x)
        elif ext:
            island = [x]
            out.append(island)
        if conv:
            before = ext
    return sorted((i[0][1], i[-1][1], len(i), sum(x[7] // 4 for x in i)) for i in out if len(i) >= 2 and sum(x[7] // 4 for x in i) >= 100)


def test_epochs_and_tangents(spark):
    rows = logs(1)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.session, r.idx): r.epoch for r in sequence.assign_epochs(df).collect()}
    tangents = {}
    for r in sequence.find_tangents(df).collect():
        tangents.setdefault(r.session, []).append((r.first_idx, r.last_idx, r.entries, r.tokens))
    for s, mine in by_session(rows).items():
        for i, e in epochs_loop(mine).items():
            assert got[s, i] == e
        assert sorted(tangents.get(s, [])) == tangents_loop(mine, False)


def test_stale_reads(spark):
    rows = logs(2)
    from logloom.sources import bridge

    got = {(r.session, r.idx) for r in noise.stale_reads(bridge.blocks(spark.createDataFrame(rows, COLUMNS))).collect()}
    want = set()
    for s, mine in by_session(rows).items():
        for k, x in enumerate(mine):
            if x[8] == "Read":
                for y in mine[k + 1 :]:
                    if y[9] == x[9] and y[8]:
                        if y[8] == "Read":
                            want.add((s, x[1]))
                        break
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert sequence.detect_compactions(df).count() == 0 and sequence.growth(df).count() == 0
