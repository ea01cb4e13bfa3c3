"""Noise of short islands, drift islands as rows of the catalog, and what lists know of a session."""

from logloom.operators import clean, noise, scoring, sequence
from logloom.plans import catalog, rewrites
from logloom.sources import bridge

COLUMNS = "session string, idx long, ts timestamp, type string, uuid long, parent_uuid long, cwd string, ctx long, raw_size long, tool string, path string, is_error boolean, result_for long"


def log(spark, rows):
    """Rows of (session, type, ctx, raw_size, tool, path), numbered by session."""
    out, at = [], {}
    for session, kind, ctx, size, tool, path in rows:
        i = at[session] = at.get(session, -1) + 1
        out.append((session, i, None, kind, i, i - 1 if i else None, "/w/r0", ctx, size, tool, path, False, None))
    return spark.createDataFrame(out, COLUMNS)


def test_stats_of_a_list(spark):
    e = log(spark, [("a", "progress", None, 50, None, None), ("a", "assistant", 90_000, 50, "Read", "/w/r0/f"), ("a", "assistant", 9, 50, "Read", "/w/r0/f"), ("b", "user", None, 10, None, None)])
    stats = {r.session: r for r in rewrites._stats(e).collect()}
    assert (stats["a"].starts_queued, stats["a"].bytes, stats["a"].current_ctx, stats["a"].assistant_rows, stats["a"].compactions) == (True, 150, 9, 2, 1)
    assert (stats["b"].current_ctx, stats["b"].compactions) == (0, 0)
    assert [r.session for r in scoring.zombie(rewrites._stats(e), 100, 0).collect()] == ["a"]


def test_short_islands_are_noise(spark):
    e = log(spark, [("a", "assistant", 9, 40, "Read", "/w/r1/f"), ("a", "assistant", 9, 40, "Edit", "/w/r0/f"), ("a", "user", None, 40, None, None)])
    assert sequence.find_tangents(e).count() == 0
    tags = {(r.idx, r.category) for r in noise.noise_tags(e, bridge.blocks(e)).collect()}
    assert tags == {(0, "tangents")}
    assert [(r.idx, r.uuid, r.parent_uuid) for r in clean.clean_all(e, bridge.blocks(e)).orderBy("idx").collect()] == [(0, 1, None), (1, 2, 1)]
    assert [(r.phase, r.rows, r.bytes) for r in clean.clean_audit(e, bridge.blocks(e)).collect()] == [("tangents", 1, 40)]


def test_drift_tangents_has_the_columns_of_its_sql(spark):
    df = catalog.QUERIES["drift_tangents"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["session", "first_idx", "last_idx", "entries", "tokens"]
