"""Whole lines are dealt to more tasks where there are more of them."""

from logloom.operators import phases
from logloom.sources import eventlog

SMALL = "/root/testdata/sf0.001"


def test_coalesce_has_tasks_by_rows(spark, monkeypatch):
    rows = eventlog.entries(spark, SMALL)
    few = phases.coalesce(rows)
    monkeypatch.setattr(phases, "TASK_ROWS", 25)
    many = phases.coalesce(rows)
    plan = many._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "raw#" not in x and "REPARTITION_BY_NUM" in x]
    assert len(wide) >= 3 and all(f", {-(-rows.count() // 25)})" in x.split(", REPARTITION")[0] + ")" for x in wide)
    columns = ["session", "idx", "uuid", "parent_uuid", "content", "merged", "stripped"]
    assert sorted(map(repr, few.select(columns).collect())) == sorted(map(repr, many.select(columns).collect()))
