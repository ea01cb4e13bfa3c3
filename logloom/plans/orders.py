"""Queries of billing and project operators, with orders as sessions and customers' nations as projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budget, cross
from ..sources.bridge import table


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """session, project, created, modified, dollars from orders."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("session"), F.col("c_nationkey").cast("long").alias("project"), F.col("o_orderdate").cast("timestamp").alias("created"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 6 hours")).alias("modified"), F.col("o_totalprice").alias("dollars"),
    )


def _logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders of customers as sessions of twenty days, shipped lines as commits."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    sessions = orders.select(
        F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("project"), F.col("o_orderdate").cast("timestamp").alias("created"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 20 days")).alias("modified"), F.floor("o_totalprice").alias("tokens"), F.col("o_totalprice").alias("dollars"),
    )
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("project"))
    commits = lines.join(owners.hint("merge"), "l_orderkey").select("project", F.col("l_shipdate").cast("timestamp").alias("ts"), F.floor("l_quantity").alias("lines"))
    return sessions, commits


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_mktsegment").alias("model"), F.col("o_totalprice").alias("dollars"))


ORDER_QUERIES = {
    "commit_session_join": lambda s, d: cross.commit_session_join(*_logs(s, d)),
    "efficiency": lambda s, d: cross.efficiency(*_logs(s, d)),
    "productivity": lambda s, d: cross.productivity(*_logs(s, d)),
    "snapshot_summary": lambda s, d: cross.snapshot_summary(_snapshots(s, d)),
    "alias_edges": lambda s, d: cross.alias_edges(_sessions(s, d)),
    "savings_summary": lambda s, d: cross.savings_summary(table(s, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.floor("l_quantity").alias("tokens"), F.floor("l_extendedprice").alias("avoided")), 20),
    "billing_week": lambda s, d: budget.billing_week(_sessions(s, d).select("session", "modified"), "modified", anchor="1995-01-04"),
    "weekly_usage": lambda s, d: budget.weekly_usage(_sessions(s, d), anchor="1995-01-04", limit=5_000_000.0),
    "repo_budget": lambda s, d: budget.repo_budget(_sessions(s, d)),
    "latest_n_per_project": lambda s, d: budget.latest_n(_sessions(s, d), 5),
    "cost_alert": lambda s, d: budget.cost_alert(_sessions(s, d), 300_000.0),
    "cost_rollup": lambda s, d: budget.cost_rollup(_sessions(s, d)),
    "high_daily_sessions": lambda s, d: budget.high_daily(_sessions(s, d), 200_000.0),
}

_S = """s AS (SELECT o_orderkey AS session, CAST(c_nationkey AS BIGINT) AS project, CAST(o_orderdate AS TIMESTAMP) AS created, CAST(o_orderdate AS TIMESTAMP)+INTERVAL 6 HOUR AS modified, o_totalprice AS dollars
 FROM orders JOIN customer ON o_custkey=c_custkey),
w AS (SELECT *, CAST(floor(date_diff('day', DATE '1995-01-04', CAST(modified AS DATE))/7.0) AS BIGINT) AS week FROM s)"""
_L = """g AS (SELECT o_orderkey AS session, o_custkey AS project, CAST(o_orderdate AS TIMESTAMP) AS created, CAST(o_orderdate AS TIMESTAMP)+INTERVAL 20 DAY AS modified, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_totalprice AS dollars FROM orders),
m AS (SELECT o_custkey AS project, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(floor(l_quantity) AS BIGINT) AS lines FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
h AS (SELECT session, count(*) AS commits, CAST(sum(lines) AS BIGINT) AS lines FROM g JOIN m ON g.project=m.project AND ts>=created AND ts<=modified+INTERVAL 30 MINUTE GROUP BY session),
r AS (SELECT g.session, tokens, coalesce(commits,0) AS commits, coalesce(lines,0) AS lines, round(coalesce(lines,0)*1000.0/greatest(tokens,1)::DOUBLE,6) AS per_1k FROM g LEFT JOIN h USING (session))"""
_START = "CAST(DATE '1995-01-04' + CAST(week*7 AS INT) AS DATE)"

ORDER_SQL = {
    "commit_session_join": f"WITH {_L} SELECT * FROM h",
    "efficiency": f"""WITH {_L} SELECT * FROM (SELECT 'efficient' AS kind, session, commits, lines, per_1k FROM r WHERE commits>0 ORDER BY per_1k DESC, session LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'sink', session, commits, lines, per_1k FROM r WHERE commits=0 AND tokens>10000 ORDER BY tokens DESC, session LIMIT 5)""",
    "productivity": f"""WITH {_L} SELECT project, sessions, commits, round(d,4) AS dollars, round(CASE WHEN commits>0 THEN d/commits END,6) AS per_commit, hours FROM (SELECT project, count(*) AS sessions, CAST(sum(coalesce(commits,0)) AS BIGINT) AS commits,
 CAST(sum(CAST(dollars AS DECIMAL(20,4))) AS DOUBLE) AS d, 480.0::DOUBLE*count(*) AS hours FROM g LEFT JOIN h USING (session) GROUP BY project)""",
    "snapshot_summary": "SELECT model, snapshots, round(d,4) AS dollars, round(snapshots/CAST(sum(snapshots) OVER () AS DOUBLE),6) AS share FROM (SELECT c_mktsegment AS model, count(*) AS snapshots, CAST(sum(CAST(o_totalprice AS DECIMAL(20,4))) AS DOUBLE) AS d FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY ALL)",
    "alias_edges": f"WITH {_S} SELECT project, count(*) AS sessions, CAST(count(*)*(count(*)-1)//2 AS BIGINT) AS pairs, min(session) AS first_session FROM s WHERE project IS NOT NULL GROUP BY project HAVING count(*)>1",
    "savings_summary": "SELECT l_orderkey AS session, count(*) AS events, CAST(sum(floor(l_quantity)) AS BIGINT) AS tokens, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS avoided FROM lineitem GROUP BY l_orderkey ORDER BY avoided DESC, session LIMIT 20",
    "billing_week": f"WITH {_S} SELECT session, week, {_START} AS week_start FROM w",
    "weekly_usage": f"WITH {_S} SELECT {_START} AS week_start, count(*) AS sessions, round(sum(dollars),2) AS dollars, round(5000000.0-sum(dollars),2) AS remaining, round(max(dollars)/sum(dollars),6) AS largest_share FROM w GROUP BY week",
    "repo_budget": f"WITH {_S} SELECT *, rank() OVER (ORDER BY dollars DESC) AS rank FROM (SELECT project, count(*) AS sessions, round(sum(dollars),2) AS dollars, round(avg(dollars),2) AS per_session FROM s GROUP BY project)",
    "latest_n_per_project": f"WITH {_S} SELECT session, project, created FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY created DESC, session) AS r FROM s) WHERE r<=5",
    "cost_alert": f"WITH {_S} SELECT session, dollars FROM s WHERE dollars>=300000.0",
    "cost_rollup": f"WITH {_S} SELECT project, CAST(year(created) AS INT) AS year, count(*) AS sessions, round(sum(dollars),2) AS dollars FROM s GROUP BY ROLLUP(project, CAST(year(created) AS INT))",
    "high_daily_sessions": f"WITH {_S} SELECT CAST(created AS DATE) AS day, count(*) AS sessions, count(*) FILTER (WHERE dollars>200000.0) AS high FROM s GROUP BY 1",
}
