"""What is written for a later step is not broadcast, however small the planner thinks it."""

from pyspark.sql import functions as F

from logloom.operators import graphops
from logloom.sources.scratch import written


def test_written_tables_are_not_broadcast(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("session"), "id", F.repeat(F.lit("x"), 50).alias("raw"))
    for table in (written(rows, "rows"), graphops._cut(rows)):
        part = table.filter("id % 2 = 0").select("session", F.lit(True).alias("there"))
        for how in ("inner", "left", "left_semi", "left_anti"):
            plan = rows.join(part, "session", how)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
            assert rows.join(part, "session", how).count() == (2000 if how == "left" else 1000)
