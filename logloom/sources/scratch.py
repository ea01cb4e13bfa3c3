"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and not again when an executor is lost.

    Joins with it are merged: a few columns of a wide file look small to the planner, and broadcasting them would
    collect every row of the log in the driver.
    """
    path = f"{shared_folder(df.sparkSession)}/logloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to as many tasks as the session's shuffles have.

    An adaptive plan goes by bytes and merges them to one or two more than there are cores, so the last run alone; rows of
    a log are few bytes here and much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def split_methods(spark: SparkSession) -> Iterator[None]:
    """Projections of over 8000 bytes of code run in parts here: the JVM compiles no larger method, and interprets it for every row."""
    key = "spark.sql.codegen.hugeMethodLimit"
    held = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, held)
