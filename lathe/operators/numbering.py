"""Global row numbers in order, without one task that holds all rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where none is set, a session in one process (master ``local``) takes a folder
    under /tmp; on a cluster this raises, since executors would not share it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top}/lathe-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again; ends lineage."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """``name`` counts rows from 0 in the given order.

    Rows are dealt by range and sorted within tasks; the offset of a task is the
    number of rows before it. Only task counts meet in one place.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    placed = cut(sorted_rows.withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(low))))
    counts = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_base") + F.col("_place")).drop("_task", "_place", "_base")


def running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``name`` is the sum of ``value`` over all rows before, in the given order; as ``number``, only sums by task meet in one place."""
    placed = cut(df.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    before = lambda window: F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("_task").agg(F.sum(value).alias(value)).select("_task", before(Window.orderBy("_task")).alias("_base"))
    own = placed.withColumn("_own", before(Window.partitionBy("_task").orderBy(*order)))
    return own.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_base") + F.col("_own")).drop("_task", "_own", "_base")
