"""Tables that several jobs read, written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is named and all of Spark is one process."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-waymark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: later jobs read it, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: str, weight: str, name: str) -> DataFrame:
    """df with a column name: the sum of weight over the rows before each in the order of a column.  A window adds up within each
    partition of a range exchange, and one row a partition tells where it starts, so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "running")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_all"))
    sums = sums.select("_part", F.coalesce(F.sum("_all").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    own: Column = F.coalesce(F.sum(weight).over(before(Window.partitionBy("_part").orderBy(order))), F.lit(0))
    return placed.withColumn("_own", own).join(F.broadcast(sums), "_part").select(*df.columns, (F.col("_base") + F.col("_own")).alias(name))
