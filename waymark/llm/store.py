"""Tables in the folder that driver and executors share.

A stage that several later jobs read is written once, so that a lost executor
costs a re-read and not a recomputation, and so that every reader sees the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where none is named and all of
    Spark is one process, as executors elsewhere wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-waymark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not use, compared as Spark compares names."""
    taken, name = {c.lower() for c in df.columns}, wish
    while name.lower() in taken:
        name += "_"
    return name


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called c0, c1, ..., so that no name of theirs clashes, and what each is called now."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
