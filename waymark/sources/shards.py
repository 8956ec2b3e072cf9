"""Vectors in shards: Parquet files in the order of their names, checked from their footers and a few rows before anything is read in full.

A shard's rows follow those of the shards before it: row is a number over all of them, and ids are consecutive across
files.  The inspection is a job with a task for some shards; it reads of each file its footer, its first and last ids, and one
batch of vectors.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPORT = "shard string, path string, n long, first_id string, last_id string, numbers long, odd long, low_norm double, high_norm double"
#: Rows whose vectors are looked at in each shard.
LOOK = 1024
#: How far a norm may be from the one that is asked for.
NEAR = 1e-3


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_shards(folder: str, pattern: str = "*.parquet") -> list[str]:
    """Files of a folder that match, in the order of their names; none is an error."""
    store, root = _store(folder)
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern))
    if not found:
        raise FileNotFoundError(f"no shards {pattern} in {folder}")
    start = folder[: len(folder) - len(root)] if folder.endswith(root) else folder.split("://")[0] + "://" if "://" in folder else ""
    return [start + f for f in found]


def _inspector(id_col: str, vec_col: str, dim: int):
    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                store, own = _store(path)
                with store.open_input_file(own) as f:
                    file = pq.ParquetFile(f)
                    meta = file.metadata
                    full = [g for g in range(meta.num_row_groups) if meta.row_group(g).num_rows]
                    ids = [None, None]
                    if full:
                        ids = [file.read_row_group(g, [id_col]).column(0)[at].as_py() for g, at in ((full[0], 0), (full[-1], -1))]
                    leaf = next(c for c in range(meta.num_columns) if meta.schema.column(c).path.split(".")[0] == vec_col)
                    numbers = sum(meta.row_group(g).column(leaf).num_values for g in full)
                    head = next(file.iter_batches(LOOK, full[:1], [vec_col])).column(0) if full else pa.array([], pa.list_(pa.float32()))
                    vectors = [np.asarray(v if v is not None else [], np.float64) for v in head.to_pylist()]
                    norms = [float(np.sqrt(v @ v)) for v in vectors if len(v) == dim]
                rows.append((path.rsplit("/", 1)[-1], path, meta.num_rows, *(None if i is None else str(i) for i in ids), numbers, sum(len(v) != dim for v in vectors), min(norms, default=None), max(norms, default=None)))
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in REPORT.split(", ")])

    return inspect


def inspect_shards(spark: SparkSession, folder: str, dim: int, pattern: str = "*.parquet", id_col: str = "id", vec_col: str = "embedding", first: int | None = 1, norm: float | None = None) -> DataFrame:
    """One row for each shard: its file, number of rows, first and last id, where its rows start among all, and what is wrong with it (null: nothing).

    Wrong are vectors without dim numbers (by the footer's count, and by the first rows), ids that do not follow the shard before (or, with
    first, do not begin there; None: anywhere), and norms away from norm where it is given."""
    paths = list_shards(folder, pattern)
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "at long, path string").repartition(min(len(paths), 256), "at")
    seen = files.select("path").mapInArrow(_inspector(id_col, vec_col, dim), REPORT)
    w = Window.orderBy("shard")  # a row for each file
    begin = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = lambda c: F.col(c).try_cast("long")
    # an empty shard has no ids and hands on those of the shard before
    expected = F.last(number("last_id"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1
    expected = F.coalesce(expected, F.lit(first).cast("long"))
    there = F.col("n") > 0
    gap = there & (number("first_id").isNull() | F.coalesce(number("first_id") != expected, F.lit(False)) | (number("last_id") - number("first_id") + 1 != F.col("n")))
    wrong: Column = F.when(there & ((F.col("numbers") != F.col("n") * dim) | (F.col("odd") > 0)), f"vectors without {dim} numbers")
    wrong = wrong.when(gap, F.concat(F.lit("ids "), F.coalesce("first_id", F.lit("?")), F.lit(" to "), F.coalesce("last_id", F.lit("?")), F.lit(" of "), F.col("n").cast("string"), F.lit(" rows do not follow from "), F.coalesce(expected.cast("string"), F.lit("anywhere"))))
    if norm is not None:
        wrong = wrong.when(there & (F.greatest(F.abs(F.col("low_norm") - norm), F.abs(F.col("high_norm") - norm)) > NEAR), "norms are off")
    return seen.withColumns({"start": begin, "wrong": wrong}).select("shard", "path", "n", "start", "first_id", "last_id", "low_norm", "high_norm", "wrong")


def read_shards(spark: SparkSession, folder: str, dim: int, pattern: str = "*.parquet", id_col: str = "id", vec_col: str = "embedding", first: int | None = 1, norm: float | None = None) -> DataFrame:
    """(row, id, embedding) of all shards, row counting over them in the order of names; a shard that is wrong is an error that names it.

    Rows are numbered by the reader's own row index in each file, so files are read in splits like any Parquet."""
    report = inspect_shards(spark, folder, dim, pattern, id_col, vec_col, first, norm).collect()  # a row for each file
    if bad := [f"{r['shard']}: {r['wrong']}" for r in report if r["wrong"]]:
        raise ValueError("; ".join(bad))
    starts = spark.createDataFrame([(r["shard"], r["start"]) for r in report], "_shard string, _start long")
    df = spark.read.parquet(*[r["path"] for r in report])
    named = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), F.col("_metadata.file_name").alias("_shard"), F.col("_metadata.row_index").alias("_at"))
    return named.join(F.broadcast(starts), "_shard").select((F.col("_start") + F.col("_at")).alias("row"), "id", "embedding")


def write_shards(df: DataFrame, folder: str, size: int, id_col: str = "id", vec_col: str = "embedding", prefix: str = "passages_") -> None:
    """(id, embedding) in shards of size consecutive numbers of the id, each one file in the order of ids, named prefix and a number.

    Each shard is one task's work, so size is what a task should hold."""
    number = F.col(id_col).cast("long")
    low = df.agg(F.min(number)).head()[0] or 0
    shard = F.floor((number - F.lit(low)) / size).cast("int")
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"), shard.alias("shard")).repartition("shard").sortWithinPartitions("shard", number).write.partitionBy("shard").parquet(f"{folder}/_made")
    path = jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in store.listStatus(path(f"{folder}/_made")):
        name = part.getPath().getName()
        if name.startswith("shard="):
            files = [f.getPath() for f in store.listStatus(part.getPath()) if f.getPath().getName().startswith("part-")]
            for i, f in enumerate(sorted(files, key=str)):
                store.rename(f, path(f"{folder}/{prefix}{int(name[6:]):05d}{f'-{i}' if i else ''}.parquet"))
    store.delete(path(f"{folder}/_made"), True)
