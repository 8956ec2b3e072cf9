"""Readers: passages, questions, JSON lines, embeddings, audit sheets."""

from __future__ import annotations

import struct
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.operators.guards import require_all
from waymark.sources.tables import running

PASSAGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("title", T.StringType())])


def passages(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, title, text) of a tab-separated file with doubled quotes; the header must be id, text, title.

    A gzip file is one task's work: write it as Parquet once.  ids: only these."""
    head = spark.read.text(path).limit(1).head()
    if head is None or head[0].split("\t") != PASSAGES.names:
        raise ValueError(f"{path}: the header isn't id, text, title")
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, schema=PASSAGES).select("id", "title", "text")
    return df if ids is None else df.join(ids.select("id").distinct(), "id", "left_semi")


#: Ids that are handed to the scan as ranges, and how many ranges those make.
SCAN_IDS, SCAN_RANGES = 50_000, 64


def id_ranges(ids: list, most: int = SCAN_RANGES) -> list[tuple]:
    """Sorted distinct ids as at most so many ranges that hold them all: for numbers the widest gaps part them, else equal counts."""
    own = sorted(set(ids))
    if len(own) <= most:
        return [(x, x) for x in own]
    if isinstance(own[0], str):
        step = -(-len(own) // most)
        return [(part[0], part[-1]) for part in (own[i : i + step] for i in range(0, len(own), step))]
    cuts = sorted(sorted(range(1, len(own)), key=lambda i: own[i - 1] - own[i])[: most - 1])
    return [(own[a], own[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True)]


def load_passages(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The passages of ids; a missing one is an error.

    Up to SCAN_IDS ids go to the scan as ranges, so that it, and the look for missing ones, read only the row groups that may hold
    them: writers.passages_cache puts passages in the order of their ids.  More ids meet the passages in a join alone."""
    wanted = ids.select("id").distinct()
    own = [r[0] for r in wanted.filter("id is not null").limit(SCAN_IDS + 1).collect()]
    found = df
    if len(own) <= SCAN_IDS:
        kind = df.schema["id"].dataType
        found, wanted = df.filter(reduce(or_, [F.col("id").between(F.lit(a).cast(kind), F.lit(b).cast(kind)) for a, b in id_ranges(own)], F.lit(False))), F.broadcast(wanted)
    require_all(ids, found, ["id"], "passages")
    return found.join(wanted, "id", "left_semi")


def questions(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """question, answer (an array) and what else there is, from .jsonl or a .json array; the first n in the order of the file."""
    if not path.endswith((".jsonl", ".json")):
        raise ValueError(f"{path}: neither .jsonl nor .json")
    df = spark.read.json(path, multiLine=path.endswith(".json"))
    if not isinstance(df.schema["answer"].dataType, T.ArrayType):
        df = df.withColumn("answer", F.array("answer"))
    kept = [c for c in ("_id", "question", "answer", "type", "level") if c in df.columns]
    df = df.select(*kept)
    if n is None:
        return df
    return df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(n).drop("_at")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False) -> DataFrame:
    """JSON lines, blank ones left out; with missing_ok no file is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def check_consecutive(index: DataFrame, id_col: str = "id") -> DataFrame:
    """(id): ids of an index whose predecessor is missing, but for the first."""
    ids = index.select(F.col(id_col).cast("long").alias("id")).distinct()
    before = ids.join(ids.select((F.col("id") + 1).alias("id")), "id", "left_anti")
    # an id without the one before it starts a run: all but the first are gaps
    first = ids.agg(F.min("id").alias("first"))
    return before.crossJoin(F.broadcast(first)).filter("id > first").select("id")


def embeddings(spark: SparkSession, path: str, dim: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """A Parquet index whose vectors all have dim numbers and whose ids are unique."""
    df = spark.read.parquet(path)
    bad = df.filter(F.size(vec_col) != dim).head(1)
    if bad:
        raise ValueError(f"{path}: a vector without {dim} numbers: {bad[0][id_col]}")
    if df.groupBy(id_col).count().filter("count > 1").head(1):
        raise ValueError(f"{path}: an id comes more than once")
    return df


#: Bytes of a flat index's header, and of vectors that a task reads at a time.
HEADER, RANGE = 45, 64 << 20


class _Vectors(DataSource):
    """Raw little-endian float32 vectors of files, in ranges of bytes: a file of any size is many tasks' work.

    Options: path, dim, header (bytes), checked (whether the header is a flat inner-product index's)."""

    @classmethod
    def name(cls) -> str:
        return "flat_vectors"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _VectorsReader(self.options)


class _Range(InputPartition):
    def __init__(self, first: int, n: int):
        super().__init__((first, n))


class _VectorsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dim = options["path"], int(options["dim"])
        self.header, self.checked = int(options.get("header", 0)), options.get("checked", "false") == "true"

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return store.open_input_file(path)

    def partitions(self):
        with self._open() as f:
            size = f.size()
            n, left = divmod(size - self.header, 4 * self.dim)
            if size < self.header or left:
                raise ValueError(f"{self.path}: {size} bytes hold no whole vectors of {self.dim} after {self.header}")
            if self.checked:
                check_header(f.read_at(HEADER, 0), self.dim, n)
        step = max(1, RANGE // (4 * self.dim))
        return [_Range(at, min(step, n - at)) for at in range(0, n, step)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        first, n = partition.value
        with self._open() as f:
            data = np.frombuffer(f.read_at(4 * self.dim * n, self.header + 4 * self.dim * first), "<f4")
        step = 8192
        for at in range(0, n, step):
            own = data[at * self.dim : (at + step) * self.dim]
            k = len(own) // self.dim
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + k)), pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * self.dim, pa.int32()), pa.array(own))], names=["row", "embedding"])


def check_header(head: bytes, dim: int, n: int) -> None:
    """A flat index of inner products over dim float32 numbers and n vectors; anything else is an error."""
    if len(head) < HEADER:
        raise ValueError("the index has no header")
    magic, d, total, _, _, trained, metric, codes = struct.unpack("<4siqqq?iq", head)
    if magic != b"IxFI":
        raise ValueError(f"no flat inner-product index (magic {magic!r})")
    if d != dim or metric != 0 or not trained or codes != total * d or total != n:
        raise ValueError(f"unexpected header: {d} numbers, metric {metric}, trained {trained}, {total} vectors, {codes} codes; {n} vectors in the file")


def flat_index(spark: SparkSession, path: str, dim: int, ids: str | None = None, header: int = HEADER, checked: bool = True) -> DataFrame:
    """(row, embedding) of a flat index file, read in ranges of bytes; checked: its header is that of a flat inner-product index.  ids: a text file of
    one id a line, in the order of the rows, which become a column id; another number of them is an error.

    path is local, or in a store that pyarrow reads (s3://, gs://, hdfs://)."""
    spark.dataSource.register(_Vectors)
    df = spark.read.format("flat_vectors").options(path=path, dim=str(dim), header=str(header), checked=str(checked).lower()).load()
    if ids is None:
        return df
    lines = running(spark.read.text(ids).select(F.col("value").alias("id"), F.monotonically_increasing_id().alias("at"), F.lit(1).alias("one")), "at", "one", "row").select("row", "id")
    if lines.count() != df.count():
        raise ValueError(f"{ids}: not as many ids as vectors")
    return df.join(lines, "row")


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of a .npy file of float32 numbers in two dimensions or more, in ranges of bytes; embedding holds a row's numbers, flat."""
    import numpy as np

    if "://" in path:
        from pyarrow import fs

        store, own = fs.FileSystem.from_uri(path)
        stream = store.open_input_file(own)
    else:
        stream = open(path, "rb")
    with stream as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        start = f.tell()
    if fortran or kind != np.dtype("<f4") or len(shape) < 2:
        raise ValueError(f"{path}: rows of float32 numbers are needed, got {kind} {shape}")
    return flat_index(spark, path, int(np.prod(shape[1:])), header=start, checked=False)


def audit_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet; a byte-order mark before the first name is left out."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


#: What a dataset's index is read by.
LOADERS: dict = {}


def register_index(name: str, loader) -> None:
    LOADERS[name] = loader


def load_index(spark: SparkSession, name: str) -> DataFrame:
    if name not in LOADERS:
        raise KeyError(f"no index {name}; there are {sorted(LOADERS)}")
    return LOADERS[name](spark)
