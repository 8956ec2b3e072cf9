"""Integer k-means whose every assignment is exact, with most centroids ruled out by a PCA-rotated bound.

A vector is stored once with its integer components, its leading coordinates in the basis of principal
components and the norm of the rest.  For a centroid so rotated, the squared distance of the leading coordinates
plus the squared difference of the norms of the rest never exceeds the squared distance; centroids whose bound is
above the best distance so far are left out, and the survivors' distances are computed in integers.

Only the centroids and sums of a fixed size (k x dim) meet on the driver; they do not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import keep

#: Integer components stay below this, so that squared distances fit into a long.
LARGEST = 1 << 26
#: Leading coordinates stored of each vector.
LEAD = 32
#: Rows of a batch that are compared at once.
ROWS = 4096
#: What rounding may add to a bound, relative to the squares that went into it.
SLACK = 1e-9


@dataclass
class Rotation:
    """An orthonormal basis's leading directions (dim x lead) around a mean."""

    mean: np.ndarray
    basis: np.ndarray

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates of each row, and the norm of the rest."""
        own = x - self.mean
        lead = own @ self.basis
        rest = own - lead @ self.basis.T
        return lead, np.sqrt(np.einsum("ij,ij->i", rest, rest))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, q): floor(scale * x) of vectors with dim components, none of them null, NaN or infinite, or so large that
    distances would not fit into a long."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(LARGEST))
    whole = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter(F.coalesce((F.size("v") == dim) & F.forall("v", fit), F.lit(False)))
    return whole.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit_rotation(points: DataFrame, dim: int, lead: int) -> Rotation:
    """The principal components of all points: a task emits its sums, which are added up by place."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            x = _matrix(batch, "q").astype(np.float64)
            if len(x):
                total += np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = points.select("q").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(1 + dim + dim * dim)
    total[got.column("at").to_numpy()] = got.column("v").to_numpy()
    n = max(1.0, total[0])
    mean = total[1 : dim + 1] / n
    values, basis = np.linalg.eigh(total[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean))
    return Rotation(mean, basis[:, np.argsort(-values, kind="stable")[:lead]])


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centers: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the lower number), its squared distance, and how many distances were computed.

    Centroids are looked at in the order of their bounds, as long as those do not exceed the best distance."""
    c_lead, c_rest = rotation(centers.astype(np.float64))
    squares = lambda a, b: np.einsum("ij,ij->i", a, a) + b * b
    own, theirs = squares(lead, rest), squares(c_lead, c_rest)
    bound = own[:, None] + theirs[None] - 2.0 * (lead @ c_lead.T) - 2.0 * np.outer(rest, c_rest) - SLACK * (1.0 + own[:, None] + theirs[None])
    best, cluster = np.full(len(q), np.iinfo(np.int64).max), np.zeros(len(q), np.int64)
    order, rows, seen = np.argsort(bound, axis=1, kind="stable"), np.arange(len(q)), 0
    for turn in range(len(centers)):
        at = order[rows, turn]
        near = bound[rows, at] <= best[rows]
        rows, at = rows[near], at[near]
        if not len(rows):
            break
        seen += len(rows)
        away = q[rows] - centers[at]
        d = np.einsum("ij,ij->i", away, away)
        better = (d < best[rows]) | (d == best[rows]) & (at < cluster[rows])
        best[rows[better]], cluster[rows[better]] = d[better], at[better]
    return cluster, best, seen


def _assigned(batches: Iterator[pa.RecordBatch], centers: np.ndarray, rotation: Rotation) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            q = _matrix(batch, "q").astype(np.int64)
            cluster, distance, _ = nearest(q, _matrix(batch, "lead"), batch.column("rest").to_numpy(), centers, rotation)
            yield batch, q, cluster, distance


def _moved(points: DataFrame, centers: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Each centroid's exact floor(sum / count); one without vectors stays."""
    k, dim = centers.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for _, q, cluster, _ in _assigned(batches, centers, rotation):
            np.add.at(total, cluster, np.c_[q, np.ones(len(q), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

    got = points.mapInArrow(sums, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(k * (dim + 1), np.int64)
    total[got.column("at").to_numpy()] = got.column("v").to_numpy()
    total = total.reshape(k, dim + 1)
    out = centers.copy()
    full = total[:, dim] > 0
    out[full] = total[full, :dim] // total[full, dim:]
    return out


def center_digests(centers: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components, as decimal integers joined by commas."""
    return [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]


def kmeans(df: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 256, lead: int = LEAD) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster int, distance long) of every whole vector, and the final centroids (integers).

    The first centroids are the k vectors with the least SHA-256 of '2:<id>' (repeated ids: by components), so there are
    fewer where there are fewer vectors.  Rows without an id are assigned, but are no first centroids.  Vectors of another
    length, with null, NaN or infinite components, or with some |scale * x| of 2**26 or more, are left out; repeated rows are
    assigned each.  An empty table gives an empty one; other columns of df are not looked at."""
    points = integer_vectors(df, id_col, vec_col, dim, scale)
    first = points.filter("id is not null").orderBy(F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256), "q").limit(k).select("q").collect()
    kind = df.schema[id_col].dataType.simpleString()
    if not first:
        return df.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col), np.zeros((0, dim), np.int64)
    centers, rotation = np.array([r["q"] for r in first], np.int64), fit_rotation(points, dim, lead)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "q")
            own, rest = rotation(x.astype(np.float64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1] if len(own) else 1, dtype=np.int32)), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), lists, pa.array(rest)], names=["id", "q", "lead", "rest"])

    stored = keep(points.mapInArrow(rotate, f"id {kind}, q array<int>, lead array<double>, rest double"), "rotated")
    for _ in range(rounds):
        centers = _moved(stored, centers, rotation)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in _assigned(batches, centers, rotation):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return keep(stored.mapInArrow(final, f"id {kind}, cluster int, distance long"), "clusters").withColumnRenamed("id", id_col), centers


def cluster_report(found: DataFrame, centers: np.ndarray) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256; a row for each centroid is broadcast."""
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows: Sequence[tuple] = [(i, sums.get(i, 0), sum(sums.values()), x) for i, x in enumerate(center_digests(centers))]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(*[c for c in found.columns if c not in ("cluster", "distance")], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
