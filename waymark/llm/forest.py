"""Near-duplicate vectors of one label through a forest of random-projection trees.

Equal vectors are one node with a weight.  Each tree splits its node at random directions, at a sparse place near
the middle, and vectors near a cut go to both sides.  Vectors are compared within leaves by their exact cosine; a
pair that shares several leaves is counted in the first, so links are counted and never written out.

Large tight groups: around a centre, vectors within half the linking angle link for certain, whatever their number.
Such balls are found on a sample, every vector is tested for membership, and members of one ball are counted, not
compared; leaves are compared in blocks of bounded size, and blocks of one ball skip each other.

The trees and centres are fitted on a bounded sample (``SAMPLE``, ``BALL_SAMPLE`` distinct vectors); all vectors pass through them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.graph import components
from waymark.llm.store import keep

#: Distinct vectors that trees are fitted on at most, and those that balls are looked for in.
SAMPLE = 60_000
BALL_SAMPLE = 8_192
#: Vectors that a leaf is meant to hold, and that a block of an overfull leaf holds.
LEAF = 512
BLOCK = 1024
#: Trees of a flat forest (one more for each level), and the copies of a vector that a tree makes by spilling.
TREES = 4
SPILL = 1.6
#: Directions of a tree to choose from, and sampled vectors that a node needs to be split, or a ball to be one.
POOL = 32
LEAST_NODE = 16
LEAST_BALL = 12
#: Vector lengths that have trees, the most frequent; vectors of others are compared in blocks of all of them.
DIMS = 4
BROADCAST_ROWS = 200_000


@dataclass
class Tree:
    """Nodes in the order of a heap: the direction of each (-1: no cut), its cut and the margin that spills."""

    pool: np.ndarray
    direction: np.ndarray
    cut: np.ndarray
    margin: np.ndarray

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of all nodes that the rows reach at their depths."""
        seen = x @ self.pool
        row, node, left = np.arange(len(x)), np.ones(len(x), np.int64), depth.astype(np.int64)
        done = []
        while len(row):
            end = left[row] == 0
            done.append((row[end], node[end]))
            row, node = row[~end], node[~end]
            left = left - 1
            d = self.direction[node]
            away = np.where(d < 0, -np.inf, seen[row, d] - self.cut[node])
            low, high = away <= self.margin[node], away >= -self.margin[node]
            row, node = np.r_[row[low], row[high]], np.r_[2 * node[low], 2 * node[high] + 1]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (row, node)


def grow(sample: np.ndarray, depth: int, angle: float, seed: int, spill: float = SPILL) -> Tree:
    """A tree over unit vectors.  A cut stands between the 30th and 70th percentile of a random direction, where the fewest sampled
    vectors are near; its margin spills the same share at each level, spill - 1 in all, and never more than keeps every link whole."""
    rng = np.random.default_rng(seed)
    pool = rng.standard_normal((sample.shape[1], POOL))
    pool /= np.linalg.norm(pool, axis=0)
    tree = Tree(pool, np.full(1 << depth, -1, np.int16), np.zeros(1 << depth), np.zeros(1 << depth))
    seen, share, widest = sample @ pool, spill ** (1.0 / max(1, depth)) - 1.0, np.sin(angle / 2.0)
    at = {1: np.arange(len(sample))}
    for _ in range(depth):
        below = {}
        for node, rows in at.items():
            if len(rows) < LEAST_NODE:
                continue
            tries = rng.choice(POOL, 8, replace=False)
            best = None
            for d in tries:
                p = np.sort(seen[rows, d])
                q = p[(np.linspace(0.3, 0.7, 5) * len(p)).astype(int)]
                near = np.searchsorted(p, q + widest / 3) - np.searchsorted(p, q - widest / 3)
                i = int(near.argmin())
                if best is None or near[i] < best[0]:
                    best = near[i], d, q[i]
            _, d, cut = best
            away = seen[rows, d] - cut
            margin = min(widest, float(np.sort(np.abs(away))[min(len(rows) - 1, ceil(share * len(rows)))]))
            tree.direction[node], tree.cut[node], tree.margin[node] = d, cut, margin
            below[2 * node], below[2 * node + 1] = rows[away <= 0], rows[away > 0]
        at = below
    return tree


def find_balls(sample: np.ndarray, half: float) -> np.ndarray:
    """Centres around which many sampled unit vectors lie within cosine half, each the mean of a vector's neighbours."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    near = np.concatenate([((sample[lo : lo + 1024] @ sample.T) >= half).sum(1) for lo in range(0, len(sample), 1024)])
    free, out = near >= LEAST_BALL, []
    for i in np.argsort(-near, kind="stable"):
        if not free[i]:
            continue
        own = sample @ sample[i] >= half
        centre = sample[own].mean(0)
        centre /= np.linalg.norm(centre)
        inside = sample @ centre >= half
        free &= ~own
        if (inside & (near >= LEAST_BALL)).sum() >= LEAST_BALL:
            out.append(centre)
            free &= ~inside
    return np.array(out).reshape(-1, sample.shape[1])


def unit(batch: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    """A column of non-zero vectors of one length, scaled to length one."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, v) with a 128-bit key of label and vector."""
    for batch in batches:
        column = batch.column("v")
        numbers, ends = column.flatten().to_numpy(zero_copy_only=False) + 0.0, np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
        data = numbers.tobytes()
        size, labels = numbers.itemsize, batch.column("label").to_pylist()
        keys = [blake2b(f"{label}\0".encode() + data[lo * size : hi * size], digest_size=16).digest() for label, lo, hi in zip(labels, ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])


def usable(v: Column) -> Column:
    """Vectors that may link: not null, with no null, NaN or infinite component, and not zero."""
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fit & F.exists(v, lambda x: x != 0), F.lit(False))


def _placer(forests: dict[int, list[Tree]], balls: dict[tuple[str, int], tuple[int, np.ndarray]], half: float):
    """For distinct vectors (key, label, dim, depth, n, low, v): the leaves that each reaches, and its ball (-1: none)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = whole.filter(pa.array(dims == dim))
                for lo in range(0, own.num_rows, 4096):
                    yield _place(own.slice(lo, 4096), int(dim))

    def _place(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        x, depth = unit(batch), batch.column("depth").to_numpy()
        rows, codes = [], []
        for i, tree in enumerate(forests.get(dim) or []):
            row, node = tree.leaves(x, depth)
            flat = depth[row] == 0
            row, node = (row[~flat], node[~flat]) if i else (row, node)  # a label of one leaf needs one tree
            rows.append(row)
            codes.append((np.int64(i) << 40) | node)
        row, code = (np.concatenate(rows), np.concatenate(codes)) if rows else (np.arange(len(x)), np.ones(len(x), np.int64))
        order = np.lexsort((code, row))
        counts = np.bincount(row, minlength=len(x))
        leaves = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(code[order]))
        ball, labels = np.full(len(x), -1, np.int32), np.array(batch.column("label").to_pylist(), object)
        for label in set(labels):
            first, centres = balls.get((label, dim), (0, None))
            if centres is not None:
                own = np.flatnonzero(labels == label)
                cosine = x[own] @ centres.T
                found = cosine.argmax(1)
                inside = cosine[np.arange(len(own)), found] >= half
                ball[own[inside]] = first + found[inside]
        return pa.RecordBatch.from_arrays([*batch.columns, leaves, pa.array(ball)], names=[*batch.schema.names, "leaves", "ball"])

    return place


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _comparer(least: float):
    def compare(table: pa.Table) -> pa.Table:
        """Links between the two blocks of a group (or within one): how many each vector has that no earlier leaf has counted, and
        the least of the vectors it reaches here."""
        x, n, ball = unit(table), table.column("n").to_numpy(), table.column("ball").to_numpy()
        code, block = table.column("code")[0].as_py(), table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        lists = table.column("leaves").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        earlier = np.full((len(x), max(1, int(sizes.max()))), -1, np.int64)
        earlier[np.repeat(np.arange(len(x)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        earlier[earlier >= code] = -1
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        pairs = []
        for at in range(0, len(left), 512):
            own = left[at : at + 512]
            near = x[own] @ x[right].T >= least
            near &= (ball[own][:, None] != ball[right][None]) | (ball[own][:, None] < 0)
            if lo == hi:
                near &= own[:, None] < right[None]
            i, j = np.nonzero(near)
            pairs.append((own[i], right[j]))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        fresh = np.ones(len(a), bool)
        for to in range(0, len(a), 1 << 16):
            ea, eb = earlier[a[to : to + (1 << 16)]], earlier[b[to : to + (1 << 16)]]
            for k in range(ea.shape[1]):
                fresh[to : to + (1 << 16)] &= ~((ea[:, k : k + 1] == eb) & (ea[:, k : k + 1] >= 0)).any(1)
        a, b = a[fresh], b[fresh]
        add = np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))
        some, root = np.flatnonzero(add > 0), _roots(a, b, len(x))
        keys = table.column("key").combine_chunks()
        return pa.table({"key": keys.take(pa.array(some)), "add": pa.array(add[some].astype(np.int64)), "to": keys.take(pa.array(root[some]))})

    return compare


def _blocks(placed: DataFrame) -> DataFrame:
    """(label, dim, code, ball, base, nb, total, pure): how the overfull leaves are cut into blocks.  A ball with enough members has
    blocks of its own (pure), all else shares the first ones."""
    cell = ["label", "dim", "code"]
    counts = placed.select("label", "dim", "ball", F.explode("leaves").alias("code")).groupBy(*cell, "ball").agg(F.count("*").alias("c"))
    pure = (F.col("ball") >= 0) & (F.col("c") >= BLOCK // 2)
    up = lambda c: F.ceil(c / BLOCK).cast("int")
    w = Window.partitionBy(*cell)
    t = counts.withColumn("pure", pure).withColumn("mixed", up(F.coalesce(F.sum(F.when(~F.col("pure"), F.col("c"))).over(w), F.lit(0))))
    t = t.withColumn("own", F.when(F.col("pure"), up(F.col("c"))).otherwise(0)).withColumn("total", F.col("mixed") + F.sum("own").over(w))
    before = F.coalesce(F.sum("own").over(w.orderBy("ball").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("base", F.when(F.col("pure"), F.col("mixed") + before).otherwise(0).cast("int")).withColumn("nb", F.when(F.col("pure"), F.col("own")).otherwise(F.col("mixed")))
    return t.filter("total > 1 or pure").select(*cell, "ball", "base", "nb", F.col("total").cast("int").alias("total"), "pure")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def link_vectors(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links long, component_id, kept boolean) of every row.

    Two rows link if their labels are equal and not null and their vectors, of one length, have a cosine of least or more.
    Vectors that are null, empty or zero or hold a null, NaN or infinite component link with nothing.  n_links counts other
    rows, repeated ones too; component_id is the least id reachable (rows without an id count as links, not as ids: a
    component of such rows alone has none), and kept tells the rows of that id.  An empty table gives an empty one;
    other columns of df are not looked at."""
    angle = float(np.arccos(least))
    half = float(np.cos(angle / 2.0)) + 1e-9
    kind = df.schema[id_col].dataType.simpleString()
    source = df.schema[vec_col].dataType.simpleString()
    number = source if source == "array<float>" else "array<double>"
    v = F.col(f"`{vec_col}`").cast(number)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v"))
    may = usable(F.col("v")) & F.col("label").isNotNull()
    keyed = rows.filter(may).mapInArrow(_keyed, f"id {kind}, label string, v {number}, key binary")
    slim = keep(keyed.select("id", "key"), "vector-keys")
    distinct = keep(keyed.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("low")).withColumn("dim", F.size("v")), "vectors")
    sizes = keep(distinct.groupBy("label", "dim").agg(F.count("*").alias("c")), "label-sizes")
    total = sizes.agg(F.sum("c"), F.max("c")).head()
    dims = [r["dim"] for r in sizes.groupBy("dim").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "dim").limit(DIMS).collect()]

    # a key is a hash, so keys below a bound are a random sample, the same in every run
    share = min(1.0, SAMPLE / max(1, total[0] or 0))
    low = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") < int(share * 2.0**32)
    sample = distinct.filter(low & F.col("dim").isin(dims or [0])).select("label", "dim", "v").limit(2 * SAMPLE).toArrow()
    forests, balls, depth, n_balls = {}, {}, 0, 0
    sample_dim, sample_label = sample.column("dim").to_numpy(), np.array(sample.column("label").to_pylist(), object)
    for dim in dims:
        own = np.flatnonzero(sample_dim == dim)
        if not len(own):
            continue
        x = unit(sample.take(pa.array(own)))
        depth = max(0, min(ceil(log2(max(1, (total[1] or 0)) / LEAF)), int(log2(max(1, len(x) / LEAST_NODE)))))
        forests[dim] = [grow(x, depth, angle, seed) for seed in range(TREES + depth)]
        few = np.arange(len(x)) < BALL_SAMPLE
        for label in sorted(set(sample_label[own][few])):
            centres = find_balls(x[few & (sample_label[own] == label)], half)
            if len(centres):
                balls[label, dim] = n_balls, centres
                n_balls += len(centres)
    deepest = {dim: int(log2(len(trees[0].cut))) for dim, trees in forests.items()}
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in deepest.items() for x in kv])[F.col("dim")], F.lit(0)) if deepest else F.lit(0)
    levels = F.greatest(F.lit(0), F.least(most, F.ceil(F.log2(F.col("c") / LEAF)).cast("int")))
    deep = distinct.join(_few(sizes.select("label", "dim", levels.alias("depth"))), ["label", "dim"])
    placed = keep(deep.select("key", "label", "dim", "depth", "n", "low", "v").mapInArrow(_placer(forests, balls, half), f"key binary, label string, dim int, depth int, n long, low {kind}, v {number}, leaves array<long>, ball int"), "placed")

    cell = ["label", "dim", "code"]
    plan = keep(_blocks(placed), "blocks")
    spread = placed.select("key", "label", "dim", "n", "v", "leaves", "ball", F.explode("leaves").alias("code")).join(_few(plan), [*cell, "ball"], "left")
    block = F.coalesce(F.col("base") + F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"), F.lit(0))
    others = F.filter(F.sequence(F.lit(0), F.coalesce("total", F.lit(1)) - 1), lambda j: F.coalesce(~F.col("pure") | (j < F.col("base")) | (j >= F.col("base") + F.col("nb")), F.lit(True)))
    spread = spread.withColumn("block", block).withColumn("other", F.explode(others))
    spread = spread.select("key", *cell, "n", "v", "leaves", "ball", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = keep(spread.groupBy(*cell, "lo", "hi").applyInArrow(_comparer(least), "key binary, add long, to binary"), "links")

    inside = placed.filter("ball >= 0").groupBy("ball").agg(F.sum("n").alias("members"), F.min("key").alias("to"))
    inside = placed.filter("ball >= 0").select("key", "ball", "n").join(F.broadcast(inside), "ball")  # balls are bounded by the sample
    counted = found.select("key", "add").unionByName(inside.select("key", (F.col("members") - F.col("n")).alias("add")))
    links = counted.groupBy("key").agg(F.sum("add").alias("add"))
    edges = found.select(F.col("key").alias("a"), F.col("to").alias("b")).unionByName(inside.select(F.col("key").alias("a"), F.col("to").alias("b"))).filter("a <> b")
    label = components(keep(edges, "vector-edges")).withColumnRenamed("id", "key").withColumnRenamed("label", "comp")
    nodes = placed.select("key", "n", "low").join(links, "key", "left").join(label, "key", "left")
    nodes = keep(nodes.select("key", "n", "low", F.coalesce("add", F.lit(0)).alias("add"), F.coalesce("comp", "key").alias("comp")), "vector-nodes")
    least_id = nodes.groupBy("comp").agg(F.min("low").alias("component_id"))
    result = nodes.join(least_id, "comp").select("key", (F.col("n") - 1 + F.col("add")).alias("n_links"), "component_id")
    linked = slim.join(result, "key").select("id", "n_links", "component_id")
    alone = rows.filter(~may).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
