"""Shards along a Hilbert curve over quantised metadata, for pruning files by several columns at once.

Built from DataFrame functions only.  Rows are put in the order of the curve by a range
exchange, and get their place from the counts of the partitions before theirs, so no task
ever sees the whole order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.store import free_name, hidden, keep, partitions

#: Bits of each dimension's quantised value.
BITS = 4


def _cuts(df: DataFrame, name: str, bits: int) -> list[tuple]:
    """(value, part): where each but the first of 2**bits parts of about equal numbers of rows begins, if one does: exact, from the counts of distinct
    values, whatever their type.  Nulls count before all values.  At most 2**bits - 1 values come to the driver."""
    c = F.col(f"`{name}`")
    total, nulls = df.agg(F.count("*"), F.count_if(c.isNull())).head()
    counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    placed = running(counts, ["v"], F.col("n"), "values")
    parts = placed.select("v", F.expr(f"((_before + {nulls}) * {1 << bits}) div {max(1, total)}L").alias("q")).groupBy("q").agg(F.min("v").alias("v"))
    return sorted((r["v"], r["q"]) for r in parts.filter("q > 0").collect())


def _curve(values: list[Column], bits: int) -> list[tuple[str, Column]]:
    """Steps (name, value) of Skilling's transform from coordinates to the curve; the last is the index."""
    n, steps, now = len(values), [], []
    for i, v in enumerate(values):
        steps.append((f"_x{i}_0", v))
        now.append(f"_x{i}_0")
    made = 0

    def put(i: int, value: Column) -> None:
        nonlocal made
        made += 1
        steps.append((f"_x{i}_{made}", value))
        now[i] = f"_x{i}_{made}"

    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            first, own = F.col(now[0]), F.col(now[i])
            high, swap = own.bitwiseAND(q) != 0, first.bitwiseXOR(own).bitwiseAND(p)
            if i:
                put(i, F.when(high, own).otherwise(own.bitwiseXOR(swap)))
                put(0, F.when(high, first.bitwiseXOR(F.lit(p))).otherwise(first.bitwiseXOR(swap)))
            else:
                put(0, F.when(high, first.bitwiseXOR(F.lit(p))).otherwise(first))
    for i in range(1, n):
        put(i, F.col(now[i]).bitwiseXOR(F.col(now[i - 1])))
    t = F.lit(0)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        t = F.when(F.col(now[n - 1]).bitwiseAND(q) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
    made += 1
    steps.append(("_t", t))
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(now[i]).bitwiseXOR(F.col("_t")), level).bitwiseAND(1)
            index = F.shiftleft(index, 1).bitwiseOR(bit.cast("long"))
    steps.append(("_curve", index))
    return steps


def curve_index(df: DataFrame, dims: Sequence[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """df with the Hilbert index of its dims (of any type that has an order), each quantised into 2**bits parts of about equal
    numbers of rows: a value's part is that of the first row that holds it, when all are in order.  Nulls are in the least part.  A dimension of one
    value (or of nulls only) has one part; where all are such, or df is empty, so is the curve's."""
    if not dims:
        raise ValueError("a curve needs a dimension")
    parts, constant = [], False
    for d in dims:
        value, part, at = F.col(f"`{d}`"), F.lit(0), 0
        for cut, q in _cuts(df, d, bits):
            part, at = part + F.when(value >= F.lit(cut), q - at).otherwise(0), q
        constant |= not at
        parts.append(part)
    out = df.select("*", *[p.alias(f"_x{i}_0") for i, p in enumerate(parts)])
    if constant:
        # the optimizer would put a dimension's only value into all later steps, which double at each: what is read from a table it can't
        out = keep(out, "coordinates")
    for step, value in _curve([F.col(f"_x{i}_0") for i in range(len(dims))], bits)[len(dims) :]:
        out = out.withColumn(step, value)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_curve").alias(name))


def _ranged(df: DataFrame, order: Sequence[str | Column], name: str) -> tuple[DataFrame, Column, Column]:
    """df in order, written once, as a place must not change when a partition is made again; each row's partition, and its place in that."""
    mark = free_name(df, "_mark")
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    ranged = keep(ranged.withColumn(mark, F.monotonically_increasing_id()), name)
    return ranged, F.shiftright(F.col(mark), 33), F.col(mark).bitwiseAND((1 << 33) - 1)


def _base(ranged: DataFrame, part: Column, weight: Column) -> DataFrame:
    """(_part, _base): the sum of what the partitions before each hold; a row for each partition."""
    sums = ranged.groupBy(part.alias("_part")).agg(F.sum(weight).alias("_n"))
    return sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))


def places(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with each row's _place from 0 in the given order."""
    ranged, part, own = _ranged(df, order, name)
    out = ranged.join(F.broadcast(_base(ranged, part, F.lit(1))), part == F.col("_part"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + own).alias("_place"))


def running(df: DataFrame, order: Sequence[str | Column], weight: Column, name: str) -> DataFrame:
    """df with _before, the sum of a whole-numbered weight over the rows before each in the given order.  A window adds up within each partition of
    a range exchange, never over all rows."""
    ranged, part, own = _ranged(df, order, name)
    within = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumns({"_part": part, "_own": own}).withColumn("_within", within).join(F.broadcast(_base(ranged, part, weight)), "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_within")).alias("_before"))


def hilbert_shards(df: DataFrame, dims: Sequence[str], shards: int, tie: Sequence[str], bits: int = BITS) -> DataFrame:
    """df with curve (index), shard (0 to shards - 1) and slot (place in the shard, gapless from 0).

    Shards are runs of the curve's order whose counts are at most one apart.  Ties of the index go by
    the columns ``tie``; rows that tie in all of them are alike for it.  A hot value of one
    dimension is cut by the others and by tie, as are copies.  An empty table gives an empty one;
    if df has columns curve, shard or slot, the new ones get an underscore."""
    new = [free_name(df, x) for x in ("curve", "shard", "slot")]
    own, names = hidden(df)
    placed = places(curve_index(own, [names[d] for d in dims], bits, "curve"), ["curve", *[names[t] for t in tie]], "shards")
    n = max(1, placed.count())
    at = F.expr(f"(_place * {shards}) div {n}L").cast("int")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", at).withColumn("slot", F.col("_place") - first)
    return out.select(*names.values(), "curve", "shard", "slot").toDF(*names, *new)
