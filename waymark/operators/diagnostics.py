"""Checks of the controller and of the experiment itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import config as C
from waymark.functions.fuzzy import escalation
from waymark.operators.signals import complete_clusters

DROP = 1e-9


def score_grid(spark: SparkSession, steps: int, signals: Sequence[str] = ("S1", "S2", "S3", "S4"), width: float = 0.2, **operators) -> DataFrame:
    """The controller's score on every point of a lattice: columns i_<signal> and score.  Clips are rounded
    before scores, so the many points with the same clips are scored once."""
    parts = [spark.range(steps + 1).select(F.col("id").cast("int").alias(f"i_{s}"), (F.col("id") / float(steps)).alias(s)) for s in signals]
    grid = reduce(lambda a, b: a.crossJoin(b), parts)
    return escalation(grid, signals, width, **operators).drop(*signals)


def drops(grid: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(axis, before, after, drop) of each step along an axis; a drop is how much the score falls."""
    out = []
    for s in signals:
        w = Window.partitionBy(*[f"i_{x}" for x in signals if x != s]).orderBy(f"i_{s}")
        step = grid.select(F.lit(s).alias("axis"), F.col("score").alias("before"), F.lead("score").over(w).alias("after"))
        out.append(step.filter("after is not null"))
    return reduce(lambda a, b: a.unionByName(b), out).withColumn("drop", F.col("before") - F.col("after"))


def monotonicity(steps: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """One row: pairs, violations, max_drop, mean_drop, p95_drop and straddles (violations that cross one of the thresholds)."""
    bad = steps.filter(F.col("drop") > DROP)
    base = steps.agg(F.count("*").alias("pairs"))
    worst = bad.agg(F.count("*").alias("violations"), F.max("drop").alias("max_drop"), F.avg("drop").alias("mean_drop"), F.percentile("drop", F.lit(0.95)).alias("p95_drop"))
    out = base.crossJoin(worst)
    if thresholds is not None:
        values = [r[0] for r in thresholds.collect()]
        crossed = F.exists(F.array(*[F.lit(float(v)) for v in values]), lambda t: (F.col("after") < t) & (t <= F.col("before")))
        out = out.crossJoin(bad.agg(F.count_if(crossed).alias("straddles")))
    return out


def downgrades(steps: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, n): violations that fall below each threshold."""
    t = thresholds.toDF("threshold")
    bad = steps.filter(F.col("drop") > DROP)
    return bad.join(F.broadcast(t), (F.col("after") < F.col("threshold")) & (F.col("threshold") <= F.col("before"))).groupBy("threshold").agg(F.count("*").alias("n"))


def icc(df: DataFrame, value: str, cluster: str = "cluster_id", size: int = 3) -> DataFrame:
    """One-way intraclass correlation over complete clusters (null if nothing varies): (icc, n_clusters)."""
    own = complete_clusters(df, cluster, size=size)
    per = own.groupBy(cluster).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = per.agg(F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.count("*").alias("n_clusters"))
    within = F.col("w") * size / (size - 1)
    between = F.col("b") * size
    return t.select(F.try_divide(between - within, between + (size - 1) * within).alias("icc"), "n_clusters")


def detectable(df: DataFrame, value: str, cluster: str = "cluster_id", factor: float = 2.8) -> DataFrame:
    """The least effect that as many clusters would show: (mde, n_clusters)."""
    per = df.groupBy(cluster).agg(F.avg(value).alias("m"))
    return per.agg((F.lit(factor) * F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("mde"), F.count("*").alias("n_clusters"))


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, r2, residual_sd) of a straight line."""
    t = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.var_pop(y).alias("v"))
    return t.select("slope", "intercept", "r2", F.sqrt(F.col("v") * (1 - F.col("r2"))).alias("residual_sd"))


def agreement(table: DataFrame, index: str, cluster: str = "cluster_id") -> DataFrame:
    """Share of complete clusters of which all phrasings have one value."""
    per = complete_clusters(table, cluster).groupBy(cluster).agg(F.count_distinct(index).alias("k"))
    return per.agg(F.avg((F.col("k") == 1).cast("double")).alias("agreement"), F.count("*").alias("n_clusters"))


def sibling_router(table: DataFrame, low: str, high: str, cluster: str = "cluster_id", delta: float = C.DELTA) -> DataFrame:
    """(quality, upgraded): what a router gains that takes the dearer action where a phrasing's siblings gained more than delta on average."""
    own = complete_clusters(table, cluster)
    gain = F.col(f"q_{high}") - F.col(f"q_{low}")
    w = Window.partitionBy(cluster)
    others = (F.sum(gain).over(w) - gain) / (F.count("*").over(w) - 1)
    t = own.select(F.col(f"q_{high}").alias("h"), F.col(f"q_{low}").alias("l"), (others > delta).alias("up"))
    return t.agg(F.avg(F.when(F.col("up"), F.col("h")).otherwise(F.col("l"))).alias("quality"), F.avg(F.col("up").cast("double")).alias("upgraded"))


def cluster_oracle(table: DataFrame, actions: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """(quality): the mean if each complete cluster takes the action of its best mean."""
    per = complete_clusters(table, cluster).groupBy(cluster).agg(*[F.avg(f"q_{a}").alias(a) for a in actions])
    return per.agg(F.avg(F.greatest(*actions)).alias("quality"))


def random_flips(table: DataFrame, up: str) -> DataFrame:
    """2 p (1 - p): the flips of a router that takes the dearer action at random as often."""
    return table.agg(F.avg(F.col(up).cast("double")).alias("p")).select("p", (2 * F.col("p") * (1 - F.col("p"))).alias("random_rfr"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """Of an escalation (fallback, before and after: arrays of ids, hit_before, hit_after): shares of fallbacks and of the same
    set or order, misses and rescues, and new passages on average."""
    same_set = F.array_sort("before") == F.array_sort("after")
    new = F.size(F.array_except("after", "before"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.agg(share(F.col("fallback")).alias("fallback"), share(same_set).alias("same_set"), share(F.col("before") == F.col("after")).alias("same_order"), F.avg(new).alias("new_passages"), F.count_if(F.col("hit_before") & ~F.col("hit_after")).alias("lost"), F.count_if(~F.col("hit_before") & F.col("hit_after")).alias("rescued"))


def mismatches(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, n): rows of which a stored value and the recomputed one differ by more than the tolerance, or one is missing."""
    a = stored.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values])
    b = recomputed.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values])
    both = a.join(b, list(keys), "full")
    off = lambda v: ~F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance, F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNull())
    return both.agg(F.array(*[F.struct(F.lit(v).alias("column"), F.count_if(off(v)).alias("n")) for v in values]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def spot_check(pairs: DataFrame, a: str = "a", b: str = "b", least: float = 0.999) -> DataFrame:
    """Of pairs of vectors: cosine min, 1st percentile, median and mean, and whether all reach least."""
    from waymark.functions.vectors import cosine

    t = pairs.select(cosine(F.col(a), F.col(b)).alias("c"))
    return t.agg(F.min("c").alias("cos_min"), F.percentile("c", F.lit(0.01)).alias("cos_p1"), F.percentile("c", F.lit(0.5)).alias("cos_median"), F.avg("c").alias("cos_mean"), F.coalesce(F.min("c") >= least, F.lit(False)).alias("passed"))
