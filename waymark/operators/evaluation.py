"""How good a routing is: oracles, flips between paraphrases, resampling and rank statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import config as C
from waymark.operators.clusters import hash_share
from waymark.operators.routing import chosen
from waymark.operators.signals import complete_clusters, pairs
from waymark.sources.tables import running


def oracle_index(actions: Sequence[str], delta: float = C.DELTA) -> Column:
    """The cheapest action whose quality is within delta of the best."""
    best = F.greatest(*[F.col(f"q_{a}") for a in actions])
    out = F.lit(len(actions) - 1)
    for i in reversed(range(len(actions) - 1)):
        out = F.when(F.col(f"q_{actions[i]}") >= best - delta - C.TOL, i).otherwise(out)
    return out


def oracle_shares(table: DataFrame, actions: Sequence[str], by: Sequence[str] = (), delta: float = C.DELTA) -> DataFrame:
    """Share of each oracle action, and of instances where all actions are equally good."""
    q = [F.col(f"q_{a}") for a in actions]
    same = F.greatest(*q) - F.least(*q) <= C.TOL
    t = table.select(*by, oracle_index(actions, delta).alias("i"), same.alias("same"))
    return t.groupBy(*by).agg(*[F.avg((F.col("i") == i).cast("double")).alias(f"share_{a}") for i, a in enumerate(actions)], F.avg(F.col("same").cast("double")).alias("identical"))


def pair_flags(table: DataFrame, actions: Sequence[str], index: str = "action_index", delta: float = C.DELTA, by: Sequence[str] = (), cluster: str = "cluster_id", variant: str = "variant_id") -> DataFrame:
    """(cluster_id, a_v, b_v, flipped, harmful) for each pair of a complete cluster.  A flip harms if either would have
    been better by more than delta with the other's action, or if the dearer action brings the one
    that got it less than delta over the cheaper."""
    cols = [index, *[f"q_{a}" for a in actions]]
    p = pairs(complete_clusters(table, cluster, by), cols, cluster, variant, by)
    q = lambda side, i: F.get(F.array(*[F.col(f"{side}_q_{a}") for a in actions]), i)
    x, y = F.col(f"a_{index}"), F.col(f"b_{index}")
    envy = (q("a", y) > q("a", x) + delta + C.TOL) | (q("b", x) > q("b", y) + delta + C.TOL)
    vain = F.when(x > y, q("a", x) - q("a", y)).otherwise(q("b", y) - q("b", x)) < delta - C.TOL
    return p.select(*by, cluster, "a_v", "b_v", (x != y).alias("flipped"), ((x != y) & (envy | vain)).alias("harmful"))


def flip_rates(flags: DataFrame, by: Sequence[str] = (), cluster: str = "cluster_id") -> DataFrame:
    return flags.groupBy(*by).agg(F.avg(F.col("flipped").cast("double")).alias("rfr"), F.avg(F.col("harmful").cast("double")).alias("hrfr"), F.count("*").alias("n_pairs"), F.count_distinct(cluster).alias("n_clusters"))


def within_cluster(table: DataFrame, actions: Sequence[str], score: str = "score", index: str = "action_index", cluster: str = "cluster_id", by: Sequence[str] = ()) -> DataFrame:
    """Means over complete clusters of the population deviation of score and routed quality, and of the worst drop."""
    own = complete_clusters(table, cluster, by).select(*by, cluster, F.col(score).alias("s"), chosen("q", F.col(index), actions).alias("q"))
    per = own.groupBy(*by, cluster).agg(F.stddev_pop("s").alias("s"), F.stddev_pop("q").alias("q"), (F.max("q") - F.min("q")).alias("d"))
    return per.groupBy(*by).agg(F.avg("s").alias("score_sd"), F.avg("q").alias("f1_sd"), F.avg("d").alias("worst_drop"), F.max("d").alias("worst_drop_max"), F.count("*").alias("n_clusters"))


def cluster_sums(df: DataFrame, value: Column, cluster: str = "cluster_id", name: str = "s", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, cluster).agg(F.sum(value).alias(name), F.count(value).alias("n"))


def seeded_multiplicities(clusters: DataFrame, n_boot: int = C.N_BOOT, seed: int = C.SEED, cluster: str = "cluster_id") -> DataFrame:
    """(rep, cluster_id, m): how often each cluster is drawn in each resample, by a seeded generator over clusters in
    the order of their ids.  For experiments of a size that a driver holds (clusters x n_boot numbers)."""
    ids = sorted((r[0] for r in clusters.select(cluster).distinct().collect()), key=str)
    if not ids:
        raise ValueError("nothing to resample")
    draws = np.random.default_rng(seed).integers(0, len(ids), size=(n_boot, len(ids)))
    rows = [(b, ids[i], int(m)) for b, row in enumerate(draws) for i, m in zip(*np.unique(row, return_counts=True), strict=True)]
    kind = clusters.schema[cluster].dataType.simpleString()
    return clusters.sparkSession.createDataFrame(rows, f"rep int, {cluster} {kind}, m int")


def _poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one."""
    edges, p, c = [], float(np.exp(-1)), 0.0
    for k in range(12):
        c += p
        edges.append(c)
        p /= k + 1
    return reduce(lambda a, b: a + b, [(u >= e).cast("int") for e in edges])


def hashed_multiplicities(clusters: DataFrame, n_boot: int = C.N_BOOT, seed: int = C.SEED, cluster: str = "cluster_id") -> DataFrame:
    """The same at any size: each cluster's number of draws in each resample (zeros too) is Poisson with mean 1, from a hash."""
    reps = clusters.select(cluster).distinct().select(cluster, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    u = hash_share(F.concat_ws(":", F.col("rep").cast("string"), F.col(cluster).cast("string")), seed)
    return reps.select("rep", cluster, u.alias("u")).select("rep", cluster, _poisson(F.col("u")).alias("m"))


def bootstrap(sums: DataFrame, multiplicities: DataFrame, values: Sequence[str] = ("s",), confidence: float = C.CONFIDENCE, cluster: str = "cluster_id", by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of a ratio of sums over resampled clusters: mean, lo, hi.  With two values, of their
    difference, and whether the interval leaves zero out."""
    v = _ratio_value(values)
    reps = sums.select(*by, cluster, v.alias("v"), "n").join(multiplicities, cluster).groupBy(*by, "rep").agg(_resampled(F.col("m"), F.col("v")).alias("r"))
    return _interval(sums, reps, values, confidence, by)


def bootstrap_hashed(sums: DataFrame, n_boot: int = C.N_BOOT, values: Sequence[str] = ("s",), seed: int = C.SEED, confidence: float = C.CONFIDENCE, cluster: str = "cluster_id", by: Sequence[str] = ()) -> DataFrame:
    """The same with hashed_multiplicities, which each cluster's row makes for itself: what is shuffled is n_boot sums a task (for each of by), whatever
    the number of clusters."""
    rows = sums.select(*by, cluster, _ratio_value(values).alias("v"), "n")
    drawn = rows.select(*by, cluster, "v", "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    u = drawn.select(*by, "v", "n", "rep", hash_share(F.concat_ws(":", F.col("rep").cast("string"), F.col(cluster).cast("string")), seed).alias("u"))
    reps = u.groupBy(*by, "rep").agg(_resampled(_poisson(F.col("u")), F.col("v")).alias("r"))
    return _interval(sums, reps, values, confidence, by)


def _ratio_value(values: Sequence[str]) -> Column:
    return F.col(values[0]) if len(values) == 1 else F.col(values[0]) - F.col(values[1])


def _resampled(m: Column, v: Column) -> Column:
    return F.try_divide(F.sum(m * v), F.sum(m * F.col("n")))


def _interval(sums: DataFrame, reps: DataFrame, values: Sequence[str], confidence: float, by: Sequence[str]) -> DataFrame:
    name, half = "mean" if len(values) == 1 else "diff", (1 - confidence) / 2
    ci = reps.groupBy(*by).agg(F.percentile("r", F.array(F.lit(half), F.lit(1 - half))).alias("p"))
    mean = sums.groupBy(*by).agg((F.sum(_ratio_value(values)) / F.sum("n")).alias(name))
    both = mean.join(ci, list(by)) if by else mean.crossJoin(ci)  # a row each
    out = both.select(*by, name, F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
    return out if len(values) == 1 else out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def _below(counts: DataFrame, by: Sequence[str], value: str, n: str, name: str) -> DataFrame:
    """counts with how many stand below each distinct value."""
    if not by:
        return running(counts, value, n, name)
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)))


def average_ranks(df: DataFrame, value: str, name: str = "avg_rank", by: Sequence[str] = ()) -> DataFrame:
    """df with the mean rank of its value's ties.  Ranks come from the counts of distinct values, so rows are not
    sorted together: only distinct values are, and without by these in ranges."""
    counts = _below(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, "_n", "_b")
    return df.join(counts.select(*by, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name)), [*by, value])


def auc(df: DataFrame, score: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """(auc, n_pos, n_neg): chance that a positive scores above a negative, ties half; null without either.

    Summed over distinct scores: negatives below, and half of those beside."""
    counts = df.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    return auc_of_counts(counts, score, by)


def auc_of_counts(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The same of counts of positives p and negatives n by distinct score."""
    below = _below(counts, by, score, "n", "b")
    t = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    both = F.col("n_pos") * F.col("n_neg")
    return t.select(*by, F.when(both > 0, F.col("u") / both).alias("auc"), "n_pos", "n_neg")


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(pair, pearson, spearman) of all pairs of columns."""
    for s in names:
        df = average_ranks(df, s, f"_r_{s}")
    rows = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.corr(a, b).alias("pearson"), F.corr(f"_r_{a}", f"_r_{b}").alias("spearman")) for i, a in enumerate(names) for b in names[i + 1 :]]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def modal_share(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """Share of the most common value after rounding."""
    n = df.groupBy(*by, F.round(value, digits).alias("v")).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg((F.max("n") / F.sum("n")).alias("most_common_share"))


def flags(summary: DataFrame, correlation: DataFrame, floors: DataFrame) -> DataFrame:
    """(level, dataset, check, what): findings over per-signal figures (dataset, signal, non_finite, most_common_share, clipped,
    auc_hard), correlations (dataset, pair, spearman) and all_at_floor (dataset)."""
    def found(df: DataFrame, rule: Column, level: str, check: str, what: Column) -> DataFrame:
        return df.filter(rule).select(F.lit(level).alias("level"), F.col("dataset"), F.lit(check).alias("check"), what.alias("what"))

    s = F.col("signal")
    parts = [
        found(summary, F.col("non_finite") > 0, "stop", "non-finite", s),
        found(summary, F.col("most_common_share") > C.MAX_IDENTICAL, "stop", "identical", s),
        found(summary, F.col("clipped") > C.MAX_CLIPPED, "stop", "clipped", s),
        found(summary, (F.col("clipped") > C.REVISIT_CLIPPED) & (F.col("clipped") <= C.MAX_CLIPPED), "revisit", "clipped", s),
        found(correlation, F.abs("spearman") > C.MAX_CORRELATION, "stop", "correlation", F.col("pair")),
        found(floors, F.col("all_at_floor"), "explain", "calibration", F.lit("all widths at the floor")),
    ]
    s3 = summary.filter("signal = 'S3'").agg(F.count("*").alias("n"), F.count_if(F.col("auc_hard").isNotNull() & ~F.isnan("auc_hard")).alias("k"), F.min("auc_hard").alias("lo"), F.max("auc_hard").alias("hi"))
    parts.append(s3.filter("n = 2 and k = 2 and lo < 0.5 and hi > 0.5").select(F.lit("explain").alias("level"), F.lit("both").alias("dataset"), F.lit("S3 direction").alias("check"), F.lit("S3").alias("what")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def measure(routed: DataFrame, actions: Sequence[str], more: Sequence[str] = (), by: Sequence[str] = (), score: str = "score", index: str = "action_index", delta: float = C.DELTA) -> DataFrame:
    """Quality, cost, counts, means of further routed columns (<name>_<action>), flips and spread, in one row (for each of by)."""
    i = F.col(index)
    base = routed.groupBy(*by).agg(F.avg(chosen("q", i, actions)).alias("quality"), F.avg(chosen("c", i, actions)).alias("cost"), *[F.avg(chosen(m, i, actions)).alias(m) for m in more], *[F.count_if(i == k).alias(f"n_{a}") for k, a in enumerate(actions)])
    flip = flip_rates(pair_flags(routed, actions, index, delta, by), by)
    spread = within_cluster(routed, actions, score, index, by=by).drop("n_clusters")
    return base.join(flip, list(by)).join(spread, list(by)) if by else base.crossJoin(flip).crossJoin(spread)


def mixture(table: DataFrame, cost: DataFrame | float, actions: Sequence[str]) -> DataFrame:
    """(mixture): the best quality at a cost that a fixed action, or a random choice between two, has."""
    points = [(F.avg(f"q_{a}").alias(f"q{i}"), F.avg(f"c_{a}").alias(f"c{i}")) for i, a in enumerate(actions)]
    row = table.agg(*[c for p in points for c in p])
    row = row.crossJoin(cost) if isinstance(cost, DataFrame) else row.withColumn("cost", F.lit(float(cost)))
    options = [F.when(F.col(f"c{i}") <= F.col("cost") + C.TOL, F.col(f"q{i}")) for i in range(len(actions))]
    for i in range(len(actions)):
        for j in range(len(actions)):
            if i != j:
                lam = (F.col("cost") - F.col(f"c{i}")) / (F.col(f"c{j}") - F.col(f"c{i}"))
                options.append(F.when((F.col(f"c{i}") <= F.col("cost")) & (F.col("cost") < F.col(f"c{j}")), F.col(f"q{i}") + lam * (F.col(f"q{j}") - F.col(f"q{i}"))))
    return row.select("cost", F.greatest(*options).alias("mixture"))
