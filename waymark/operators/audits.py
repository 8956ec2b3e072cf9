"""Audits of an experiment: what its numbers would be if something else had been done."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import config as C
from waymark.functions.text import ABSTENTIONS
from waymark.operators import evaluation, routing


def shared_clusters(splits: DataFrame, cluster: str = "cluster_id", split: str = "split") -> DataFrame:
    """Clusters that more than one split holds: none, if splits are disjoint."""
    return splits.groupBy(cluster).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def abstains(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(ABSTENTIONS))


def abstention(table: DataFrame, answer: str, actions: Sequence[str]) -> DataFrame:
    """One row: share of answers of the first action that abstain, and what each other action gains on those (gain_<action>)."""
    no, first = abstains(F.col(answer)), F.col(f"q_{actions[0]}")
    return table.agg(F.avg(no.cast("double")).alias("abstained"), *[F.avg(F.when(no, F.col(f"q_{a}") - first)).alias(f"gain_{a}") for a in actions[1:]])


def order_noise(table: DataFrame, low: str, high: str, before: str = "before", after: str = "after", delta: float = C.DELTA) -> DataFrame:
    """One row over two actions' passages (arrays): of instances with the same passages in another order how many there are and the
    share whose quality differs by more than delta; of those with the same prompt the same, at any difference (it should be 0)."""
    gap = F.abs(F.col(f"q_{low}") - F.col(f"q_{high}"))
    same, as_set = F.col(before) == F.col(after), F.array_sort(F.array_distinct(before)) == F.array_sort(F.array_distinct(after))
    moved = as_set & ~same
    share = lambda c, most: F.avg(F.when(c, (gap > most).cast("double")))
    return table.agg(F.count_if(moved).alias("reordered"), share(moved, delta).alias("reordered_differ"), F.count_if(same).alias("identical"), share(same, C.TOL).alias("identical_differ"))


def by_type(table: DataFrame, kind: str, low: str, high: str, delta: float = C.DELTA) -> DataFrame:
    """(type, n, low, high, gain, wins) of each type of question."""
    gain = F.col(f"q_{high}") - F.col(f"q_{low}")
    return table.groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n"), F.avg(f"q_{low}").alias("low"), F.avg(f"q_{high}").alias("high"), F.avg(gain).alias("gain"), F.avg((gain > delta).cast("double")).alias("wins"))


def type_router(table: DataFrame, kind: str, dear: str, actions: Sequence[str]) -> DataFrame:
    """policy_value of the router that takes the last action for one type of question and the first for the rest."""
    return routing.policy_value(table, F.when(F.col(kind) == dear, len(actions) - 1).otherwise(0), actions)


def least_squares(df: DataFrame, y: str, xs: Sequence[str]) -> dict[str, float]:
    """Coefficients of y over xs and an intercept, by the normal equations: a few sums come to the driver, whatever the rows."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    goal = F.col(y).cast("double")
    n = len(cols)
    sums = df.agg(*[F.sum(cols[i] * cols[j]) for i in range(n) for j in range(n)], *[F.sum(c * goal) for c in cols]).head()
    a, b = np.array(sums[: n * n], dtype=float).reshape(n, n), np.array(sums[n * n :], dtype=float)
    return dict(zip(["intercept", *xs], np.linalg.lstsq(a, b, rcond=None)[0].tolist(), strict=True))


def bootstrap_auc(df: DataFrame, score: str, positive: str, n_boot: int = 500, cluster: str = "cluster_id", seed: int = C.SEED, confidence: float = C.CONFIDENCE) -> DataFrame:
    """(auc, lo, hi): the AUC and its interval over resampled clusters.

    Each cluster makes its own draws, and a resample is its counts by distinct score, so n_boot rows a score are shuffled at most."""
    scored = df.groupBy(cluster, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    m = evaluation.hashed_multiplicities(scored, n_boot, seed, cluster).filter("m > 0")
    reps = scored.join(m, cluster).groupBy("rep", score).agg(F.sum(F.col("m") * F.col("p")).alias("p"), F.sum(F.col("m") * F.col("n")).alias("n"))
    each = evaluation.auc_of_counts(reps, score, ["rep"])
    half = (1 - confidence) / 2
    ci = each.agg(F.percentile("auc", F.array(F.lit(half), F.lit(1 - half))).alias("c"))
    return evaluation.auc(df, score, positive).select("auc").crossJoin(ci).select("auc", F.get("c", F.lit(0)).alias("lo"), F.get("c", F.lit(1)).alias("hi"))  # a row each


def trainval_check(table: DataFrame, old: DataFrame, low: str, high: str, keys: Sequence[str] = ("cluster_id", "variant_id"), delta: float = C.DELTA) -> DataFrame:
    """One row: mean quality of both actions and of the dearer one's older run (old: keys, quality), both oracles, and how often each run
    beats or loses to the cheaper action."""
    t = table.join(old.select(*keys, F.col("quality").alias("old")), list(keys))
    a, b, o = F.col(f"q_{low}"), F.col(f"q_{high}"), F.col("old")
    return t.agg(F.count("*").alias("n"), F.avg(a).alias("low"), F.avg(b).alias("high"), F.avg(o).alias("old_high"), F.avg(F.greatest(a, b)).alias("oracle"), F.avg(F.greatest(a, o)).alias("old_oracle"), F.count_if(b > a + delta).alias("beats"), F.count_if(b < a - delta).alias("loses"), F.count_if(o > a + delta).alias("old_beats"), F.avg(f"c_{low}").alias("low_cost"), F.avg(f"c_{high}").alias("high_cost"))


def pilot_report(rows: DataFrame, base: str = "A1", keys: Sequence[str] = ("dataset", "cluster_id", "variant_id"), delta: float = C.DELTA) -> DataFrame:
    """(dataset, action, n, f1, em, recall, latency, fallbacks, beats, loses, gold_2, gold_1, gold_0): each action's means, its wins and losses against
    base by more than delta, and how often both, one or none of the gold pages are in its context.

    rows: keys, action, f1, em, recall and gold (either may be null), latency, fallback."""
    own = rows.filter(F.col("action") == base).select(*keys, F.col("f1").alias("_base"))
    t = rows.join(own, list(keys), "left")
    gold = [F.count_if(F.col("gold") == k).alias(f"gold_{k}") for k in (2, 1, 0)]
    means = [F.avg(c).alias(c) for c in ("f1", "em", "recall", "latency")]
    return t.groupBy("dataset", "action").agg(F.count("*").alias("n"), *means, F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallbacks"), F.count_if(F.col("f1") > F.col("_base") + delta).alias("beats"), F.count_if(F.col("f1") < F.col("_base") - delta).alias("loses"), *gold)


def pilot_decision(rows: DataFrame, base: str = "A1", first: str = "A2-V1", second: str = "A2-V2", margin: float = 0.01, bar: float = 0.04) -> DataFrame:
    """One row: both variants' pooled gains over base; the second is chosen if it gains at least margin more; whether the chosen one reaches the bar."""
    at = lambda a: F.avg(F.when(F.col("action") == a, F.col("f1")))
    gains = rows.agg((at(first) - at(base)).alias("gain_first"), (at(second) - at(base)).alias("gain_second"))
    chosen = F.when(F.col("gain_second") - F.col("gain_first") >= margin, second).otherwise(first)
    return gains.withColumn("chosen", chosen).withColumn("passes", F.when(F.col("chosen") == second, F.col("gain_second")).otherwise(F.col("gain_first")) >= bar)


def new_passages(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(n_new, n): how many of the second context's passages are new."""
    return rows.groupBy(F.size(F.array_except(after, before)).alias("n_new")).agg(F.count("*").alias("n"))


def norm_ratios(pairs: DataFrame, a: str = "a", b: str = "b", worst: int = 3) -> tuple[DataFrame, DataFrame]:
    """(ratio_min, ratio_max) of two columns of vectors' lengths, and the rows of the worst cosines."""
    from waymark.functions.vectors import cosine, norm

    ratio = norm(F.col(a)) / norm(F.col(b))
    return pairs.agg(F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max")), pairs.withColumn("cosine", cosine(F.col(a), F.col(b))).orderBy("cosine").limit(worst)


def top_downgrades(steps: DataFrame, thresholds: DataFrame, n: int = 4) -> DataFrame:
    """The thresholds that most violations fall below."""
    from waymark.operators.diagnostics import downgrades

    return downgrades(steps, thresholds).orderBy(F.desc("n"), "threshold").limit(n)


def signal_summary(long: DataFrame, by: Sequence[str] = ("dataset", "signal"), value: str = "value", hard: str | None = None) -> DataFrame:
    """min, max, mean, sd and non_finite of each signal, and its means over easy and hard instances where a column tells them."""
    x = F.col(value).cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = F.when(good, x)
    aggs = [F.min(own).alias("min"), F.max(own).alias("max"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("sd"), F.count_if(~good).alias("non_finite")]
    if hard:
        aggs += [F.avg(F.when(F.col(hard), own)).alias("mean_hard"), F.avg(F.when(~F.col(hard), own)).alias("mean_easy")]
    return long.groupBy(*by).agg(*aggs)


def present_in_all(actions: DataFrame, keys: Sequence[str] = ("cluster_id", "variant_id"), policy: str = "router") -> DataFrame:
    """Rows of policies that every instance has."""
    n = actions.select(*keys).distinct().count()
    full = actions.groupBy(policy).agg(F.count_distinct(*keys).alias("n")).filter(F.col("n") == n)
    return actions.join(full.select(policy), policy, "left_semi")


def intersect_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), parts)
