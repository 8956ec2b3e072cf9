"""Scores and fits of the routers: weighted, crisp, fuzzy and query-only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import CENTRES
from waymark.functions.fuzzy import escalation
from waymark.operators import routing as R
from waymark.sources.tables import written


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted(signals: Sequence[str], weights: Sequence[float | Column]) -> Column:
    if not any(isinstance(w, Column) for w in weights) and (len(weights) != len(signals) or min(weights) < 0 or abs(sum(weights) - 1) > 1e-9):
        raise ValueError(f"{len(signals)} weights of at least 0 that sum to 1, got {weights}")
    return _sum([F.col(s) * w for s, w in zip(signals, weights, strict=True)])


def level(s: Column) -> Column:
    """0, 1 or 2: how many centres a signal reaches."""
    return _sum([(s >= c).cast("int") for c in CENTRES])


def ordinal(signals: Sequence[str]) -> Column:
    return _sum([level(F.col(s)) for s in signals])


def fit_weighted(table: DataFrame, signals: Sequence[str], weights: DataFrame, grid: DataFrame, budget: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Weights and cut together; weights without a feasible cut drop out, ties go to the lower weight_id."""
    names = [f"w{i}" for i in range(1, len(signals) + 1)]
    scored = table.crossJoin(F.broadcast(weights)).withColumn("score", F.round(weighted(signals, [F.col(w) for w in names]), 12))
    values = R.grid_values(scored, grid, "score", actions, by=["weight_id", *names])
    cuts = grid.columns
    each = R.select_thresholds(values, budget, cuts, by=["weight_id", *names])
    key = F.struct((-F.round("quality", 12)).alias("a"), F.round("cost", 12).alias("b"), *cuts, "weight_id")
    return each.agg(F.min_by(F.struct(*each.columns), key).alias("x"), F.count("*").alias("n_feasible_weights")).filter("x is not null").select("x.*", "n_feasible_weights")


def fit_ordinal(table: DataFrame, signals: Sequence[str], budget: DataFrame, actions: Sequence[str]) -> DataFrame:
    grid = R.cut_grid(table.sparkSession, len(signals), len(actions))
    values = R.grid_values(table.withColumn("score", ordinal(signals).cast("double")), grid, "score", actions)
    return R.fit(values, budget, grid.columns)


def fit_fuzzy(table: DataFrame, signals: Sequence[str], grid: DataFrame, budget: DataFrame, actions: Sequence[str], widths: Sequence[float] | float = 0.2, **operators) -> DataFrame:
    """The fixed width makes B3, calibrated ones B4; other operators the ablations.  Scores meet thresholds after rounding, so that the order of
    sums does not decide."""
    scored = escalation(table, signals, widths, **operators).withColumn("score", F.round("score", DIGITS) + 0.0)
    values = R.grid_values(scored, grid, "score", actions)
    return R.fit(values, budget, grid.columns)


def route(table: DataFrame, score: Column, cuts: Sequence[float], actions: Sequence[str]) -> DataFrame:
    """table with the action index that a fit gives it."""
    R.check_thresholds(cuts, actions)
    return table.withColumn("action_index", R.action_index(score, cuts))


#: Decimals of a score before it meets a threshold.
DIGITS = 9
#: Distinct rows that the driver takes gradient steps on itself; beyond it tasks add up each step's.
DRIVER_ROWS = 200_000


def _gradient(rows, w, mean, sd, names, n_classes):
    """Sum over counted rows of the softmax loss's gradient."""
    x, y, n = rows[list(names)].to_numpy(dtype=float), rows["label"].to_numpy(dtype=int), rows["count"].to_numpy(dtype=float)
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    e = np.exp(z @ w - (z @ w).max(axis=1, keepdims=True))
    return z.T @ ((e / e.sum(axis=1, keepdims=True) - np.eye(n_classes)[y]) * n[:, None])


def fit_learned(features: DataFrame, names: Sequence[str], label: str, n_classes: int, penalty: float = 0.01, steps: int = 2000, rate: float = 0.5) -> dict:
    """Multinomial logistic regression of the oracle action on question features, by full gradient steps from zero.

    Rows with the same features and label are one row with a count.  Up to DRIVER_ROWS of those the driver takes the steps; beyond it
    each step is a job whose tasks add up their rows' gradients."""
    rows = written(features.groupBy(*names, F.col(label).cast("int").alias("label")).agg(F.count("*").alias("count")), "features")
    weigh = lambda c: F.sum(F.col(c).cast("double") * F.col("count"))
    total, *sums = rows.agg(F.sum("count"), *[weigh(c) for c in names]).head()
    mean = np.array([s / total for s in sums])
    squares = rows.agg(*[F.sum((F.col(c) - float(m)) ** 2 * F.col("count")) for c, m in zip(names, mean, strict=True)]).head()
    sd = np.sqrt(np.array(squares, dtype=float) / total)
    sd[sd == 0] = 1.0
    w = np.zeros((len(names) + 1, n_classes))
    shrink = np.r_[np.full(len(names), penalty), 0.0][:, None]
    few = rows.toPandas() if rows.count() <= DRIVER_ROWS else None

    def spread(w: np.ndarray) -> np.ndarray:
        def part(frames):
            sums = sum((_gradient(f, w, mean, sd, names, n_classes) for f in frames if len(f)), np.zeros(w.shape))
            yield pd.DataFrame({"g": [sums.ravel().tolist()]})

        # a few hundred numbers for each task
        return np.sum([r[0] for r in rows.mapInPandas(part, "g array<double>").collect()], axis=0).reshape(w.shape)

    for _ in range(steps):
        w -= rate * ((_gradient(few, w, mean, sd, names, n_classes) if few is not None else spread(w)) / total + shrink * w)
    return {"names": list(names), "mean": mean.tolist(), "sd": sd.tolist(), "weights": w.tolist()}


def _newton_part(names: Sequence[str], mean: np.ndarray, sd: np.ndarray, w: np.ndarray):
    """Of a task's rows: the loss, its gradient and its Hessian by (feature, class), as (place, value)."""
    d, k = w.shape

    def part(frames):
        loss, g, h = 0.0, np.zeros((d, k)), np.zeros((d, k, d, k))
        for f in frames:
            if len(f):
                y, n = f["label"].to_numpy(dtype=int), f["count"].to_numpy(dtype=float)
                z = np.c_[(f[list(names)].to_numpy(dtype=float) - mean) / sd, np.ones(len(f))]
                logits = z @ w
                top = logits.max(axis=1, keepdims=True)
                e = np.exp(logits - top)
                p = e / e.sum(axis=1, keepdims=True)
                loss += float(n @ (np.log(e.sum(axis=1)) + top[:, 0] - logits[np.arange(len(y)), y]))
                g += z.T @ ((p - np.eye(k)[y]) * n[:, None])
                for a in range(k):
                    for b in range(k):
                        h[:, a, :, b] += z.T @ (z * (n * p[:, a] * ((a == b) - p[:, b]))[:, None])
        values = np.r_[loss, g.ravel(), h.ravel()]
        yield pd.DataFrame({"at": np.arange(len(values)), "v": values})

    return part


def fit_optimum(features: DataFrame, names: Sequence[str], label: str, n_classes: int, penalty: float = 0.01, tolerance: float = 1e-10, most: int = 25) -> dict:
    """The same regression as fit_learned, carried on to its optimum by Newton's steps.

    A step is one job: tasks add up loss, gradient and Hessian of their rows, which Spark adds up by place, so what reaches the driver has the size
    of the model.  A step that makes the loss larger is halved.  The bias is not penalised; what the classes have in common is left as it is."""
    rows = written(features.groupBy(*names, F.col(label).cast("int").alias("label")).agg(F.count("*").alias("count")), "features")
    x = lambda c: F.col(c).cast("double")
    one = rows.agg(F.sum("count"), *[F.sum(x(c) * F.col("count")) for c in names], *[F.sum(x(c) * x(c) * F.col("count")) for c in names]).head()
    total, d = float(one[0] or 0), len(names) + 1
    if not total:
        raise ValueError("a fit needs rows")
    mean = np.array([v / total for v in one[1:d]])
    sd = np.sqrt(np.maximum(0.0, np.array([v / total for v in one[d:]]) - mean**2))
    sd[sd < 1e-12] = 1.0
    shrink = np.r_[np.full(len(names), penalty), 0.0][:, None]

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        got = rows.mapInPandas(_newton_part(names, mean, sd, w), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        v = np.zeros(1 + w.size + w.size**2)
        v[got["at"].to_numpy()] = got["v"].to_numpy() / total
        hessian = v[1 + w.size :].reshape(w.size, w.size) + np.diag((shrink * np.ones_like(w)).ravel())
        return v[0] + 0.5 * float((shrink * w * w).sum()), v[1 : 1 + w.size].reshape(w.shape) + shrink * w, hessian

    w = np.zeros((d, n_classes))
    loss, g, h = at(w)
    jobs = 1
    while np.abs(g).max() > tolerance and jobs < most:
        step, size = np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(w.shape), 1.0
        while True:
            new = at(w - size * step)
            jobs += 1
            if new[0] <= loss + 1e-12 or jobs >= most:
                break
            size /= 2
        w, (loss, g, h) = w - size * step, new
    return {"names": list(names), "mean": mean.tolist(), "sd": sd.tolist(), "weights": w.tolist(), "gradient": g.tolist(), "loss": loss, "jobs": jobs, "penalty": penalty}


def fitted_moments(features: DataFrame, model: dict, label: str) -> DataFrame:
    """(feature, class, observed, fitted): the mean of each standardised feature (1 for the bias) over the rows of each class, and what the model expects of
    it less the penalty's pull; at the optimum both are the same."""
    names, k = model["names"], len(model["weights"][0])
    z = [(F.col(c) - m) / s for c, m, s in zip(names, model["mean"], model["sd"], strict=True)] + [F.lit(1.0)]
    p = learned_probabilities(model)
    each = []
    for i, name in enumerate([*names, "bias"]):
        for j in range(k):
            pull = model["penalty"] * model["weights"][i][j] if name != "bias" else 0.0
            seen = F.avg(z[i] * (F.col(label) == j).cast("double"))
            each.append(F.struct(F.lit(name).alias("feature"), F.lit(j).alias("class"), seen.alias("observed"), (F.avg(z[i] * p[j]) + F.lit(pull)).alias("fitted")))
    return features.agg(F.array(*each).alias("e")).select(F.explode("e").alias("e")).select("e.*")


def learned_probabilities(model: dict) -> list[Column]:
    z = [(F.col(c) - m) / s for c, m, s in zip(model["names"], model["mean"], model["sd"], strict=True)] + [F.lit(1.0)]
    logits = [_sum([c * F.lit(float(row[j])) for c, row in zip(z, model["weights"], strict=True)]) for j in range(len(model["weights"][0]))]
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    return [x / _sum(e) for x in e]


def learned_score(model: dict) -> Column:
    """Expected action over the last action's index: a column over the model's features."""
    z = [(F.col(c) - m) / s for c, m, s in zip(model["names"], model["mean"], model["sd"], strict=True)] + [F.lit(1.0)]
    k = len(model["weights"][0])
    logits = [_sum([c * F.lit(float(row[j])) for c, row in zip(z, model["weights"], strict=True)]) for j in range(k)]
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    return _sum([x * (j / (k - 1)) for j, x in enumerate(e)]) / _sum(e)
