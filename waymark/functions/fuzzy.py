"""The fuzzy controller as column arithmetic.

A rule base over n signals has 3**n rules, but a rule's consequent depends only on the sum
of its labels, so the strongest rule of each sum follows from those of one signal less.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.config import CENTRES, OUTPUT_POINTS

LABELS = ("Low", "Med", "High")
# Output sets, and each label's value under the zero-order defuzzifier (its set's centroid).
OUTPUT_SETS = ((0.0, 0.0, 0.0, 0.4), (0.25, 0.5, 0.5, 0.75), (0.6, 1.0, 1.0, 1.0))
OUTPUT_VALUES = (0.4 / 3, 0.5, 1 - 0.4 / 3)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Rises on [a, b], falls on [c, d]; a shoulder where a = b or c = d."""
    up = F.lit(1.0) if a == b else (x - a) / (b - a)
    down = F.lit(1.0) if c == d else (F.lit(d) - x) / (d - c)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), up, down))
    return F.when((x < a) | (x > d), 0.0).otherwise(inside)


def memberships(s: Column, width: float | Column) -> tuple[Column, Column, Column]:
    """Degrees of Low, Med and High; bands of the given width around the two centres."""
    if not isinstance(width, Column):
        if not 0 < width <= 0.25:
            raise ValueError(f"a width lies in (0, 0.25], got {width}")
        width = F.lit(width)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    half = width / 2
    lo, hi = ((s - (F.lit(c) - half)) / ((F.lit(c) + half) - (F.lit(c) - half)) for c in CENTRES)
    fall = lambda c: ((F.lit(c) + half) - s) / ((F.lit(c) + half) - (F.lit(c) - half))
    return clip(fall(CENTRES[0])), clip(F.least(lo, fall(CENTRES[1]))), clip(hi)


def consequent(t: int, n: int) -> int:
    return (t >= n) + (t > n)


def rule_base(n: int) -> list[tuple[int, tuple[int, ...], int, int]]:
    """(rule id, label of each signal, their sum, consequent), in lexicographic order."""
    return [(i, labels, sum(labels), consequent(sum(labels), n)) for i, labels in enumerate(product(range(3), repeat=n), 1)]


def best_by_sum(degrees: Sequence[Sequence[Column]], tnorm: str) -> list[Column]:
    """The strongest rule of each label sum."""
    join = {"min": lambda a, b: F.least(a, b), "product": lambda a, b: a * b}[tnorm]
    best = list(degrees[0])
    for mu in degrees[1:]:
        best = [reduce(lambda a, b: F.greatest(a, b), ways) if len(ways := [join(best[t - k], mu[k]) for k in range(3) if 0 <= t - k < len(best)]) > 1 else ways[0] for t in range(len(best) + 2)]
    return best


def with_clips(df: DataFrame, signals: Sequence[str], widths: Sequence[float | Column], tnorm: str = "min", names: Sequence[str] = ("clip_low", "clip_med", "clip_high")) -> DataFrame:
    """df with each output label's clip: the strength of its strongest rule."""
    n = len(signals)
    mu = [f"_m{i}{k}" for i in range(n) for k in range(3)]
    out = df.select("*", *[d.alias(f"_m{i}{k}") for i, (s, w) in enumerate(zip(signals, widths, strict=True)) for k, d in enumerate(memberships(F.col(s), w))])
    # one signal a step, so that expressions stay short
    best = [f"_m0{k}" for k in range(3)]
    made = []
    for i in range(1, n):
        new = best_by_sum([[F.col(b) for b in best], [F.col(f"_m{i}{k}") for k in range(3)]], tnorm)
        best = [f"_b{i}{t}" for t in range(len(new))]
        made += best
        out = out.select("*", *[c.alias(b) for c, b in zip(new, best, strict=True)])
    top = lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0]
    groups = ([F.col(b) for b in best[:n]], [F.col(best[n])], [F.col(b) for b in best[n + 1 :]])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[top(g).alias(x) for g, x in zip(groups, names, strict=True)])


def centroid(clips: DataFrame, names: Sequence[str] = ("clip_low", "clip_med", "clip_high"), points: int = OUTPUT_POINTS) -> DataFrame:
    """clips (three columns) with their score, over 0, 1/(points-1), ..., 1.  Distinct clips meet the fixed
    axis in a broadcast join and are summed up, so this stays in generated code."""
    axis = clips.sparkSession.range(points).select((F.col("id") / float(points - 1)).alias("_y"))
    y = F.col("_y")
    sets = axis.select("_y", *[trapezoid(y, *s).alias(f"_s{i}") for i, s in enumerate(OUTPUT_SETS)])
    agg = F.greatest(*[F.least(F.col(f"_s{i}"), F.col(c)) for i, c in enumerate(names)])
    return clips.select(*names).distinct().crossJoin(F.broadcast(sets)).groupBy(*names).agg((F.sum(agg * y) / F.sum(agg)).alias("score"))


def _rule_strengths(mu: Sequence[Sequence[Column]], tnorm: str) -> list[tuple[int, Column]]:
    join = {"min": lambda cols: F.least(*cols), "product": lambda cols: reduce(lambda a, b: a * b, cols)}[tnorm]
    return [(out, join([mu[i][k] for i, k in enumerate(labels)])) for _, labels, _, out in rule_base(len(mu))]


def escalation(df: DataFrame, signals: Sequence[str], widths: Sequence[float | Column] | float = 0.2, tnorm: str = "min", aggregation: str = "max", defuzz: str = "centroid", name: str = "score") -> DataFrame:
    """df with the controller's score.  Signals lie in [0, 1]; another value makes the score null."""
    if tnorm not in ("min", "product") or aggregation not in ("max", "probsum") or defuzz not in ("centroid", "sugeno"):
        raise ValueError(f"unknown operators {tnorm}, {aggregation}, {defuzz}")
    if defuzz == "sugeno" and aggregation != "max":
        raise ValueError("the zero-order defuzzifier has no sets to aggregate")
    widths = [widths] * len(signals) if isinstance(widths, (int, float)) else list(widths)
    valid = reduce(lambda a, b: a & b, [F.col(s).between(0, 1) for s in signals])
    names = ("_low", "_med", "_high")
    cols = [F.col(f"`{c}`") for c in df.columns]
    if aggregation == "max" and defuzz == "centroid":
        own = with_clips(df, signals, widths, tnorm, names)
        out = own.join(centroid(own.filter(valid), names).withColumnRenamed("score", "_score"), list(names), "left")
        return out.select(*cols, F.when(valid, F.col("_score")).alias(name))
    n = len(signals)
    own = df.select("*", *[d.alias(f"_m{i}{k}") for i, (s, w) in enumerate(zip(signals, widths, strict=True)) for k, d in enumerate(memberships(F.col(s), w))])
    rules = _rule_strengths([[F.col(f"_m{i}{k}") for k in range(3)] for i in range(n)], tnorm)
    own = own.select(*cols, F.array(*[F.struct(F.lit(o).alias("o"), s.alias("s")) for o, s in rules]).alias("_rules"))
    if defuzz == "sugeno":
        value = F.array(*[F.lit(v) for v in OUTPUT_VALUES])
        top = F.aggregate("_rules", F.lit(0.0), lambda a, r: a + r["s"] * F.get(value, r["o"]))
        return own.select(*cols, F.when(valid, top / F.aggregate("_rules", F.lit(0.0), lambda a, r: a + r["s"])).alias(name))
    strengths = own.select(*cols, F.transform("_rules", lambda r: r["s"]).alias("_strengths"))
    return strengths.select(*cols, F.when(valid, _probabilistic([o for o, _ in rules])(F.col("_strengths"))).alias(name))


def _probabilistic(outputs: Sequence[int]):
    """Scores from all rules' strengths: at each point the fired rules' clipped sets are combined as 1 - prod(1 - a).
    A product over rules at a thousand points has no built-in form, so this is an Arrow function."""
    y = np.linspace(0.0, 1.0, OUTPUT_POINTS)
    with np.errstate(divide="ignore", invalid="ignore"):
        sets = [np.clip(np.minimum(1.0 if a == b else (y - a) / (b - a), 1.0 if c == d else (d - y) / (d - c)), 0.0, 1.0) for a, b, c, d in OUTPUT_SETS]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.full(len(s), np.nan)
            for i, row in enumerate(s):
                if row is not None:
                    rest = np.ones(OUTPUT_POINTS)
                    for r in np.flatnonzero(row > 0):
                        rest *= 1.0 - np.minimum(sets[outputs[r]], row[r])
                    h = 1.0 - rest
                    out[i] = (h * y).sum() / h.sum()
            yield pd.Series(out)

    return score


def trace(df: DataFrame, signals: Sequence[str], widths: Sequence[float] | float = 0.2, tnorm: str = "min") -> DataFrame:
    """df with fired: every rule with a strength, its id, labels and consequent."""
    widths = [widths] * len(signals) if isinstance(widths, (int, float)) else list(widths)
    mu = [memberships(F.col(s), w) for s, w in zip(signals, widths, strict=True)]
    join = (lambda cols: F.least(*cols)) if tnorm == "min" else (lambda cols: reduce(lambda a, b: a * b, cols))
    rules = [F.struct(F.lit(i).alias("rule_id"), F.array(*[F.lit(LABELS[k]) for k in labels]).alias("labels"), F.lit(LABELS[o]).alias("consequent"), join([mu[j][k] for j, k in enumerate(labels)]).alias("strength")) for i, labels, _, o in rule_base(len(signals))]
    return df.withColumn("fired", F.filter(F.array(*rules), lambda r: r["strength"] > 0))


def activations(df: DataFrame, signals: Sequence[str], widths: Sequence[float] | float = 0.2) -> DataFrame:
    """(rule_id, fired): in how many rows each rule that fires at all has a strength, under either t-norm.

    That depends only on which labels have a degree, so rows are counted by these first, and rules meet the few kinds of rows."""
    widths = [widths] * len(signals) if isinstance(widths, (int, float)) else list(widths)
    own = {f"_m{i}": sum((d > 0).cast("int") * 2**k for k, d in enumerate(memberships(F.col(s), w))) for i, (s, w) in enumerate(zip(signals, widths, strict=True))}
    kinds = df.select(*[c.alias(m) for m, c in own.items()]).groupBy(*own).agg(F.count("*").alias("n"))
    fires = [F.when(reduce(lambda a, b: a & b, [F.col(m).bitwiseAND(2**k) > 0 for m, k in zip(own, labels, strict=True)]), F.lit(i)) for i, labels, _, _ in rule_base(len(signals))]
    each = kinds.select("n", F.explode(F.array_compact(F.array(*fires))).alias("rule_id"))
    return each.groupBy("rule_id").agg(F.sum("n").alias("fired"))
