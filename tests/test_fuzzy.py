import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import fuzzy as Z
from waymark.operators import diagnostics as D
from waymark.operators import routing as R

S4 = ("S1", "S2", "S3", "S4")


def score(spark, rows, signals=S4, **how):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{s} double" for s in signals))
    return [r.score for r in Z.escalation(df, signals, **how).orderBy("i").collect()]


def test_memberships(spark):
    rows = spark.createDataFrame([(0.35,), (0.65,), (0.5,)], "s double").select(*[d.alias(n) for d, n in zip(Z.memberships(F.col("s"), 0.2), "abc")]).collect()
    assert [tuple(round(x, 9) for x in r) for r in rows] == [(0.5, 0.5, 0), (0, 0.5, 0.5), (0, 1, 0)]
    with pytest.raises(ValueError):
        Z.memberships(F.lit(0.5), 0.3)


def test_rule_counts():
    for n, want in ((4, (31, 19, 31)), (3, (10, 7, 10))):
        outs = [o for *_, o in Z.rule_base(n)]
        assert tuple(outs.count(k) for k in range(3)) == want


def test_scores(spark):
    got = score(spark, [(0.3, 0.4, 0.7, 0.75), (0.35, 0.4, 0.7, 0.75), (0.3, 0.5, 0.5, 0.7), (0, 0, 0, 0), (1, 1, 1, 1)])
    assert [round(x, 6) for x in got] == [0.612179, 0.574834, 0.5, 0.133, 0.867]
    assert score(spark, [(1.5, 0, 0, 0)]) == [None]
    assert score(spark, [(0.65, 0.5, 0.5, 0.5)], defuzz="sugeno")[0] == pytest.approx(0.5 * 0.5 + 0.5 * (1 - 0.4 / 3))
    with pytest.raises(ValueError):
        score(spark, [(0, 0, 0, 0)], defuzz="sugeno", aggregation="probsum")


def brute(s, tnorm, aggregation, width=0.2):
    """Rule by rule, point by point."""
    y = np.linspace(0, 1, 1001)
    up = lambda x, a, b: np.clip((x - a) / (b - a), 0, 1)
    sets = [1 - up(y, 0, 0.4), np.minimum(up(y, 0.25, 0.5), 1 - up(y, 0.5, 0.75)), up(y, 0.6, 1)]
    h = width / 2
    mu = [(1 - up(x, 0.35 - h, 0.35 + h), min(up(x, 0.35 - h, 0.35 + h), 1 - up(x, 0.65 - h, 0.65 + h)), up(x, 0.65 - h, 0.65 + h)) for x in s]
    heights = []
    for _, labels, _, o in Z.rule_base(len(s)):
        own = [mu[i][k] for i, k in enumerate(labels)]
        strength = min(own) if tnorm == "min" else float(np.prod(own))
        if strength > 0:
            heights.append(np.minimum(sets[o], strength))
    agg = np.max(heights, axis=0) if aggregation == "max" else 1 - np.prod([1 - a for a in heights], axis=0)
    return float((agg * y).sum() / agg.sum())


@pytest.mark.parametrize(("tnorm", "aggregation"), [("min", "max"), ("product", "max"), ("min", "probsum"), ("product", "probsum")])
def test_operators_against_every_rule(spark, tnorm, aggregation):
    rows = np.random.default_rng(3).random((6, 4)).round(3).tolist() + [[0.35, 0.1, 0.1, 0.1]]
    got = score(spark, rows, tnorm=tnorm, aggregation=aggregation)
    assert got == pytest.approx([brute(r, tnorm, aggregation) for r in rows], abs=1e-9)


def test_few_rules_fire(spark):
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.random.default_rng(0).random((50, 4))], "S1 double, S2 double, S3 double, S4 double")
    assert Z.trace(df, S4).agg(F.max(F.size("fired"))).head()[0] <= 16


@pytest.mark.parametrize(("steps", "pairs", "bad"), [(5, 4320, 64), (10, 53240, 1584)])
def test_monotonicity(spark, steps, pairs, bad):
    grid = D.score_grid(spark, steps).withColumn("score", F.round("score", 12))
    out = D.monotonicity(D.drops(grid, S4), R.single_grid(spark)).head()
    assert (out.pairs, out.violations) == (pairs, bad)
    assert out.max_drop == pytest.approx(0.006720, abs=1e-6)


def test_planted_drop(spark):
    grid = spark.createDataFrame([(a, b, 0.9) for a in (0, 1) for b in (0, 1)], "i_S1 int, i_S2 int, score double")
    grid = grid.withColumn("score", F.when((F.col("i_S1") == 0) & (F.col("i_S2") == 0), 0.62).when((F.col("i_S1") == 1) & (F.col("i_S2") == 0), 0.58).otherwise(F.col("score")))
    steps = D.drops(grid, ("S1", "S2"))
    out = D.monotonicity(steps, spark.createDataFrame([(0.6,), (0.9,)], "t double")).head()
    assert (out.pairs, out.violations, out.straddles) == (4, 1, 1)
    assert D.downgrades(steps, spark.createDataFrame([(0.6,), (0.9,)], "t double")).collect()[0].asDict() == {"threshold": 0.6, "n": 1}
