import pytest
from pyspark.sql import functions as F

from waymark.config import V3, V4
from waymark.operators import baselines as B
from waymark.operators import evaluation as E
from waymark.operators import routing as R


def table(spark, f1, costs, actions, **more):
    rows = [(i // 3, i % 3, *q, *costs, *[v[i] for v in more.values()]) for i, q in enumerate(f1)]
    cols = [f"q_{a} double" for a in actions] + [f"c_{a} double" for a in actions] + [f"{k} double" for k in more]
    return spark.createDataFrame([tuple(float(x) if j > 1 else x for j, x in enumerate(r)) for r in rows], "cluster_id int, variant_id int, " + ", ".join(cols))


def test_grids(spark):
    assert R.pair_grid(spark).count() == 2600
    assert R.single_grid(spark).count() == 101
    assert (R.cut_grid(spark, 4, 3).count(), R.cut_grid(spark, 3, 2).count()) == (45, 8)
    assert (R.weight_grid(spark).count(), R.weight_grid(spark, dim=3).count()) == (35, 15)


def test_half_open(spark):
    df = spark.createDataFrame([(0.3499,), (0.35,), (0.6499,), (0.65,)], "s double")
    assert [r[0] for r in df.select(B.level(F.col("s"))).collect()] == [0, 1, 1, 2]
    assert [r[0] for r in df.select(R.assign_action(F.col("s"), [0.35, 0.65], V3.actions)).collect()] == ["A0", "A1", "A1", "A2"]
    for bad in ([0.5], [0.5, 0.5], [0.6, 0.5], [0.1, float("nan")]):
        with pytest.raises(ValueError):
            R.check_thresholds(bad, V3.actions)


def rows(spark, n=2):
    return spark.createDataFrame([("c0", f"v{i}", a, f, c) for i in range(n) for a, f, c in (("A0", 0.3, 1.0), ("A1", 0.5, 2.0), ("A2", 0.6, 5.0))], "cluster_id string, variant_id string, action string, f1 double, cost double")


def test_outcome_table(spark):
    own = rows(spark)
    t = R.outcome_table(own, V3.actions, validate=True)
    assert t.count() == 2
    assert R.outcome_table(own, V3.actions, cost=["cost", "cost"]).head().c_A1 == 4.0
    for broken in (own.union(own.limit(1)), own.filter("action <> 'A2'"), own.withColumn("f1", F.lit(float("nan"))), own.withColumn("action", F.lit("A9"))):
        with pytest.raises(ValueError):
            R.outcome_table(broken, V3.actions, validate=True)
    with pytest.raises(KeyError):
        R.align(t, own.filter("variant_id = 'v0' and action = 'A0'").select("cluster_id", "variant_id", "f1"), validate=True)
    assert {r.action: r.quality for r in R.always(t, V3.actions).collect()} == {"A0": 0.3, "A1": 0.5, "A2": 0.6}


def test_v4_selection(spark):
    t = table(spark, [(1, 1), (1, 1), (0, 1), (0, 1)], (2, 6), V4.actions, score=(0.1, 0.2, 0.7, 0.8))
    grid = R.single_grid(spark)
    values = R.grid_values(t, grid, "score", V4.actions)
    best = R.fit(values, spark.createDataFrame([(4.0,)], "budget double"), ["t1"]).head()
    assert (best.t1, best.n_A1, best.n_A2, best.quality) == (0.21, 2, 2, 1.0)
    assert R.fit(values, spark.createDataFrame([(3.0,)], "budget double"), ["t1"]).head().quality == 0.75
    with pytest.raises(ValueError, match="cost budget"):
        R.fit(values, spark.createDataFrame([(1.0,)], "budget double"), ["t1"])
    naive = {r.t1: r for r in R.grid_values_naive(t, grid, "score", V4.actions).collect()}
    for r in values.collect():
        n = naive[r.t1]
        assert (r.quality, r.cost, r.n_A1, r.n_A2) == pytest.approx((n.quality, n.cost, n.n_A1, n.n_A2))
    top = R.frontier(values, ["t1"]).orderBy(F.desc("budget")).head()
    assert (top.quality, top.cost) == (1.0, 4.0)


def emh(spark, **more):
    return table(spark, [(1, 1, 1), (0, 1, 1), (0, 0, 1)], (1, 2, 5), V3.actions, **more)


def test_fits_on_easy_middle_hard(spark):
    t = emh(spark, S1=(0.5, 0.5, 0.5), S2=(0.5, 0.5, 0.5), S3=(0.1, 0.5, 0.9), S4=(0.5, 0.5, 0.5))
    budget = spark.createDataFrame([(8 / 3,)], "budget double")
    b2 = B.fit_ordinal(t, V3.signals, budget, V3.actions).head()
    assert b2.quality == 1.0
    b1 = B.fit_weighted(t, V3.signals, R.weight_grid(spark), R.pair_grid(spark), budget, V3.actions).head()
    assert b1.quality == 1.0
    b3 = B.fit_fuzzy(t, V3.signals, R.pair_grid(spark), budget, V3.actions).head()
    assert b3.cost <= 8 / 3 + 1e-9
    with pytest.raises(ValueError):
        B.weighted(V3.signals, (0.5, 0.6, 0, 0))


def test_oracle(spark):
    t = table(spark, [(0.5, 0.51, 0.6), (0.6, 0.61, 0.6), (0.4, 0.7, 0.71), (0.5, 0.52, 0.52)], (1, 2, 5), V3.actions)
    assert [r[0] for r in t.select(E.oracle_index(V3.actions)).collect()] == [2, 0, 1, 0]


def test_flips(spark):
    t = table(spark, [(0.5, 0.5, 0.5)] * 3, (1, 2, 5), V3.actions, action_index=(0, 0, 1)).withColumn("action_index", F.col("action_index").cast("int"))
    out = E.flip_rates(E.pair_flags(t, V3.actions)).head()
    assert (out.rfr, out.hrfr, out.n_pairs) == pytest.approx((2 / 3, 2 / 3, 3))
    good = table(spark, [(0.5, 0.5, 0.5), (0.5, 0.5, 0.5), (0.1, 0.9, 0.9)], (1, 2, 5), V3.actions, action_index=(0, 0, 1)).withColumn("action_index", F.col("action_index").cast("int"))
    assert E.flip_rates(E.pair_flags(good, V3.actions)).head().hrfr == 0


def test_within_cluster(spark):
    t = table(spark, [(0.2, 0, 0), (0.6, 0, 0), (0.4, 0, 0)], (1, 2, 5), V3.actions, score=(0.3, 0.4, 0.5)).withColumn("action_index", F.lit(0))
    out = E.within_cluster(t, V3.actions).head()
    assert out.score_sd == pytest.approx((0.02 / 3) ** 0.5) and out.worst_drop == pytest.approx(0.4)


def test_learned_router_learns(spark):
    df = spark.createDataFrame([(float(i % 2), i % 2 * 2) for i in range(40)], "x double, label int")
    model = B.fit_learned(df, ["x"], "label", 3)
    got = {r.x: r.s for r in df.select("x", B.learned_score(model).alias("s")).distinct().collect()}
    assert got[0.0] < 0.2 and got[1.0] > 0.8
