import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import clusters as K
from waymark.operators import diagnostics as D
from waymark.operators import evaluation as E


@pytest.mark.parametrize(("scores", "pos", "want"), [([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([1, 1, 1, 1], [0, 0, 1, 1], 0.5), ([1, 2], [1, 1], None)])
def test_auc(spark, scores, pos, want):
    df = spark.createDataFrame([(float(s), bool(p)) for s, p in zip(scores, pos)], "s double, p boolean")
    assert E.auc(df, "s", "p").head().auc == want


def test_ranks_and_modal_share(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 2.0)], "v double")
    assert sorted(r.avg_rank for r in E.average_ranks(df, "v").collect()) == [2, 2, 2, 4]
    assert E.modal_share(df, "v").head().most_common_share == 0.75


def test_bootstrap(spark):
    df = spark.createDataFrame([(c, float(c)) for c in (0, 1) for _ in range(3)], "cluster_id int, v double")
    sums = E.cluster_sums(df, F.col("v"))
    out = E.bootstrap(sums, E.seeded_multiplicities(sums, 200)).head()
    assert out.mean == 0.5 and {out.lo, out.hi} <= {0.0, 0.5, 1.0}
    flat = E.cluster_sums(df.withColumn("v", F.lit(0.3)), F.col("v"))
    out = E.bootstrap(flat, E.hashed_multiplicities(flat, 50)).head()
    assert out.lo == pytest.approx(0.3) and out.hi == pytest.approx(0.3)
    both = sums.withColumn("o", F.col("s"))
    assert not E.bootstrap(both, E.seeded_multiplicities(both, 50), ["s", "o"]).head().significant
    with pytest.raises(ValueError):
        E.seeded_multiplicities(sums.filter("false"))


def test_hashed_draws_have_mean_one(spark):
    ids = spark.range(2000).select(F.col("id").alias("cluster_id"))
    n = E.hashed_multiplicities(ids, 5).agg(F.sum("m")).head()[0]
    assert abs(n / 10000 - 1) < 0.05


def test_flags(spark):
    one = lambda **k: {"non_finite": 0, "most_common_share": 0.1, "clipped": 0.1, "auc_hard": 0.6, **k}
    rows = [("a", "S3", *one(auc_hard=0.4).values()), ("b", "S3", *one().values()), ("a", "S1", *one(clipped=0.3).values()), ("b", "S1", *one(clipped=0.9, non_finite=2).values())]
    summary = spark.createDataFrame(rows, "dataset string, signal string, non_finite int, most_common_share double, clipped double, auc_hard double")
    cor = spark.createDataFrame([("a", "S1-S2", 0.95), ("a", "S1-S3", 0.9)], "dataset string, pair string, spearman double")
    floors = spark.createDataFrame([("a", True), ("b", False)], "dataset string, all_at_floor boolean")
    got = {tuple(r) for r in E.flags(summary, cor, floors).collect()}
    assert got == {("revisit", "a", "clipped", "S1"), ("stop", "b", "clipped", "S1"), ("stop", "b", "non-finite", "S1"), ("stop", "a", "correlation", "S1-S2"), ("explain", "a", "calibration", "all widths at the floor"), ("explain", "both", "S3 direction", "S3")}


@pytest.mark.parametrize(("n", "want"), [(20, (12, 4, 4)), (300, (180, 60, 60)), (7, (5, 1, 1)), (3, (1, 1, 1)), (1, (1, 0, 0))])
def test_split_sizes(n, want):
    assert K.split_sizes(n) == want


def test_seeded_split(spark):
    ids = spark.createDataFrame([("d", i) for i in range(10)], "dataset string, cluster_id int")
    got: dict = {}
    for r in K.split_seeded(ids).collect():
        got.setdefault(r.split, []).append(r.cluster_id)
    assert {k: sorted(v) for k, v in got.items()} == {"train": [0, 2, 3, 5, 6, 7], "val": [4, 9], "test": [1, 8]}
    with pytest.raises(ValueError):
        K.split_seeded(ids.union(ids))
    assert K.sample(100, 5) == K.sample(100, 20)[:5]
    with pytest.raises(ValueError):
        K.sample(3, 4)


def test_screening(spark):
    rows = [(1, i, t, "what is it", ["zz"], e, c) for i, (t, e, c) in enumerate([("", True, 0.9), ("What is it?", True, 0.9), ("tell me", True, 0.9), ("Tell me!", True, 0.9), ("so what", False, 0.9), ("why it", True, 0.7), ("is zz it", True, 0.9)])]
    df = spark.createDataFrame(rows, "cluster_id int, pos int, text string, question string, answers array<string>, entails boolean, cosine double")
    got = [r.reason for r in K.screen(df).orderBy("pos").collect()]
    assert got == ["empty", "duplicate", None, "duplicate", "nli", "cosine", "answer"]
    assert [r.text for r in K.select_passing(K.screen(df)).collect()] == ["tell me"]
    assert K.entailment_index({"0": "CONTRADICTION", "2": "entailment"}) == 2
    with pytest.raises(ValueError):
        K.entailment_index({"0": "x"})


def test_icc(spark):
    df = spark.createDataFrame([(c, float(c)) for c in range(4) for _ in range(3)], "cluster_id int, v double")
    assert D.icc(df, "v").head().icc == pytest.approx(1)
    x = np.random.default_rng(0).random(12)
    df = spark.createDataFrame([(i // 3, float(v)) for i, v in enumerate(x)], "cluster_id int, v double")
    g = x.reshape(4, 3)
    msb, msw = 3 * g.mean(axis=1).var(ddof=1), g.var(axis=1, ddof=1).mean()
    assert D.icc(df, "v").head().icc == pytest.approx((msb - msw) / (msb + 2 * msw))


def test_mismatches(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None)], "k int, v double")
    assert D.mismatches(a, b, ["k"], ["v"]).head().n == 1
