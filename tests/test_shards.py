"""Shards of vectors, passages by id, audits, guards within a job, the smoke report and the learned router's optimum."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import baselines, guards, integrity, retrieval, routing, signals
from waymark.plans import smoke
from waymark.sources import readers, shards, writers


def vectors(spark, ids, dim=4):
    return spark.createDataFrame([(str(i), [float(i % 7 == c) + 0.5 for c in range(dim)]) for i in ids], "id string, embedding array<float>")


def test_shards_have_global_rows(spark, tmp_path):
    folder = str(tmp_path / "s")
    shards.write_shards(vectors(spark, range(1, 101)).repartition(3), folder, 30)
    assert sorted(f for f in os.listdir(folder) if f.endswith(".parquet")) == [f"passages_{i:05d}.parquet" for i in range(4)]
    report = shards.inspect_shards(spark, folder, 4, "passages_*").orderBy("shard").collect()
    assert [(r.n, r.start, r.first_id, r.last_id, r.wrong) for r in report] == [(30, 0, "1", "30", None), (30, 30, "31", "60", None), (30, 60, "61", "90", None), (10, 90, "91", "100", None)]
    got = shards.read_shards(spark, folder, 4).collect()
    assert {r.row: r.id for r in got} == {i: str(i + 1) for i in range(100)}
    assert {r.id: list(r.embedding) for r in got}["8"] == [0.5, 1.5, 0.5, 0.5]


def test_wrong_shards_are_named(spark, tmp_path):
    gap = str(tmp_path / "gap")
    shards.write_shards(vectors(spark, [*range(1, 41), *range(45, 61)]), gap, 20)
    with pytest.raises(ValueError, match=r"passages_00002.parquet: ids 45 to 60 of 16 rows do not follow from 41"):
        shards.read_shards(spark, gap, 4)
    report = {r.shard: r.wrong for r in shards.inspect_shards(spark, gap, 4, first=2).collect()}
    assert report["passages_00000.parquet"].endswith("do not follow from 2") and report["passages_00001.parquet"] is None
    inner = str(tmp_path / "inner")
    shards.write_shards(vectors(spark, [*range(1, 10), *range(11, 21)]), inner, 20)
    with pytest.raises(ValueError, match="ids 1 to 20 of 19 rows"):
        shards.read_shards(spark, inner, 4)
    odd = str(tmp_path / "odd")
    shards.write_shards(vectors(spark, range(1, 5)).unionByName(vectors(spark, range(5, 9), 3)), odd, 8)
    with pytest.raises(ValueError, match="vectors without 4 numbers"):
        shards.read_shards(spark, odd, 4)
    with pytest.raises(ValueError, match="norms are off"):
        shards.read_shards(spark, gap[:-3] + "gap", 4, norm=1.0, first=None)
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, str(tmp_path / "gap"), 4, "none_*")


def test_an_empty_shard_hands_on(spark, tmp_path):
    folder = str(tmp_path / "e")
    shards.write_shards(vectors(spark, range(1, 21)), folder, 10)
    vectors(spark, []).coalesce(1).write.parquet(str(tmp_path / "none"))
    (part,) = [f for f in os.listdir(tmp_path / "none") if f.endswith(".parquet")]
    os.rename(tmp_path / "none" / part, f"{folder}/passages_00000-none.parquet")
    assert shards.read_shards(spark, folder, 4).count() == 20


def scanned(df):
    """Rows that the scans of a job read, by Spark's own metric."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName().startswith("Scan"):
            found.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))
        if p.nodeName() == "AdaptiveSparkPlan":
            walk(p.executedPlan())
        if hasattr(p, "plan") and "QueryStage" in p.nodeName():
            walk(p.plan())

    walk(plan)
    return max(found)


def test_passages_by_id_read_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(40_000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("title"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    writers.passages_cache(rows, path, group_bytes=200_000)
    df = spark.read.parquet(path)
    asked = spark.createDataFrame([(5,), (17_000,), (17_001,), (39_999,), (5,)], "id long")
    got = readers.load_passages(df, asked)
    assert sorted(r.id for r in got.collect()) == [5, 17_000, 17_001, 39_999]
    assert scanned(got) < 20_000
    every = readers.load_passages(df, spark.range(0, 40_000, 3))
    assert every.count() == 13_334
    with pytest.raises(KeyError):
        readers.load_passages(df, spark.createDataFrame([(40_000,)], "id long"))
    assert readers.load_passages(df, asked.limit(0)).count() == 0


def test_id_ranges():
    assert readers.id_ranges([3, 1, 1], 4) == [(1, 1), (3, 3)]
    assert readers.id_ranges([1, 2, 3, 100, 101, 900], 3) == [(1, 3), (100, 101), (900, 900)]
    assert readers.id_ranges(list("abcdef"), 3) == [("a", "b"), ("c", "d"), ("e", "f")]


def test_audit_in_one_pass(spark):
    rows = [(1, 1.0, 2.0, 3.0), (2, 1.0, 2.0, 3.5), (3, None, 2.0, 2.0), (3, None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, total double")
    rules = {"sum": F.abs(F.col("a") + F.col("b") - F.col("total")) <= 1e-9, "positive": F.col("b") > 0}
    got = {r.invariant: r for r in integrity.audit(df, rules, F.col("k"), df.columns).collect()}
    assert (got["sum"].n, got["sum"].violations, got["sum"].example) == (4, 3, "2") and got["positive"].violations == 0 and got["positive"].example is None
    digest = lambda d: [tuple(r) for r in d.agg(*integrity.table_digest(df.columns)).collect()]
    assert digest(df) == digest(df.repartition(7).orderBy(F.rand(3)))
    assert digest(df) != digest(df.distinct()) and digest(df) != digest(df.fillna(0.0))
    assert integrity.audit(df.limit(0), rules, F.col("k"), df.columns).select("violations").distinct().collect()[0][0] == 0


def test_completeness_and_recomputation(spark):
    df = spark.createDataFrame([(1, "A0"), (1, "A1"), (2, "A0"), (2, "A0"), (2, "X")], "k int, action string")
    got = {r.k: tuple(r)[1:] for r in integrity.complete(df, ["k"], "action", ["A0", "A1"]).collect()}
    assert got == {1: (2, "", "", ""), 2: (3, "A1", "A0", "X")}
    a = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y"), (3, 1.0, None)], "k int, v double, s string")
    b = spark.createDataFrame([(1, 0.5 + 1e-12, "x"), (2, 0.0, "y"), (4, 1.0, None)], "k int, v double, s string")
    got = {r.column: tuple(r)[1:] for r in integrity.recomputed(a, b, ["k"], ["v", "s"]).collect()}
    assert got == {"v": (4, 1, 1, 1, "2"), "s": (4, 1, 1, 0, None)}


ACTIONS = ("A0", "A1")


def outcome(spark, drop=None, twice=False, nan=False):
    rows = [("c", v, a, math.nan if nan and (v, a) == ("v0", "A1") else 0.5, 1.0) for v in ("v0", "v1") for a in ACTIONS if (v, a) != drop]
    return spark.createDataFrame(rows + rows[:1] * twice, "cluster_id string, variant_id string, action string, f1 double, cost double")


def test_guards_fail_the_job_itself(spark):
    whole = routing.outcome_table(outcome(spark), ACTIONS)
    assert routing.always(whole, ACTIONS).count() == 2
    for bad, said in (({"drop": ("v1", "A1")}, "not one row for each action: cluster_id=c, variant_id=v1"), ({"twice": True}, "not one row for each action"), ({"nan": True}, "q_A1 is no number: cluster_id=c, variant_id=v0")):
        t = routing.outcome_table(outcome(spark, **bad), ACTIONS)
        with pytest.raises(Exception, match=said):
            routing.always(t, ACTIONS).collect()
        assert routing.outcome_table(outcome(spark, **bad), ACTIONS, strict=False).count() == 2
    values = spark.createDataFrame([("c", "v0", 0.1), ("c", "v1", 0.9)], "cluster_id string, variant_id string, s double")
    assert {r.variant_id: r.s for r in routing.align(whole, values).collect()} == {"v0": 0.1, "v1": 0.9}
    for bad, said in ((values.limit(1), "values: nothing for: cluster_id=c, variant_id=v"), (values.union(values), "values: more than one row for: cluster_id=c")):
        with pytest.raises(Exception, match=said):
            routing.align(whole, bad).filter("s > 0.5").collect()
        with pytest.raises(Exception, match=said):
            routing.align(whole, bad).agg(F.avg("s")).collect()
    matrix = signals.signal_matrix(whole, values.withColumnRenamed("s", "S1"), ["S1"])
    assert matrix.agg(F.sum("S1")).head()[0] == pytest.approx(1.0)
    with pytest.raises(Exception, match=r"S1 is outside \[0, 1\]: cluster_id=c, variant_id=v1"):
        signals.signal_matrix(whole, values.select("cluster_id", "variant_id", (F.col("s") * 2).alias("S1")), ["S1"]).agg(F.sum("S1")).collect()


def test_a_guard_needs_no_job_and_no_pass_of_its_own(spark, tmp_path):
    outcome(spark).write.parquet(str(tmp_path / "o"))
    table = routing.outcome_table(spark.read.parquet(str(tmp_path / "o")), ACTIONS)
    values = spark.createDataFrame([("c", "v0", 0.1), ("c", "v1", 0.9)], "cluster_id string, variant_id string, s double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("guards", "")
    before = len(tracker.getJobIdsForGroup("guards"))
    out = routing.align(table, values)
    assert len(tracker.getJobIdsForGroup("guards")) == before
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_demanded(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int").withColumn("v", guards.demanded(F.col("v"), F.col("v") > 0, "v is not there", ["k"]))
    assert df.select("k").count() == 2
    with pytest.raises(Exception, match="v is not there: k=2"):
        df.collect()


def test_smoke_report(spark):
    ranked = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("abcd")] + [(2, "x", 1)], "qid int, doc_id string, rank int")
    expected = spark.createDataFrame([(1, ["c", "z"], 3), (1, ["d"], 3), (2, ["x", "x"], 1), (3, ["a"], 5), (2, [], 1)], "qid int, doc_ids array<string>, k int")
    got = {(r.list, r.qid, r.k, r.expected): (r.found, r.first_rank, r.passed) for r in retrieval.smoke({"one": ranked, "two": ranked.filter("qid = 2")}, expected).collect()}
    assert len(got) == 10
    assert got["one", 1, 3, 2] == (1, 3, True) and got["one", 1, 3, 1] == (0, 4, False) and got["one", 2, 1, 1] == (1, 1, True)
    assert got["one", 3, 5, 1] == (0, None, False) and got["two", 1, 3, 2] == (0, None, False) and got["one", 2, 1, 0] == (0, None, False)


def test_the_optimum(spark):
    """No gradient is left, the loss is no larger than that of many plain steps, and few jobs are needed."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) * [1.0, 5.0, 0.1] + [0.0, 2.0, 1.0]
    y = (x @ [1.0, -0.3, 2.0] + rng.standard_normal(400)).astype(float)
    rows = [(*map(float, r), 4.0, int(v > 1.5) + int(v > 2.5)) for r, v in zip(np.round(x, 1), y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, label int")
    names = ["a", "b", "c", "same"]
    model = baselines.fit_optimum(df, names, "label", 3)
    assert model["jobs"] < 30 and np.abs(model["gradient"]).max() < 1e-10
    slow = baselines.fit_learned(df, names, "label", 3, steps=4000)
    assert np.abs(np.array(slow["weights"])[:-1] - np.array(model["weights"])[:-1]).max() < 1e-2
    moments = baselines.fitted_moments(df, model, "label").collect()
    assert len(moments) == 15 and max(abs(r.observed - r.fitted) for r in moments) < 1e-9
    p = df.select(*[c.alias(f"p{i}") for i, c in enumerate(baselines.learned_probabilities(model))]).toPandas().to_numpy()
    assert np.allclose(p.sum(1), 1)
    with pytest.raises(ValueError):
        baselines.fit_optimum(df.limit(0), names, "label", 3)


def test_smoke_report_in_one_call(spark):
    words = "red green blue stone river hill".split()
    passages = spark.createDataFrame([(i, " ".join(words[(i * j) % 6] for j in range(1, 8)) + f" n{i}") for i in range(30)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [math.cos(i), math.sin(i), 0.5]) for i in range(30)], "doc_id long, embedding array<double>")
    asked = [(1, "red n7", ["n7"], [1.0, 0.0, 0.5]), (2, "blue hill", ["nowhere"], [0.0, 1.0, 0.5]), (3, "is it red", ["yes"], [0.0, 1.0, 0.5]), (4, "stone n3", ["n3"], [0.5, 0.5, 0.5])]
    out = smoke.smoke_report(spark.createDataFrame(asked, "qid long, question string, answers array<string>, vector array<double>"), passages, vectors, ks=(1, 50))
    assert tuple(out["counts"].head()) == (4, 3, 1, pytest.approx(1 / 3))
    recall = {(r.list, r.k): r.recall for r in out["recall"].collect()}
    assert recall["lexical", 1] == pytest.approx(2 / 3) and recall["dense", 50] == pytest.approx(2 / 3) and len(recall) == 6
    got = {r.signal: r for r in out["signals"].collect()}
    assert set(got) == {"S1", "S2", "S3", "S4"} and got["S1"].n_pos == 1 and got["S1"].n_neg == 2 and got["S1"].non_finite == 0
    assert {r.pair for r in out["correlations"].collect()} == {"S1-S2", "S1-S3", "S1-S4", "S2-S3", "S2-S4", "S3-S4"}


def test_small_reports(spark):
    grid = spark.createDataFrame([(0.1, 0.2), (0.2, 0.3)], "t1 double, t2 double")
    assert sorted(r.value for r in routing.threshold_values(grid).collect()) == [0.1, 0.2, 0.3]
    rows = spark.createDataFrame([("a", c) for c, n in ((1, 3), (2, 2), (3, 4), (4, 3)) for _ in range(n)], "d string, cluster_id int")
    assert tuple(signals.cluster_coverage(rows, by=["d"]).head()) == ("a", 4, 2, 1, 1)
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 6)], "qid int, doc_id int, rank int")
    passages = spark.createDataFrame([(10, "A"), (11, "B"), (12, "C")], "doc_id int, title string")
    gold = spark.createDataFrame([(1, ["A", "A", "C"]), (2, ["A"])], "qid int, gold array<string>")
    assert {r.qid: r.n_gold for r in retrieval.gold_found(ranked, passages, gold).collect()} == {1: 1, 2: 0}
