"""Queries against their SQL on small tables with what larger ones hold: passages without vectors, short lists."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows

from waymark.functions import fuzzy
from waymark.operators import lexical
from waymark.queries import ORACLE, QUERIES


def against_sql(spark, name, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    df, want = QUERIES[name](spark, str(folder)), con.sql(ORACLE[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    return got


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """40 documents, 6 of which have vectors: the first question's first ten passages hold one vector, the second finds three by words."""
    at = tmp_path_factory.mktemp("searched")
    docs = [(i, "s", f"{'alpha' if i >= 10 else 'beta'} {'filler ' * i} {'gamma' if i in (1, 20, 30) else ''}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "alpha"), (1, "gamma"), (2, "nowhere"), (3, "beta filler")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    vecs = [[10.0, 0.0, 0.0], [0.01, 1.0, 0.0], [0.02, 0.0, 1.0], [0.0, 1.0, 1.0], [0.03, 0.5, 0.0], [0.0, 0.0, 0.2]]
    spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_signals_of_questions_with_few_vectors(spark, searched):
    got = against_sql(spark, "retrieval_signals", searched)
    assert len(got) == 3  # the first question has no pair of vectors


def test_activations_count_what_a_trace_lists(spark):
    values = np.random.default_rng(7).random((300, 4)).round(2).tolist() + [[0.25, 0.45, 0.55, 0.75], [0.0, 1.0, 0.35, 0.65], [0.5] * 4]
    df = spark.createDataFrame(values, "S1 double, S2 double, S3 double, S4 double")
    names = ("S1", "S2", "S3", "S4")
    want = fuzzy.trace(df, names).select(F.explode("fired").alias("f")).groupBy("f.rule_id").count().collect()
    assert {tuple(r) for r in fuzzy.activations(df, names).collect()} == {tuple(r) for r in want}


def test_rules_are_not_listed_for_each_instance(spark):
    """Instances are counted by what decides on rules before any rule is made a row of (in a plan what comes later stands first)."""
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    plan = QUERIES["rule_activations"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("count(1)")


def shuffled(spark, job):
    """Bytes that a job writes for exchanges."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = total()
    out = job()
    return out, total() - before


def test_a_search_shuffles_less_than_the_index(spark, tmp_path):
    """The build moves each posting once, and a block once for all questions that ask for its word."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    weights = [1.0 / (i + 10) for i in range(2000)]
    passages = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=250))) for i in range(3000)], "doc_id long, text string")
    passages.repartition(4).write.parquet(str(tmp_path / "p"))
    own, built = shuffled(spark, lambda: lexical.build_index(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "i")))
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "i") for f in files if f.endswith(".parquet"))
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words[:40], k=8))) for i in range(100)], "qid long, question string")
    found, searched = shuffled(spark, lambda: lexical.search(asked, own).collect())
    assert len(found) == 100 * 50
    assert built < size / 2 and searched < size / 3, (built, searched, size)


@pytest.mark.parametrize("name", ["escalation_diagnosis", "reranked"])
def test_searches_over_short_lists(spark, searched, name):
    against_sql(spark, name, searched)


def test_a_search_makes_no_row_of_each_question_and_posting(spark, tmp_path):
    """A word that all passages hold, asked for by all questions: no step of the plan unfolds its blocks for each of them."""
    spark.createDataFrame([(i, "common " + "other " * (i % 97)) for i in range(200)], "doc_id long, text string").write.parquet(str(tmp_path / "p"))
    own = lexical.build_index(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "i"), part_docs=50)
    found = lexical.search(spark.createDataFrame([(i, "common") for i in range(40)], "qid long, question string"), own, 5)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert found.count() == 200
