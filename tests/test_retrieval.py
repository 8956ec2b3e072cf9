import pytest
from pyspark.sql import functions as F

from waymark.operators import retrieval as R


def lists(spark, scores):
    return spark.createDataFrame([(1, d, float(s)) for d, s in scores.items()], "qid int, doc_id string, score double")


def ranked(df, col="score"):
    return [(r["doc_id"], r[col]) for r in df.orderBy("rank").collect()]


def test_fuse_gives_missing_sides_nothing(spark):
    out = ranked(R.fuse(lists(spark, {"a": 10, "b": 5, "c": 0}), lists(spark, {"b": 1, "d": 0})))
    assert out == [("b", 0.75), ("a", 0.5), ("c", 0.0), ("d", 0.0)]


def test_constant_scores_are_all_one(spark):
    out = R.minmax(lists(spark, {"a": 3, "b": 3}), ["qid"])
    assert {r.score for r in out.collect()} == {1.0}


def test_merge_keeps_the_better_score_and_orders_ties_as_strings(spark):
    out = R.merge_pools(lists(spark, {"a": 0.9, "b": 0.2, "c": 0}), lists(spark, {"b": 0.8, "d": 0.1}))
    assert [(d, round(s, 9)) for d, s in ranked(out)] == [("a", 1.0), ("b", round(0.8 / 0.9, 9)), ("d", round(0.1 / 0.9, 9)), ("c", 0.0)]
    ties = R.merge_pools(lists(spark, {"9": 1, "10": 1, "2": 1, "x": 1}), lists(spark, {}))
    assert [d for d, _ in ranked(ties)] == ["10", "2", "9", "x"]
    assert R.merge_pools(lists(spark, {}), lists(spark, {})).count() == 0
    with pytest.raises(ValueError):
        R.merge_pools(lists(spark, {"a": float("nan")}), lists(spark, {}), validate=True)


@pytest.mark.parametrize(
    ("a", "b", "want", "new"),
    [("abcde", "bxdyz", "abcxy", 2), ("abcde", "ea", "abcde", 0), ("abcde", "qa", "abcqd", 1), ("abcde", "xxy", "abcxy", 2)],
)
def test_second_hop(spark, a, b, want, new):
    context, n = R.second_hop(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))
    row = spark.range(1).select(context.alias("c"), n.alias("n")).head()
    assert ("".join(row.c), row.n) == (want, new)


def test_rerank_keeps_the_pool_order_in_ties(spark):
    df = spark.createDataFrame([(1, i, i + 1, s) for i, s in enumerate([0.1, 0.9, 0.9, -2.0])], "qid int, doc_id int, rank int, ce double")
    assert [r.doc_id for r in R.rerank(df).orderBy("new_rank").collect()] == [1, 2, 0, 3]


def test_dense_ties_go_to_the_lower_row(spark):
    index = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9)], "doc_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<float>")
    assert [r.doc_id for r in R.dense(q, index, k=2).orderBy("rank").collect()] == [3, 5]


def test_vectors_of_an_unknown_id(spark):
    index = spark.createDataFrame([(1, [1.0])], "doc_id int, embedding array<float>")
    with pytest.raises(KeyError):
        R.vectors(index, spark.createDataFrame([(0, 2)], "position int, doc_id int"))


def test_recall(spark):
    rows = [(q, i + 1, h) for q, flags in enumerate([[False, True, False], [False] * 3, [True, False, False]]) for i, h in enumerate(flags)]
    out = {r.k: r.recall for r in R.recall_at(spark.createDataFrame(rows, "qid int, rank int, hit boolean"), (1, 2, 3)).collect()}
    assert out == pytest.approx({1: 1 / 3, 2: 2 / 3, 3: 2 / 3})


def test_bm25_empty_tables(spark):
    q = spark.createDataFrame([(1, "a b")], "qid int, question string")
    assert R.bm25(q, spark.createDataFrame([], "doc_id int, text string")).count() == 0
