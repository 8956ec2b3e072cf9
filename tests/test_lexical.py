"""The kept index against plain BM25, with and without bounds."""

import math
import os
import random
from collections import Counter

import pytest

from waymark.operators import lexical, retrieval

K1, B = 0.9, 0.4


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1.0 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(3, 60)))) for i in range(900)]
    return rows + [(900, None), (901, ""), (902, "W7, w7! Ünïcode w7-w8"), (903, rows[5][1]), (904, "w299 " * 40)]


def plain(rows, question, k, k1=K1, b=B):
    docs = {i: Counter("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for i, t in rows}
    average = sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    found = Counter()
    for t, qtf in Counter(question.lower().split()).items():
        for i, d in docs.items():
            if t in d:
                idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                found[i] += qtf * idf * d[t] / (d[t] + k1 * (1 - b + b * sum(d.values()) / average))
    return [i for i, s in sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


QUESTIONS = ["w0 w1 w2", "w7 w8", "w299 w250 w0", "w5 w5 w120 w33", "nowhere", "ünïcode w1", ""]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lexical"))
    passages = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    return lexical.build_index(passages, path, part_docs=12, buckets=5), path


@pytest.mark.parametrize("k", [1, 7, 50, 2000])
@pytest.mark.parametrize("k1, b", [(K1, B), (1.2, 0.75)])
def test_search(spark, corpus, index, k, k1, b):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "qid long, question string")
    for prune in (True, False):
        got = {}
        for r in lexical.search(asked, index[0], k, k1, b, prune=prune).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.doc_id)
        for i, q in enumerate(QUESTIONS):
            assert got.get(i, []) == plain(corpus, q, k, k1, b), (q, prune)


def test_bounds_save_blocks(spark, corpus, index):
    """A rare term's k-th score rules out the parts without it."""
    own, _ = index
    assert own.parts > lexical.FEW_PARTS
    asked = spark.createDataFrame([(1, "w299 w0")], "qid long, question string")
    assert [r.doc_id for r in lexical.search(asked, own, 1).collect()] == [904]
    heads = own.postings.filter("term = 'w0'").count()
    assert heads > 10
    assert own.postings.agg({"n": "max"}).head()[0] <= 48


def test_an_index_is_loaded_not_built_again(spark, corpus, tmp_path):
    source, root = str(tmp_path / "p"), str(tmp_path / "root")
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(source)
    first = lexical.kept_index(spark.read.parquet(source), root=root)
    folders = {d: sorted(os.listdir(f"{root}/{d}")) for d in os.listdir(root)}
    again = lexical.kept_index(spark.read.parquet(source), root=root)
    assert {d: sorted(os.listdir(f"{root}/{d}")) for d in os.listdir(root)} == folders
    assert (first.n, first.words, first.parts) == (again.n, again.words, again.parts)
    spark.createDataFrame([(5000, "new w1")], "doc_id long, text string").write.mode("append").parquet(source)
    grown = lexical.kept_index(spark.read.parquet(source), root=root)
    assert grown.n == first.n + 1 and len(os.listdir(root)) == 2


def test_an_unfinished_index_is_not_seen(spark, index, tmp_path):
    with pytest.raises(FileNotFoundError):
        lexical.load_index(spark, str(tmp_path / "none"))
    _, path = index
    loaded = lexical.load_index(spark, path)
    assert loaded.n == 905 and loaded.terms.filter("term = 'w7'").head().df > 0
    spark.createDataFrame([(99, "x", "f", "int", 1, 1, 1, 1)], lexical.MANIFEST).write.parquet(str(tmp_path / "old" / "manifest"))
    with pytest.raises(ValueError):
        lexical.load_index(spark, str(tmp_path / "old"))


def test_search_reads_no_text_and_few_buckets(spark, index):
    own, _ = index
    asked = spark.createDataFrame([(1, "w3")], "qid long, question string")
    plan = lexical.search(asked, own, 5, prune=False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan and "PartitionFilters" in plan
    assert "text" not in plan.split("Physical Plan")[-1]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id int, text string")
    own = lexical.build_index(none, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "a b")], "qid int, question string")
    assert lexical.search(asked, own).count() == 0 and lexical.search(asked, own, prune=True).count() == 0
    assert lexical.search(asked.limit(0), own).count() == 0
    assert retrieval.bm25(asked, own).columns == ["qid", "doc_id", "score", "rank"]
