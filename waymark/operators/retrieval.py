"""Lexical and dense search, fusion of pools, re-ranking and second hops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import config as C
from waymark.functions.text import has_answer
from waymark.operators.guards import finite, require, require_all
from waymark.operators.lexical import LexicalIndex, kept_index, search
from waymark.sources.tables import written

#: Numbers of a block of query vectors.
BLOCK_NUMBERS = 4_000_000


def bm25(queries: DataFrame, passages: DataFrame | LexicalIndex, k: int = C.POOL, k1: float = C.BM25_K1, b: float = C.BM25_B, query_id: str = "qid", query_text: str = "question", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(qid, doc_id, score, rank): each query's k best passages; ties go to the passage that comes
    first in the order of ids.

    passages is an index, or a table, whose index is built once for its files as they stand and then loaded
    (lexical.kept_index).  Passages without any term of the query have no score, and passages without words count for nothing
    but their number."""
    index = passages if isinstance(passages, LexicalIndex) else kept_index(passages, f"{id_col}-{text_col}", id_col=id_col, text_col=text_col)
    return search(queries, index, k, k1, b, query_id, query_text, id_col)


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """df with its rank (from 1) within by, cut at k.  Spark keeps k rows a group in each task before it shuffles."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def dense(queries: DataFrame, index: DataFrame, k: int = C.POOL, query_id: str = "qid", query_vec: str = "vector", id_col: str = "doc_id", vec_col: str = "embedding", row_no: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): each query's k passages of the largest inner product, found exactly; ties go
    to the lower row (row_no, or the id).

    Queries come to the driver in blocks of bounded size and are handed to all tasks, which multiply them with a batch of the index and
    keep k rows a query (and ties): nothing but those is shuffled.  The index is read once for each block."""
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v"))
    n, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).head()
    blocks = max(1, -(-n * dim // BLOCK_NUMBERS))
    row = F.col(row_no).cast("long") if row_no else F.lit(0).cast("long")
    at = index.select(row.alias("at"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kinds = queries.schema[query_id].dataType.simpleString(), index.schema[id_col].dataType.simpleString()
    out = None
    for i in range(blocks):
        own = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).toArrow()
        best = at.mapInArrow(_block_product(own, k), f"q {kinds[0]}, id {kinds[1]}, at long, score double")
        out = best if out is None else out.unionByName(best)
    best = top(out, ["q"], [F.desc(F.round("score", 9)), F.col("at" if row_no else "id")], k)
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _block_product(queries: pa.Table, k: int):
    """For each batch of vectors (at, id, v): each query's k best, and what ties with the last of them after rounding."""
    names = queries.column("q").combine_chunks()
    wanted = np.array(queries.column("v").to_pylist(), np.float64).reshape(len(names), -1)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            vectors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for lo in range(0, len(names), 256):
                score = np.round(wanted[lo : lo + 256] @ vectors.T, 12)
                if score.shape[1] > k:
                    last = np.partition(score, -k, axis=1)[:, -k]
                    which, row = np.nonzero(score >= last[:, None] - 2e-9)
                else:
                    which, row = np.nonzero(np.ones(score.shape, bool))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which + lo)), batch.column(1).take(pa.array(row)), batch.column(0).take(pa.array(row)), pa.array(score[which, row])], names=["q", "id", "at", "score"])

    return product


def vectors(index: DataFrame, wanted: DataFrame, id_col: str = "doc_id", order: str = "position") -> DataFrame:
    """The vectors of wanted ids (with their place in the request); an unknown id is an error."""
    require_all(wanted, index, [id_col], "vectors")
    return wanted.join(index, id_col).select(order, id_col, *[c for c in index.columns if c != id_col])


def minmax(df: DataFrame, by: Sequence[str], score: str = "score", name: str = "score") -> DataFrame:
    """Scores rescaled to [0, 1] within by; where they are (nearly) the same, all are 1."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, F.when(hi - lo < C.EPS, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))


def string_order(id_col: str) -> Column:
    return F.col(id_col).cast("string")


def fuse(lexical: DataFrame, dense_: DataFrame, pool: int = C.POOL, query_id: str = "qid", id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(qid, doc_id, score, rank): mean of both lists' min-max scores, a passage missing from one scoring 0
    there; ties by the id as a string.  Both lists are one union and one grouping."""
    a, b = (minmax(x.select(query_id, id_col, "score"), [query_id]) for x in (lexical, dense_))
    both = a.unionByName(b).groupBy(query_id, id_col).agg((F.sum("score") / 2.0).alias("score"))
    return top(both, [query_id], [F.desc(F.round("score", 12)), string_order(id_col)], pool)


def merge_pools(original: DataFrame, rewrite: DataFrame, k: int = C.A2_RERANK, query_id: str = "qid", id_col: str = "doc_id", validate: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): the better score of each passage of either pool, rescaled over all of them, cut at k."""
    both = original.select(query_id, id_col, "score").unionByName(rewrite.select(query_id, id_col, "score"))
    if validate:
        require(both, finite("score"), "a score that is no number")
    best = minmax(both.groupBy(query_id, id_col).agg(F.max("score").alias("score")), [query_id])
    return top(best, [query_id], [F.desc(F.round("score", 12)), string_order(id_col)], k)


def rerank(pool: DataFrame, ce: str = "ce", n: int | None = None, by: Sequence[str] = ("qid",), rank: str = "rank") -> DataFrame:
    """A pool in the order of its cross-encoder scores; ties keep the pool's order."""
    return top(pool, by, [F.desc(ce), F.col(rank)], n, "new_rank")


def second_hop(a1: Column, ranked: Column, keep: int = C.A2_KEEP, new: int = C.A2_NEW, top_n: int = C.TOP_N) -> tuple[Column, Column]:
    """(context, number of new passages): the first of the first hop, the best of the second that are not among the
    first hop's, and the first hop's next as far as there is room."""
    own = F.slice(a1, 1, top_n)
    fresh = F.slice(F.array_except(F.array_distinct(ranked), own), 1, new)
    return F.slice(F.concat(F.slice(own, 1, keep), fresh, F.slice(own, keep + 1, top_n)), 1, top_n), F.size(fresh)


def hits(ranked: DataFrame, passages: DataFrame, answers: DataFrame, query_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """(qid, rank, hit): whether the passage at each rank holds an answer."""
    found = ranked.join(passages.select(id_col, "text"), id_col).join(answers.select(query_id, "answers"), query_id)
    return found.select(query_id, "rank", has_answer(F.col("answers"), F.col("text")).alias("hit"))


def recall_at(hit: DataFrame, ks: Sequence[int] = (1, 5, 10, 20, 50), query_id: str = "qid") -> DataFrame:
    """(k, recall): share of queries with a hit among their first k."""
    first = hit.groupBy(query_id).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    cols = [F.struct(F.lit(k).alias("k"), F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias("recall")) for k in ks]
    return first.agg(F.array(*cols).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def overlap(a: DataFrame, b: DataFrame, k: int = C.K, query_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """(mean_overlap, none_share) of two lists' first k."""
    x, y = (d.filter(F.col("rank") <= k).select(query_id, id_col) for d in (a, b))
    common = x.join(y, [query_id, id_col]).groupBy(query_id).agg(F.count("*").alias("n"))
    per = a.select(query_id).distinct().join(common, query_id, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.avg("n").alias("mean_overlap"), F.avg((F.col("n") == 0).cast("double")).alias("none_share"))


def hybrid(queries: DataFrame, passages: DataFrame | LexicalIndex, index: DataFrame, pool: int = C.POOL, query_id: str = "qid") -> dict[str, DataFrame]:
    """Lexical, dense and fused lists of the same queries (question and vector columns)."""
    # pool rows a query, which fusion and signals read again and again: one table, written once
    both = bm25(queries, passages, pool, query_id=query_id).withColumn("kind", F.lit("lexical"))
    both = written(both.unionByName(dense(queries, index, pool, query_id=query_id).withColumn("kind", F.lit("dense"))), "lists")
    lex, den = (both.filter(F.col("kind") == kind).drop("kind") for kind in ("lexical", "dense"))
    return {"lexical": lex, "dense": den, "fused": fuse(lex, den, pool, query_id=query_id)}


def smoke(lists: dict[str, DataFrame], expected: DataFrame, query_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """(list, qid, k, expected, found, first_rank, passed): each expectation (qid, doc_ids, k: at least one of doc_ids among the first k) held
    against each ranked list.  A question without a list has found nothing, and an expectation that comes twice is one."""
    wanted = expected.select(query_id, F.array_sort(F.array_distinct("doc_ids")).alias("doc_ids"), "k").distinct()
    every = None
    for name, ranked in lists.items():
        own = ranked.select(F.lit(name).alias("list"), query_id, F.col(id_col).alias("_doc"), F.col("rank").cast("long").alias("_rank"))
        every = own if every is None else every.unionByName(own)
    asked = wanted.crossJoin(F.broadcast(expected.sparkSession.createDataFrame([(n,) for n in lists], "list string")))  # a row for each list
    asked = asked.select("list", query_id, "doc_ids", "k", F.explode_outer("doc_ids").alias("_doc"))
    hit = asked.join(every, ["list", query_id, "_doc"], "left").withColumn("_in", F.col("_rank") <= F.col("k"))
    out = hit.groupBy("list", query_id, "k", "doc_ids").agg(F.count("_doc").alias("expected"), F.count_if("_in").alias("found"), F.min("_rank").alias("first_rank"))
    return out.select("list", query_id, "k", "expected", "found", "first_rank", (F.col("found") > 0).alias("passed"))


def gold_found(ranked: DataFrame, passages: DataFrame, gold: DataFrame, k: int = C.TOP_N, query_id: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """(qid, n_gold): how many of a question's supporting titles (qid, gold) are among those of its first k passages; a question without a list has none."""
    got = ranked.filter(F.col("rank") <= k).join(passages.select(id_col, "title"), id_col).groupBy(query_id).agg(F.collect_set("title").alias("_got"))
    return gold.join(got, query_id, "left").select(query_id, F.size(F.array_intersect(F.coalesce("_got", F.array().cast("array<string>")), F.array_distinct("gold"))).alias("n_gold"))
