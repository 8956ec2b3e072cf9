"""The end-to-end check of retrieval: recall of the three lists, raw signals, and how signals tell hard questions, in one call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import has_answer, is_yes_no
from waymark.operators import audits, evaluation, retrieval, signals
from waymark.operators.lexical import LexicalIndex
from waymark.sources.tables import written

SIGNALS = ("S1", "S2", "S3", "S4")


def list_hits(lists: dict[str, DataFrame], passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(list, qid, rank, hit): whether the passage at each rank of each list holds an answer.  The texts that any list names are read once."""
    every = reduce(lambda a, b: a.unionByName(b), [x.select(F.lit(name).alias("list"), "qid", "doc_id", "rank") for name, x in lists.items()])
    pairs = every.select("qid", "doc_id").distinct().join(passages.select("doc_id", "text"), "doc_id").join(questions.select("qid", "answers"), "qid")
    known = pairs.select("qid", "doc_id", has_answer(F.col("answers"), F.col("text")).alias("hit"))
    return every.join(known, ["qid", "doc_id"]).select("list", "qid", "rank", "hit")


def smoke_report(questions: DataFrame, passages: DataFrame, vectors: DataFrame, index: DataFrame | LexicalIndex | None = None, ks: Sequence[int] = (1, 5, 10, 20, 50), hard_at: int = 5) -> dict[str, DataFrame]:
    """recall (list, k, recall), counts (n_questions, n_scored, n_yes_no, share_hard), signals (a summary of each raw signal, over all, easy and hard questions, with
    the share of its most common value and its AUC for hard ones) and correlations (pair, pearson, spearman).

    questions: qid, question, answers, vector; passages: doc_id, text; vectors: doc_id, embedding.  Yes-or-no questions can't be looked up in a
    passage: they are counted, and left out of all else.  A question is hard if no passage among the fused list's first hard_at holds an answer."""
    marked = questions.withColumn("yes_no", F.coalesce(is_yes_no(F.col("answers")), F.lit(False)))
    asked = marked.filter(~F.col("yes_no"))
    lists = retrieval.hybrid(asked, passages if index is None else index, vectors)
    hits = written(list_hits(lists, passages, asked), "hits")
    first = hits.groupBy("list", "qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    recall = first.groupBy("list").agg(F.array(*[F.struct(F.lit(k).alias("k"), F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias("recall")) for k in ks]).alias("r")).select("list", F.explode("r").alias("r")).select("list", "r.k", "r.recall")
    hard = first.filter("list = 'fused'").select("qid", (~F.coalesce(F.col("first") <= hard_at, F.lit(False))).alias("hard"))
    raw = signals.compute(lists["lexical"], lists["dense"], lists["fused"], lists["fused"].filter("rank <= 10").join(vectors, "doc_id"))
    raw = written(raw.join(hard, "qid"), "raw-signals")
    counts = marked.agg(F.count("*").alias("n_questions"), F.count_if(~F.col("yes_no")).alias("n_scored"), F.count_if("yes_no").alias("n_yes_no")).crossJoin(F.broadcast(raw.agg(F.avg(F.col("hard").cast("double")).alias("share_hard"))))  # a row each
    long = raw.select("qid", "hard", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS])).alias("x")).select("qid", "hard", "x.*")
    summary = audits.signal_summary(long, ["signal"], hard="hard").join(evaluation.modal_share(long, "value", ["signal"]), "signal")
    summary = summary.join(evaluation.auc(long.filter("value is not null"), "value", "hard", ["signal"]), "signal", "left")
    return {"recall": recall, "counts": counts, "signals": summary, "correlations": evaluation.correlations(raw, list(SIGNALS))}
