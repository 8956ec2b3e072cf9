"""Phases: tables that later phases join, resumed by key, with models as injected functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.config import POOL, TOP_N
from waymark.functions.text import PARAPHRASE_LABELS, answer_message, exact_match, f1_score, final_answer, first_line, followup_message, paraphrase_message, reason_message, rewrite_message, rewrite_usable
from waymark.operators.clusters import screen
from waymark.operators.retrieval import hybrid, rerank, second_hop
from waymark.sources.writers import todo


def memoise(calls: DataFrame, key: str, order: str, values: dict[str, str]) -> DataFrame:
    """calls with the first call's values of each key, and whether a call is a repeat."""
    w = Window.partitionBy(key).orderBy(order)
    return calls.select("*", *[F.first(c).over(w).alias(name) for name, c in values.items()], (F.row_number().over(w) > 1).alias("reused"))


def call_model(rows: DataFrame, key: str, prompt: str, model: Callable[[list[str]], Iterable[dict]], schema: str, batch: int = 32) -> DataFrame:
    """rows with a model's reply to each distinct prompt.  model takes a batch of prompts and gives a dict of schema's
    columns for each; it runs once a distinct prompt, wherever Spark puts it."""

    def replies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                own = frame.iloc[at : at + batch]
                yield pd.concat([own[["prompt_key"]].reset_index(drop=True), pd.DataFrame(list(model(own["prompt"].tolist())))], axis=1)

    keyed = rows.withColumn("prompt_key", F.sha2(F.col(prompt), 256))
    distinct = keyed.select("prompt_key", F.col(prompt).alias("prompt")).dropDuplicates(["prompt_key"])
    return keyed.join(distinct.mapInPandas(replies, f"prompt_key string, {schema}"), "prompt_key")


def run_phase(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The phase's table at path, after the rows that it lacks were worked on and added.  A run that broke off is taken up again."""
    try:
        done = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    rest = rows if done is None else todo(rows, done, keys)
    work(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def selection(pool: DataFrame, ce: Callable[[Column, Column], Column], n: int, top: int = TOP_N) -> DataFrame:
    """(qid, doc_ids): the first n of a pool (question, text columns) in the order of a scoring function, cut at top."""
    scored = pool.filter(F.col("rank") <= n).withColumn("ce", ce(F.col("question"), F.col("text")))
    ranked = rerank(scored, n=top)
    return ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("new_rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))


def escalate(first: DataFrame, followups: DataFrame, second: DataFrame) -> DataFrame:
    """The dearer action's context of every question: of first (qid, question, doc_ids), usable followups (qid, followup) and
    second (qid, ranked).  Without a usable followup or a second pool it falls back on the first."""
    t = first.join(followups, "qid", "left").join(second, "qid", "left")
    usable = rewrite_usable(F.col("question"), F.col("followup")) & F.col("ranked").isNotNull()
    context, new = second_hop(F.col("doc_ids"), F.col("ranked"))
    return t.select("qid", (~usable).alias("fallback"), F.when(usable, context).otherwise(F.col("doc_ids")).alias("context"), F.when(usable, new).otherwise(0).alias("n_new"))


def outcomes(generations: DataFrame, answers: DataFrame, latencies: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """One row for each instance and action: em, f1, its latencies and their sum, and calls.

    generations: keys, action, answer, generation_latency; answers: keys, answers; latencies: keys, action,
    retrieval_latency, rerank_latency, followup_latency (null where the action has none).  A fallback still pays what it tried."""
    t = generations.join(answers, list(keys)).join(latencies, [*keys, "action"], "left")
    parts = ["retrieval_latency", "rerank_latency", "followup_latency", "generation_latency"]
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))
    return t.select(*keys, "action", exact_match(F.col("answer"), F.col("answers")).alias("em"), f1_score(F.col("answer"), F.col("answers")).alias("f1"), *parts, total.alias("latency_total"), (1 + F.col("followup_latency").isNotNull().cast("int")).alias("llm_calls"))


def candidates(questions: DataFrame, model: Callable[[list[str]], Iterable[dict]], n: int = 5, seed: int = 42, key: str = "cluster_id") -> DataFrame:
    """(key, question, answers, pos, seed, raw, text): n paraphrases of each question, with seeds from seed on.  model gets prompts that begin with their seed
    on a line of its own, and gives {"raw": reply} for each."""
    rows = questions.select(key, "question", "answers", F.posexplode(F.sequence(F.lit(seed), F.lit(seed + n - 1))).alias("pos", "seed"))
    asked = rows.withColumn("prompt", F.concat(F.col("seed").cast("string"), F.lit("\n"), paraphrase_message(F.col("question"))))
    got = call_model(asked, key, "prompt", model, "raw string")
    return got.select(key, "question", "answers", "pos", "seed", "raw", first_line(F.col("raw"), PARAPHRASE_LABELS).alias("text"))


def screen_all(rows: DataFrame, entails: Callable[[Column, Column], Column], cosine: Callable[[Column, Column], Column], key: str = "cluster_id") -> DataFrame:
    """clusters.screen of all candidates, with gates as column functions of two texts; entailment is asked for both ways."""
    q, t = F.col("question"), F.col("text")
    return screen(rows.withColumns({"entails": entails(q, t) & entails(t, q), "cosine": cosine(q, t)}), key=key)


def followups(first: DataFrame, model: Callable[[list[str]], Iterable[dict]], key: str = "qid") -> DataFrame:
    """(key, followup): a search query asked of each question and its first action's passages (title, text)."""
    asked = first.withColumn("prompt", followup_message(F.col("question"), F.col("passages")))
    return call_model(asked, key, "prompt", model, "raw string").select(key, first_line(F.col("raw")).alias("followup"))


def rewrites(questions: DataFrame, model: Callable[[list[str]], Iterable[dict]], key: str = "qid") -> DataFrame:
    """(key, rewrite, usable): each question as a search query; one that isn't usable leaves the question as it is."""
    asked = questions.withColumn("prompt", rewrite_message(F.col("question")))
    got = call_model(asked, key, "prompt", model, "raw string").withColumn("own", first_line(F.col("raw")))
    usable = rewrite_usable(F.col("question"), F.col("own"))
    return got.select(key, F.when(usable, F.col("own")).otherwise(F.col("question")).alias("rewrite"), usable.alias("usable"))


def retrieve(queries: DataFrame, passages: DataFrame, index: DataFrame, text: str, vector: str = "vector", query_id: str = "qid", pool: int = POOL) -> DataFrame:
    """The fused pool of queries that stand in a column of another name: a second hop's, or a rewrite's."""
    return hybrid(queries.select(query_id, F.col(text).alias("question"), F.col(vector).alias("vector")), passages, index, pool, query_id)["fused"]


def generations(contexts: DataFrame, model: Callable[[list[str]], Iterable[dict]], keys: Sequence[str] = ("qid", "action"), reason: bool = False) -> DataFrame:
    """(keys, answer): each context's (question, passages) answer, by its last line if the model is asked to reason."""
    prompt = reason_message if reason else answer_message
    asked = contexts.withColumn("prompt", prompt(F.col("question"), F.col("passages")))
    got = call_model(asked, keys[0], "prompt", model, "raw string")
    return got.select(*keys, (final_answer if reason else first_line)(F.col("raw")).alias("answer"))
