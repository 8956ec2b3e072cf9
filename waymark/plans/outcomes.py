"""From questions to the outcome table in one call: both generations of actions as graphs of phases.

Instances share questions, prompts and passages; each phase's key is what it works on (a question, a prompt), so nothing is
retrieved, re-ranked or asked twice, and a changed model, prompt or corpus does only what depends on it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import config as C
from waymark.functions.text import answer_message, exact_match, f1_score, final_answer, first_line, followup_message, prompt_passage, reason_message, rewrite_message, rewrite_usable
from waymark.operators.lexical import LexicalIndex
from waymark.operators.retrieval import hybrid, merge_pools, rerank
from waymark.plans.client import Policy, ask
from waymark.plans.graph import Done, Phase, Tables, run
from waymark.plans.pipeline import escalate

SCHEMA = "raw string, input_tokens long, output_tokens long, prompt_tps double"


@dataclass(frozen=True)
class Models:
    """What the library has no weights of: chat, one call from a prompt to a dict of SCHEMA's columns; encode, from a text column to its
    vector; cross, from question and passage to a score.  rerank_seconds: what scoring one passage takes, as the cost of a plan."""

    chat: Callable[[str], dict]
    encode: Callable[[Column], Column]
    cross: Callable[[Column, Column], Column]
    rerank_seconds: float = 0.0
    retrieval_seconds: float = 0.0


def _pools(questions: DataFrame, text: str, tables: Tables, index: DataFrame | LexicalIndex, encode: Callable[[Column], Column]) -> DataFrame:
    """(question, pool): the fused list of each question's text, as an array in the order of rank."""
    asked = questions.select(F.col("question").alias("q"), F.col(text).alias("question")).withColumn("vector", encode(F.col("question")))
    found = hybrid(asked, index, tables["vectors"], query_id="q")["fused"]
    own = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score")))
    return questions.select("question").join(found.groupBy(F.col("q").alias("question")).agg(own.alias("pool")), "question", "left")


def _ranked(pool: DataFrame, passages: DataFrame, cross: Callable[[Column, Column], Column], action: str, top: int) -> DataFrame:
    """(question, action, doc_ids, ce_passes): a pool (question, doc_id, rank) in the order of the cross-encoder."""
    scored = pool.join(passages.select("doc_id", "text"), "doc_id").withColumn("ce", cross(F.col("question"), F.col("text")))
    passes = scored.groupBy("question").agg(F.count("*").alias("ce_passes"))
    best = rerank(scored, n=top, by=("question",)).groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("new_rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    return best.join(passes, "question").select("question", F.lit(action).alias("action"), "doc_ids", "ce_passes")


def _distinct(t: Tables) -> DataFrame:
    return t["instances"].select("question").distinct()


def _retrieval(models: Models, index: DataFrame | LexicalIndex) -> Phase:
    return Phase("retrieval", ["question"], ["instances", "vectors"], _distinct, lambda rows, t: _pools(rows, "question", t, index, models.encode))


def _searching(models: Models, name: str, column: str, inputs: Callable[[Tables], DataFrame], needs: list[str], prompt: Callable[[DataFrame], Column], journal: str, policy: Policy) -> Phase:
    """A phase that asks for a search query for each question: (question, column, usable, and the call's error, seconds and tokens)."""

    def work(rows: DataFrame, t: Tables) -> DataFrame:
        got = ask(rows.withColumn("prompt", prompt(rows)), "prompt", models.chat, SCHEMA, f"{journal}/{name}", policy)
        own = got.withColumn(column, first_line(F.col("raw")))
        usable = F.coalesce(F.col("error").isNull() & rewrite_usable(F.col("question"), F.col(column)), F.lit(False))
        return own.select("question", column, usable.alias("usable"), "error", F.col("seconds").alias("asked_latency"), F.col("input_tokens").alias("asked_in"), F.col("output_tokens").alias("asked_out"))

    return Phase(name, ["question"], needs, inputs, work)


def _second(models: Models, index: DataFrame | LexicalIndex, asked: str, column: str) -> Phase:
    """The pool of each usable search query."""
    usable = lambda t: t[asked].filter("usable").select("question", column)
    return Phase("second_retrieval", ["question"], [asked, "vectors"], usable, lambda rows, t: _pools(rows, column, t, index, models.encode))


def _texts(chosen: DataFrame, passages: DataFrame, by: list[str]) -> DataFrame:
    """(by, passages): the passages of doc_ids in their order, as prompts take them."""
    flat = chosen.select(*by, F.posexplode("doc_ids").alias("at", "doc_id")).join(passages, "doc_id")
    own = F.transform(F.array_sort(F.collect_list(F.struct("at", "title", "text"))), lambda x: F.struct(F.coalesce(x["title"], F.lit("")).alias("title"), prompt_passage(F.coalesce(x["text"], F.lit(""))).alias("text")))
    return flat.groupBy(*by).agg(own.alias("passages"))


def _answers(models: Models, journal: str, policy: Policy, prompt: Callable[[Column, Column], Column], clean: Callable[[Column], Column]) -> Phase:
    """Each question's and action's answer from its chosen passages; equal prompts are one call."""

    def prompts(t: Tables) -> DataFrame:
        texts = _texts(t["selection"].select("question", "action", "doc_ids"), t["passages"], ["question", "action"])
        return texts.select("question", "action", prompt(F.col("question"), F.col("passages")).alias("prompt"))

    def work(rows: DataFrame, t: Tables) -> DataFrame:
        got = ask(rows, "prompt", models.chat, SCHEMA, f"{journal}/answers", policy)
        return got.select("question", "action", clean(F.col("raw")).alias("answer"), "error", "reused", F.col("seconds").alias("generation_latency"), F.col("input_tokens").alias("answer_in"), F.col("output_tokens").alias("answer_out"))

    return Phase("answers", ["question", "action"], ["selection", "passages"], prompts, work)


def _outcomes(models: Models, asked: str) -> Phase:
    """One row for each instance and action.  The dearer action pays for its query and, unless it fell back, for a second search."""

    def joined(t: Tables) -> DataFrame:
        own = t["instances"].join(t["selection"].select("question", "action", "ce_passes", "fallback"), "question")
        own = own.join(t["answers"].drop("reused"), ["question", "action"], "left")
        return own.join(t[asked].select("question", "asked_latency", "asked_in", "asked_out"), "question", "left")

    def work(rows: DataFrame, t: Tables) -> DataFrame:
        dearer = F.col("action") == "A2"
        zero = lambda c: F.coalesce(c, F.lit(0))
        searches = F.when(dearer & ~F.col("fallback"), 2).otherwise(1)
        costs = {
            "retrieval_latency": searches * F.lit(models.retrieval_seconds),
            "rerank_latency": F.col("ce_passes") * F.lit(models.rerank_seconds),
            "asked_latency": F.when(dearer, F.coalesce("asked_latency", F.lit(0.0))).otherwise(0.0),
            "generation_latency": F.coalesce("generation_latency", F.lit(0.0)),
        }
        out = rows.withColumns(costs).withColumn("retrievals", searches).withColumn("llm_calls", 1 + dearer.cast("int"))
        tokens = {f"{way}put_tokens": zero(F.col(f"answer_{way}")) + zero(F.when(dearer, F.col(f"asked_{way}"))) for way in ("in", "out")}
        total = sum((F.col(c) for c in list(costs)[1:]), F.col("retrieval_latency"))
        said = F.coalesce("answer", F.lit(""))
        out = out.withColumns(tokens).withColumns({"latency_total": total, "em": exact_match(said, F.col("answers")), "f1": f1_score(said, F.col("answers"))})
        return out.select("cluster_id", "variant_id", "action", "answer", "em", "f1", "fallback", "error", *costs, "latency_total", "retrievals", "ce_passes", "llm_calls", *tokens)

    return Phase("outcomes", ["cluster_id", "variant_id", "action"], ["instances", "selection", "answers", asked], joined, work)


def _flat(rows: DataFrame, column: str) -> DataFrame:
    """(question, doc_id, score, rank) of a column of pools."""
    return rows.select("question", F.posexplode(column).alias("at", "p")).select("question", "p.doc_id", "p.score", (F.col("at") + 1).alias("rank"))


def phases(models: Models, index: DataFrame | LexicalIndex, journal: str, policy: Policy = Policy(), top: int = C.TOP_N, first: int = C.A1_RERANK, second: int = C.A2_RERANK) -> list[Phase]:
    """The three actions: the fused list, the re-ranked list, and the re-ranked union with what a rewritten question finds.

    Sources: instances (cluster_id, variant_id, question, answers), passages (doc_id, title, text) and vectors (doc_id, embedding);
    index: passages, or their kept lexical index."""

    def pools(t: Tables) -> DataFrame:
        return t["retrieval"].join(t["second_retrieval"].select("question", F.col("pool").alias("more")), "question", "left")

    def selection(rows: DataFrame, t: Tables) -> DataFrame:
        own = _flat(rows, "pool")
        a0 = rows.select("question", F.lit("A0").alias("action"), F.slice("pool.doc_id", 1, top).alias("doc_ids"), F.lit(0).cast("long").alias("ce_passes"))
        a1 = _ranked(own.filter(F.col("rank") <= first), t["passages"], models.cross, "A1", top)
        wider = rows.filter("more is not null").select("question").join(own, "question")
        a2 = _ranked(merge_pools(wider, _flat(rows, "more"), second, "question"), t["passages"], models.cross, "A2", top)
        fallback = a1.join(a2.select("question"), "question", "left_anti").withColumns({"action": F.lit("A2"), "ce_passes": F.lit(0).cast("long")})
        out = a0.unionByName(a1).unionByName(a2).withColumn("fallback", F.lit(False))
        return out.unionByName(fallback.withColumn("fallback", F.lit(True)))

    return [
        _retrieval(models, index),
        _searching(models, "rewrites", "rewrite", _distinct, ["instances"], lambda rows: rewrite_message(F.col("question")), journal, policy),
        _second(models, index, "rewrites", "rewrite"),
        Phase("selection", ["question"], ["retrieval", "second_retrieval", "passages"], pools, selection),
        _answers(models, journal, policy, answer_message, first_line),
        _outcomes(models, "rewrites"),
    ]


def escalation_phases(models: Models, index: DataFrame | LexicalIndex, journal: str, policy: Policy = Policy(), top: int = C.TOP_N, first: int = C.A1_RERANK, reason: bool = False) -> list[Phase]:
    """The two actions: the re-ranked list, and a second hop by a follow-up query that the model asks after it has read the first hop's
    passages.  The second hop keeps the first ones and takes in the best new ones (retrieval.second_hop); without a usable query it
    falls back on the first hop, but has paid for the query.  reason: answers come with their reasoning, of which the last line counts."""

    def one(rows: DataFrame, t: Tables) -> DataFrame:
        return _ranked(_flat(rows, "pool").filter(F.col("rank") <= first), t["passages"], models.cross, "A1", top).drop("action")

    def read(t: Tables) -> DataFrame:
        return _texts(t["first"].select("question", "doc_ids"), t["passages"], ["question"])

    def pools(t: Tables) -> DataFrame:
        return t["first"].join(t["followups"].select("question", "followup"), "question", "left").join(t["second_retrieval"].select("question", "pool"), "question", "left")

    def selection(rows: DataFrame, t: Tables) -> DataFrame:
        own = rows.select("question", "doc_ids", F.col("ce_passes").alias("own_passes"), F.col("question").alias("qid"))
        more = _ranked(_flat(rows.filter("pool is not null"), "pool").filter(F.col("rank") <= first), t["passages"], models.cross, "A2", first)
        more = more.select(F.col("question").alias("qid"), F.col("doc_ids").alias("ranked"), F.col("ce_passes").alias("more_passes"))
        hop = escalate(own.select("qid", "question", "doc_ids"), rows.select(F.col("question").alias("qid"), "followup"), more.select("qid", "ranked"))
        a2 = own.join(hop, "qid").join(more.select("qid", "more_passes"), "qid", "left")
        a2 = a2.select("question", F.lit("A2").alias("action"), F.col("context").alias("doc_ids"), (F.col("own_passes") + F.coalesce("more_passes", F.lit(0))).alias("ce_passes"), "fallback", "n_new")
        a1 = rows.select("question", F.lit("A1").alias("action"), "doc_ids", "ce_passes", F.lit(False).alias("fallback"), F.lit(0).alias("n_new"))
        return a1.unionByName(a2)

    return [
        _retrieval(models, index),
        Phase("first", ["question"], ["retrieval", "passages"], lambda t: t["retrieval"].filter("pool is not null"), one),
        _searching(models, "followups", "followup", read, ["first", "passages"], lambda rows: followup_message(F.col("question"), F.col("passages")), journal, policy),
        _second(models, index, "followups", "followup"),
        Phase("selection", ["question"], ["first", "followups", "second_retrieval", "passages"], pools, selection),
        _answers(models, journal, policy, reason_message if reason else answer_message, final_answer if reason else first_line),
        _outcomes(models, "followups"),
    ]


def outcome_table(instances: DataFrame, passages: DataFrame, vectors: DataFrame, models: Models, root: str, index: DataFrame | LexicalIndex | None = None, policy: Policy = Policy(), until: str | None = None, made: Callable[..., list[Phase]] = phases) -> tuple[dict[str, DataFrame], list[Done]]:
    """All phases' tables below root, the last of them outcomes: one row for each instance and action; and what this call had to do.
    made: phases (three actions) or escalation_phases (two).

    A question whose search query failed or says nothing new takes the first action's passages (fallback) and still pays for the query; one
    that finds nothing has no row for the actions that re-rank.  A failed answer is empty, with its error."""
    own = made(models, index if index is not None else passages, f"{root.rstrip('/')}/journal", policy)
    return run(own, {"instances": instances, "passages": passages, "vectors": vectors}, root, until)


def fallback_report(outcomes: DataFrame) -> DataFrame:
    """(action, n, fallbacks, failed, reranked, latency): how often each action fell back or failed, and its mean time."""
    return outcomes.groupBy("action").agg(F.count("*").alias("n"), F.count_if("fallback").alias("fallbacks"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("ce_passes").alias("reranked"), F.avg("latency_total").alias("latency"))
