"""Registered queries of the routing engine and their SQL twins, over the tables at hand."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import config as C
from waymark.functions import fuzzy, text, vectors
from waymark.operators import audits, baselines, clusters, diagnostics, evaluation, integrity, retrieval, routing, signals
from waymark.plans import client, evaluate, outcomes, smoke
from waymark.plans import standins as st
from waymark.plans.standins import SIGNALS, with_sql
from waymark.sources import readers, shards, tables, writers
from waymark.streaming import guard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ACTIONS = C.V3.actions
KEYS = ["dataset", "split", "cluster_id", "variant_id"]


def query(sql: str = "", needs: Sequence[str] = ()):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_sql(sql, *needs) if needs else sql
        return f

    return register


def r(c: str, digits: int = 6):
    """A double of a few digits: engines add up in different orders."""
    return (F.round(c, digits) + 0.0).alias(c)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def _scaled(spark, sf):
    inst = st.instances(spark, sf)
    scalers = signals.fit_scaler(inst.filter("split = 'train'"), SIGNALS)
    return signals.apply_scaler(inst.drop("event_id"), scalers, SIGNALS)


def _table(spark, sf):
    rows = st.outcome_rows(st.instances(spark, sf))
    return routing.outcome_table(rows, ACTIONS, cost=["retrieval", "generation"], keep=["dataset", "split"])


def _routed(spark, sf):
    t = _table(spark, sf).join(_scaled(spark, sf), KEYS)
    score = (F.col("S1") + F.col("S2") + F.col("S3") + F.col("S4")) / 4.0
    return t.withColumn("score", score).withColumn("action_index", routing.action_index(F.col("score"), [0.4, 0.6]))


# Calibration

@query("""+ d AS (SELECT a.dataset, a.signal, abs(a.s - b.s) AS d FROM slong a JOIN slong b USING (dataset, cluster_id, signal) JOIN complete USING (cluster_id)
          WHERE a.split = 'train' AND a.variant_id < b.variant_id),
        j AS (SELECT dataset, signal, quantile_cont(d, 0.75::DOUBLE) AS jitter, quantile_cont(d, 0.5::DOUBLE) AS jitter_median FROM d GROUP BY 1, 2)
        SELECT dataset, signal, round(p5, 6) AS p5, round(p95, 6) AS p95, round(jitter, 6) AS jitter, round(jitter_median, 6) AS jitter_median,
          round(least(0.25::DOUBLE, greatest(0.2::DOUBLE, jitter)), 6) AS width, round(least(0.25::DOUBLE, greatest(0.2::DOUBLE, jitter_median)), 6) AS width_median,
          jitter <= 0.2 AS at_floor, jitter > 0.25 AS capped, bool_and(jitter <= 0.2) OVER (PARTITION BY dataset) AS all_at_floor
        FROM j JOIN scalers USING (dataset, signal)""", ["slong", "complete"])
def stage1_calibration(spark, sf):
    """Scalers of the train split and the widths that the train clusters' jitter asks for."""
    inst = st.instances(spark, sf)
    train = inst.filter("split = 'train'")
    scalers = signals.fit_scaler(train, SIGNALS)
    widths = signals.jitter_widths(signals.apply_scaler(train, scalers, SIGNALS), SIGNALS)
    return rounded(scalers.join(widths, ["dataset", "signal"]), "p5", "p95", "jitter", "jitter_median", "width", "width_median")


@query("SELECT dataset, split, cluster_id, variant_id, round(S1, 6) AS S1, round(S2, 6) AS S2, round(S3, 6) AS S3, round(S4, 6) AS S4 FROM scaled", ["scaled"])
def scaled_signals(spark, sf):
    return rounded(_scaled(spark, sf).select(*KEYS, *SIGNALS), *SIGNALS)


@query("SELECT dataset, signal, round(avg(CAST(raw < 0 OR raw > 1 AS DOUBLE)), 6) AS clipped FROM slong GROUP BY 1, 2", ["slong"])
def clipped_share(spark, sf):
    inst = st.instances(spark, sf)
    scalers = signals.fit_scaler(inst.filter("split = 'train'"), SIGNALS)
    return rounded(signals.clipped_share(signals.apply_scaler(inst, scalers, SIGNALS, raw=True), SIGNALS), "clipped")


@query("""+ h AS (SELECT DISTINCT dataset, cluster_id, CAST('0x' || substr(md5('42:' || cluster_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM inst)
        SELECT dataset, CASE WHEN u < 1::DOUBLE - 0.2::DOUBLE - 0.2::DOUBLE THEN 'train' WHEN u < 1::DOUBLE - 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM h GROUP BY 1, 2""", ["inst"])
def split_hashed(spark, sf):
    ids = st.instances(spark, sf).select("dataset", "cluster_id").distinct()
    return clusters.split_hashed(ids).groupBy("dataset", "split").agg(F.count("*").alias("n"))


@query("SELECT dataset, split, count(*) AS n, CAST(count_if(n = 3) AS BIGINT) AS complete FROM (SELECT dataset, split, cluster_id, count(*) AS n FROM inst GROUP BY 1, 2, 3) GROUP BY 1, 2", ["inst"])
def complete_clusters(spark, sf):
    inst = st.instances(spark, sf)
    whole = signals.complete_clusters(inst).select("cluster_id").distinct().withColumn("whole", F.lit(True))
    all_ = inst.select("dataset", "split", "cluster_id").distinct().join(whole, "cluster_id", "left")
    return all_.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.count("whole").alias("complete"))


# Retrieval

@query("SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm", ["bm"])
def bm25_top50(spark, sf):
    found = retrieval.bm25(st.questions(spark, sf), st.passages(spark, sf))
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("long"))


@query("""WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
        SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 50""")
def dense_top50(spark, sf):
    """Searches for every 50th vector among all of them."""
    index = st.index(spark, sf)
    q = index.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"))
    return rounded(retrieval.dense(q, index), "score").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT qid, doc_id, round(score, 6) AS score, rank FROM fu", ["fu"])
def fused_pool(spark, sf):
    lists = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))
    return rounded(lists["fused"], "score").withColumn("rank", F.col("rank").cast("long"))


@query("""+ best AS (SELECT qid, doc_id, max(score) AS score FROM (SELECT qid, doc_id, score FROM bm UNION ALL SELECT qid, doc_id, score FROM dn) GROUP BY 1, 2),
        m AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM best WINDOW w AS (PARTITION BY qid))
        SELECT qid, doc_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM m) WHERE rank <= 30""", ["bm", "dn"])
def merged_pool(spark, sf):
    """Two pools of each question as one, each passage with its better score."""
    q, d, i = st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf)
    found = retrieval.merge_pools(retrieval.bm25(q, d), retrieval.dense(q, i), k=30)
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("long"))


@query("""+ s1 AS (SELECT qid, 1.0::DOUBLE - (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2)) / (max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10) + 1e-9::DOUBLE) AS S1 FROM fu GROUP BY 1),
        dep AS (SELECT qid, d, (SELECT count(*) FROM bm x JOIN dn y USING (qid, doc_id) WHERE x.qid = qs.qid AND greatest(x.rank, y.rank) <= d) AS n FROM (SELECT qid FROM questions) qs, range(1, 11) t(d)),
        s2 AS (SELECT qid, 1.0::DOUBLE - (pow(0.9::DOUBLE, 10) * max(n) FILTER (d = 10) / 10 + 0.1::DOUBLE * sum(pow(0.9::DOUBLE, d - 1) * n / d)) AS S2 FROM dep GROUP BY 1),
        ten AS (SELECT qid, rank, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM fu JOIN embeddings ON vec_id = doc_id WHERE rank <= 10),
        nrm AS (SELECT qid, rank, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-9::DOUBLE)) AS v FROM ten),
        s3 AS (SELECT a.qid, 1.0::DOUBLE - avg(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))) AS S3, count(*) AS np FROM nrm a JOIN nrm b ON a.qid = b.qid AND a.rank < b.rank GROUP BY 1),
        e AS (SELECT qid, exp((score - max(score) OVER (PARTITION BY qid)) / 0.1::DOUBLE) AS e FROM fu WHERE rank <= 10), p AS (SELECT qid, e / sum(e) OVER (PARTITION BY qid) AS p FROM e),
        s4 AS (SELECT qid, -sum(p * ln(p + 1e-9::DOUBLE)) / ln(10.0::DOUBLE) AS S4 FROM p GROUP BY 1)
        SELECT qid, round(S1, 6) AS S1, round(S2, 6) AS S2, CASE WHEN np = 45 THEN round(S3, 6) END AS S3, round(S4, 6) AS S4 FROM s1 JOIN s2 USING (qid) JOIN s3 USING (qid) JOIN s4 USING (qid)""", ["fu"])
def retrieval_signals(spark, sf):
    """S1 to S4 of every question."""
    index = st.index(spark, sf)
    lists = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), index)
    fused = lists["fused"]
    vecs = fused.filter("rank <= 10").join(index, "doc_id")
    return rounded(signals.compute(lists["lexical"], lists["dense"], fused, vecs, whole=False), *SIGNALS)


@query("""+ h AS (SELECT qid, rank, ' ' || array_to_string(list_transform(regexp_extract_all(d.text, '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'), lambda t: lower(t)), ' ') || ' ' AS body,
          array_to_string(list_transform(regexp_extract_all(answers[1], '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'), lambda t: lower(t)), ' ') AS a FROM bm JOIN documents d USING (doc_id) JOIN questions USING (qid)),
        f AS (SELECT qid, min(rank) FILTER (a <> '' AND contains(body, ' ' || a || ' ')) AS first FROM h GROUP BY 1)
        SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(coalesce(first <= k, false) AS DOUBLE)), 6) AS recall FROM f, (VALUES (1), (5), (10), (20), (50)) v(k) GROUP BY 1""", ["bm"])
def recall_at_k(spark, sf):
    """Share of questions of which a passage among the first k holds the answer."""
    q, d = st.questions(spark, sf), st.passages(spark, sf)
    return rounded(retrieval.recall_at(retrieval.hits(retrieval.bm25(q, d), d, q)), "recall")


@query("""+ x AS (SELECT q.qid, (SELECT count(*) FROM bm JOIN dn USING (qid, doc_id) WHERE bm.qid = q.qid AND bm.rank <= 10 AND dn.rank <= 10) AS n FROM questions q)
        SELECT round(avg(n), 6) AS mean_overlap, round(avg(CAST(n = 0 AS DOUBLE)), 6) AS none_share FROM x""", ["bm", "dn"])
def pool_overlap(spark, sf):
    lists = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))
    return rounded(retrieval.overlap(lists["lexical"], lists["dense"]), "mean_overlap", "none_share")


@query("""+ ce AS (SELECT qid, doc_id, rank, (doc_id * 7919 + qid * 31) % 17 / 17.0::DOUBLE AS ce FROM fu WHERE rank <= 20)
        SELECT qid, doc_id, rank, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ce DESC, rank) AS new_rank FROM ce) WHERE new_rank <= 5""", ["fu"])
def reranked(spark, sf):
    """The first five of a pool's twenty by a stand-in cross-encoder."""
    pool = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))["fused"].filter("rank <= 20")
    scored = pool.withColumn("ce", (F.col("doc_id") * 7919 + F.col("qid") * 31) % 17 / F.lit(17.0))
    out = retrieval.rerank(scored, n=5)
    return out.select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


@query("""+ a AS (SELECT qid, list(doc_id ORDER BY rank) AS a FROM bm WHERE rank <= 5 GROUP BY 1), b AS (SELECT qid, list(doc_id ORDER BY rank) AS b FROM dn GROUP BY 1),
        f AS (SELECT qid, a, list_filter(b, lambda x: NOT list_contains(a, x))[1:2] AS f FROM a JOIN b USING (qid))
        SELECT qid, array_to_string((list_concat(list_concat(a[1:3], f), a[4:5]))[1:5], ' ') AS context, CAST(len(f) AS INTEGER) AS n_new FROM f""", ["bm", "dn"])
def second_hop_context(spark, sf):
    lists = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))
    ids = lambda df, name: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    both = ids(lists["lexical"].filter("rank <= 5"), "a").join(ids(lists["dense"], "b"), "qid")
    context, new = retrieval.second_hop(F.col("a"), F.col("b"))
    return both.select("qid", F.array_join(context.cast("array<string>"), " ").alias("context"), new.alias("n_new"))


@query("""SELECT (SELECT count(*) FROM (SELECT vec_id - lag(vec_id) OVER (ORDER BY vec_id) AS d FROM embeddings) WHERE d <> 1) AS gaps,
        (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS odd, (SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY 1 HAVING count(*) > 1)) AS twice""")
def index_checks(spark, sf):
    """Gaps in the ids, vectors of another length, and ids that come twice."""
    index = st.index(spark, sf)
    gaps = readers.check_consecutive(index, "doc_id").agg(F.count("*").alias("gaps"))
    twice = index.groupBy("doc_id").count().filter("count > 1").agg(F.count("*").alias("twice"))
    return gaps.crossJoin(index.agg(F.count_if(F.size("embedding") != 64).alias("odd"))).crossJoin(twice)


@query("""WITH p AS (SELECT a.vec_id, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS ab, sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS na, sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT round(min(ab / (na * nb)), 6) AS cos_min, round(quantile_cont(ab / (na * nb), 0.01::DOUBLE), 6) AS cos_p1, round(quantile_cont(ab / (na * nb), 0.5::DOUBLE), 6) AS cos_median, round(avg(ab / (na * nb)), 6) AS cos_mean, min(ab / (na * nb)) >= 0.999 AS passed FROM p""")
def embedding_spot_check(spark, sf):
    """Cosines of each vector and the next."""
    i = st.index(spark, sf)
    nxt = i.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("b"))
    return rounded(diagnostics.spot_check(i.select("doc_id", F.col("embedding").alias("a")).join(nxt, "doc_id")), "cos_min", "cos_p1", "cos_median", "cos_mean")


@query("""WITH w AS (SELECT c.doc_id, d.text, d.source FROM (SELECT DISTINCT doc_id FROM labels) c JOIN documents d USING (doc_id))
        SELECT doc_id, source || ' ' || text AS passage FROM w""")
def passage_lookup(spark, sf):
    """The passages of wanted ids; a missing one is an error."""
    own = st.passages(spark, sf).withColumnRenamed("doc_id", "id")
    ids = st.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    return readers.load_passages(own, ids).select(F.col("id").alias("doc_id"), text.passage_text(F.col("title"), F.col("text")).alias("passage"))


# Text

def _turns(spark, sf):
    """Each turn with the one before it: a reply and what it is compared with."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return st.table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("gold")).filter("gold is not null")


_NORM = "list_filter(regexp_split_to_array(trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
        n AS (SELECT conv_id, turn, {_NORM.format('text')} AS p, {_NORM.format('gold')} AS g FROM t WHERE gold IS NOT NULL),
        s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same FROM n)
        SELECT conv_id, turn, CASE WHEN array_to_string(p, ' ') = array_to_string(g, ' ') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
          round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS DOUBLE) ELSE 2.0::DOUBLE * same / (len(p) + len(g)) END, 6) AS f1 FROM s""")
def answer_quality(spark, sf):
    """Exact match and token F1 of every turn against the turn before."""
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", text.exact_match(F.col("text"), F.array("gold")).alias("em"), F.round(text.f1_score(F.col("text"), F.array("gold")), 6).alias("f1"))


@query(r"""WITH q AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
        b AS (SELECT *, list_transform(w, lambda x: lower(regexp_replace(regexp_replace(x, '^[?,.!"''():;]+', ''), '[?,.!"''():;]+$', ''))) AS b FROM q)
        SELECT item_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_filter(w[2:], lambda x: regexp_matches(x, '^\p{Lu}'))) AS INTEGER) AS n_capitals, CAST(regexp_matches(text, '\d') AS INTEGER) AS has_digit,
          CAST(coalesce(list_filter(b, lambda x: x IN ('who','what','when','where','which','how','why'))[1], 'other') = 'other' AS INTEGER) AS wh_other,
          CAST(len(list_filter(b, lambda x: x IN ('and','both','or','than','same','also','older','younger','earlier','later','first','more','less'))) AS INTEGER) AS n_cues FROM b""")
def query_features(spark, sf):
    f = text.query_features(F.col("text"))
    return st.table(spark, sf, "benchmark").select("item_id", *[f[c].alias(c) for c in ("n_words", "n_capitals", "has_digit", "wh_other", "n_cues")])


@query(r"""SELECT conv_id, turn, trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1]) AS line,
        trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-1]) AS last,
        array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:200], ' ') AS prompt FROM conversations""")
def reply_cleaning(spark, sf):
    """First line, last answer and the first 200 words of every turn."""
    c = st.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", text.first_line(F.col("text")).alias("line"), text.final_answer(F.col("text")).alias("last"), text.prompt_passage(F.col("text")).alias("prompt"))


@query("""+ f AS (SELECT qid, string_agg('Passage ' || rank || ' (' || source || '): ' || text, chr(10) || chr(10) ORDER BY rank) AS body FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1)
        SELECT qid, md5('Answer the question.' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:') AS prompt_md5 FROM f JOIN questions USING (qid)""", ["bm"])
def prompts(spark, sf):
    """Each question's prompt over its first five passages, as a digest."""
    q, d = st.questions(spark, sf), st.passages(spark, sf)
    own = retrieval.bm25(q, d).filter("rank <= 5").join(d, "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("p"))
    return own.join(q, "qid").select("qid", F.md5(text.message("Answer the question.", F.col("question"), F.col("p"), "\nAnswer:")).alias("prompt_md5"))


def _candidates(spark, sf):
    c = st.table(spark, sf, "conversations")
    first = c.filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    gates = [((F.col("conv_id") + F.col("turn")) % 5 != 0).alias("entails"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 100 / F.lit(100.0)).alias("cosine")]
    answer = F.array(F.get(F.split("question", r"\s+"), 1)).alias("answers")
    return c.filter("turn > 0").join(first, "conv_id").select("conv_id", "turn", "text", "question", answer, *gates)


_SCREEN = r"""WITH c AS (SELECT c.conv_id, c.turn, c.text, f.text AS question, (c.conv_id + c.turn) % 5 <> 0 AS entails, (c.conv_id * 7 + c.turn * 13) % 100 / 100.0::DOUBLE AS cosine FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0 WHERE c.turn > 0),
        n AS (SELECT *, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+'), lambda x: lower(x)), lambda x: regexp_matches(x, '^[\p{L}\p{N}]+$')), ' ') AS k,
          array_to_string(list_filter(list_transform(regexp_extract_all(question, '[\p{L}\p{N}\p{M}]+'), lambda x: lower(x)), lambda x: regexp_matches(x, '^[\p{L}\p{N}]+$')), ' ') AS kq,
          ' ' || array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)), ' ') || ' ' AS tt, ' ' || array_to_string(list_transform(regexp_extract_all(question, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)), ' ') || ' ' AS tq,
          array_to_string(list_transform(regexp_extract_all(coalesce(regexp_split_to_array(question, '\s+')[2], ''), '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)), ' ') AS a FROM c),
        s AS (SELECT conv_id, turn, CASE WHEN text = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) > 1 OR k = kq THEN 'duplicate' WHEN NOT entails THEN 'nli' WHEN cosine < 0.75 THEN 'cosine'
          WHEN a <> '' AND contains(tt, ' ' || a || ' ') AND NOT contains(tq, ' ' || a || ' ') THEN 'answer' END AS reason FROM n)
        """


@query(_SCREEN + "SELECT conv_id, turn, reason, reason IS NULL AS passed FROM s")
def screening(spark, sf):
    """Later turns as paraphrase candidates of the first."""
    return clusters.screen(_candidates(spark, sf), key="conv_id", pos="turn").select("conv_id", "turn", "reason", "passed")


@query(_SCREEN + """SELECT coalesce(reason, 'pass') AS what, count(*) AS n FROM s GROUP BY 1 UNION ALL
        SELECT CASE WHEN k >= 2 THEN 'complete' ELSE 'incomplete' END, count(*) FROM (SELECT conv_id, count(*) FILTER (reason IS NULL) AS k FROM s GROUP BY 1) GROUP BY 1""")
def screening_report(spark, sf):
    return clusters.build_report(clusters.screen(_candidates(spark, sf), key="conv_id", pos="turn"), key="conv_id")


@query(_SCREEN + "SELECT conv_id, turn, pick FROM (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pick FROM s WHERE reason IS NULL) WHERE pick <= 2")
def selected_paraphrases(spark, sf):
    return clusters.select_passing(clusters.screen(_candidates(spark, sf), key="conv_id", pos="turn"), key="conv_id", pos="turn").select("conv_id", "turn", "pick")


@query(r"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations)
        SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) <> '' AND lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) <> lower(trim(regexp_replace(gold, '\s+', ' ', 'g'))) AS usable,
          regexp_matches(lower(text), 'not specified|not mentioned|no answer|no information|not provided|unknown|not stated|cannot') AS abstains, list_distinct([lower(text), 'yes']) = ['yes'] AS yes_no FROM t WHERE gold IS NOT NULL""")
def reply_checks(spark, sf):
    """Whether a turn is usable as a rewrite of the one before, abstains, or is a yes."""
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", text.rewrite_usable(F.col("gold"), F.col("text")).alias("usable"), F.lower("text").rlike("|".join(text.ABSTENTIONS)).alias("abstains"), text.is_yes_no(F.array(F.col("text"), F.lit("yes"))).alias("yes_no"))


# The controller

def _fuzzy(spark, sf, profile=C.V3, **operators):
    out = fuzzy.escalation(_scaled(spark, sf), profile.signals, 0.2, **operators)
    return rounded(out.select(*KEYS, "score"), "score")


def _mu(s: str) -> str:
    """Degrees of one signal with the floor's width, as SQL."""
    lo, hi = "(0.35::DOUBLE + 0.1::DOUBLE)", "(0.65::DOUBLE + 0.1::DOUBLE)"
    a, b = "(0.35::DOUBLE - 0.1::DOUBLE)", "(0.65::DOUBLE - 0.1::DOUBLE)"
    one = "greatest(0::DOUBLE, least(1::DOUBLE, {}))"
    return f"{one.format(f'({lo} - {s}) / ({lo} - {a})')} AS {s}0, {one.format(f'least(({s} - {a}) / ({lo} - {a}), ({hi} - {s}) / ({hi} - {b}))')} AS {s}1, {one.format(f'({s} - {b}) / ({hi} - {b})')} AS {s}2"


def _rules_sql(names: Sequence[str], tnorm: str) -> str:
    """Every rule's strength for every instance: the rules meet the degrees, one rule a row."""
    pick = [f"CASE k{i} WHEN 0 THEN {s}0 WHEN 1 THEN {s}1 ELSE {s}2 END" for i, s in enumerate(names)]
    strength = f"least({', '.join(pick)})" if tnorm == "min" else " * ".join(pick)
    axes = ", ".join(f"(SELECT unnest([0, 1, 2]) AS k{i})" for i in range(len(names)))
    total, n = " + ".join(f"k{i}" for i in range(len(names))), len(names)
    return f"""+ mu AS (SELECT dataset, split, cluster_id, variant_id, {', '.join(_mu(s) for s in names)} FROM scaled),
        st AS (SELECT dataset, split, cluster_id, variant_id, CASE WHEN {total} < {n} THEN 0 WHEN {total} = {n} THEN 1 ELSE 2 END AS o, {total} AS t, {strength} AS s FROM mu, {axes})"""


def _centroid_sql(names: Sequence[str], tnorm: str, digits: int = 6) -> str:
    return _rules_sql(names, tnorm) + """,
        cl AS (SELECT dataset, split, cluster_id, variant_id, max(s) FILTER (o = 0) AS lo, max(s) FILTER (o = 1) AS md, max(s) FILTER (o = 2) AS hi FROM st GROUP BY 1, 2, 3, 4),
        ax AS (SELECT i / 1000.0::DOUBLE AS y FROM range(1001) r(i)),
        se AS (SELECT y, greatest(0, least(1, (0.4::DOUBLE - y) / 0.4::DOUBLE)) AS a, greatest(0, least((y - 0.25::DOUBLE) / 0.25::DOUBLE, (0.75::DOUBLE - y) / 0.25::DOUBLE)) AS b, greatest(0, least(1, (y - 0.6::DOUBLE) / 0.4::DOUBLE)) AS c FROM ax),
        sc AS (SELECT lo, md, hi, sum(greatest(least(a, lo), least(b, md), least(c, hi)) * y) / sum(greatest(least(a, lo), least(b, md), least(c, hi))) AS score FROM (SELECT DISTINCT lo, md, hi FROM cl), se GROUP BY 1, 2, 3)
        SELECT dataset, split, cluster_id, variant_id, round(score, {digits}) AS score FROM cl JOIN sc USING (lo, md, hi)""".replace("{digits}", str(digits))


@query(_centroid_sql(C.V3.signals, "min"), ["scaled"])
def fuzzy_score(spark, sf):
    return _fuzzy(spark, sf)


@query(_centroid_sql(C.V4.signals, "min"), ["scaled"])
def fuzzy_score_v4(spark, sf):
    return _fuzzy(spark, sf, C.V4)


@query(_centroid_sql(C.V3.signals, "product"), ["scaled"])
def fuzzy_product(spark, sf):
    return _fuzzy(spark, sf, tnorm="product")


@query(_rules_sql(C.V3.signals, "min") + " SELECT dataset, split, cluster_id, variant_id, round(sum(s * CASE o WHEN 0 THEN 0.4::DOUBLE / 3 WHEN 1 THEN 0.5::DOUBLE ELSE 1 - 0.4::DOUBLE / 3 END) / sum(s), 6) AS score FROM st GROUP BY 1, 2, 3, 4", ["scaled"])
def fuzzy_sugeno(spark, sf):
    return _fuzzy(spark, sf, defuzz="sugeno")


@query(_rules_sql(C.V4.signals, "min") + """,
        fi AS (SELECT dataset, split, cluster_id, variant_id, list({'o': o, 's': s} ORDER BY t) FILTER (s > 0) AS f FROM st GROUP BY 1, 2, 3, 4),
        ax AS (SELECT i / 1000.0::DOUBLE AS y FROM range(1001) r(i)),
        se AS (SELECT y, [greatest(0, least(1, (0.4::DOUBLE - y) / 0.4::DOUBLE)), greatest(0, least((y - 0.25::DOUBLE) / 0.25::DOUBLE, (0.75::DOUBLE - y) / 0.25::DOUBLE)), greatest(0, least(1, (y - 0.6::DOUBLE) / 0.4::DOUBLE))] AS z FROM ax),
        ag AS (SELECT dataset, split, cluster_id, variant_id, y, 1 - list_product(list_transform(f, lambda r: 1 - least(z[r.o + 1], r.s))) AS h FROM fi, se)
        SELECT dataset, split, cluster_id, variant_id, round(sum(h * y) / sum(h), 6) AS score FROM ag GROUP BY 1, 2, 3, 4""", ["scaled"])
def fuzzy_probsum(spark, sf):
    """Every fired rule's clipped set, combined as probabilities, over the two-action signals."""
    return _fuzzy(spark, sf, C.V4, aggregation="probsum")


@query(_rules_sql(C.V3.signals, "min") + """,
        nr AS (SELECT *, row_number() OVER () AS x FROM st) SELECT CAST(o AS INTEGER) AS consequent, t, count(*) FILTER (s > 0) AS fired FROM nr GROUP BY 1, 2""", ["scaled"])
def rule_activations(spark, sf):
    """How many rules of each label sum fire."""
    per = fuzzy.activations(_scaled(spark, sf), SIGNALS, 0.2).withColumnRenamed("fired", "n")
    base = spark.createDataFrame([(i, t, o) for i, _, t, o in fuzzy.rule_base(4)], "rule_id int, t int, consequent int")
    return base.join(per, "rule_id", "left").groupBy("consequent", "t").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fired"))


@query("SELECT dataset, split, cluster_id, variant_id, round(0.25::DOUBLE * S1 + 0.5::DOUBLE * S2 + 0.25::DOUBLE * S4, 6) AS weighted, " + " + ".join(f"CAST({s} >= 0.35::DOUBLE AS INTEGER) + CAST({s} >= 0.65::DOUBLE AS INTEGER)" for s in SIGNALS) + " AS ordinal FROM scaled", ["scaled"])
def linear_scores(spark, sf):
    s = _scaled(spark, sf)
    return s.select(*KEYS, F.round(baselines.weighted(SIGNALS, (0.25, 0.5, 0.0, 0.25)), 6).alias("weighted"), baselines.ordinal(SIGNALS).alias("ordinal"))


# Outcomes and routing

@query("SELECT dataset, split, cluster_id, variant_id, q0, q1, q2, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM wide", ["wide"])
def outcome_table(spark, sf):
    t = _table(spark, sf)
    return rounded(t.select(*KEYS, *[F.col(f"{p}_{a}").alias(f"{p}{a[1]}") for p in "qc" for a in ACTIONS]), "c0", "c1", "c2")


@query("""+ k AS (SELECT DISTINCT cluster_id, variant_id FROM rows), g AS (SELECT cluster_id, variant_id, 'A' || a AS action FROM k, (VALUES (0), (1), (2), (3)) v(a))
        SELECT action, count(*) AS missing FROM g ANTI JOIN rows USING (cluster_id, variant_id, action) GROUP BY 1""", ["rows"])
def missing_outcomes(spark, sf):
    """Instances without a row of an action, with one action that none has."""
    rows = st.outcome_rows(st.instances(spark, sf))
    return routing.missing_outcomes(rows, [*ACTIONS, "A3"]).groupBy("action").agg(F.count("*").alias("missing"))


@query("SELECT dataset, split, 'A' || a AS action, round(avg(CASE a WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END), 6) AS quality, round(avg(CASE a WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END), 6) AS cost FROM wide, (VALUES (0), (1), (2)) v(a) GROUP BY 1, 2, 3", ["wide"])
def always_policies(spark, sf):
    return rounded(routing.always(_table(spark, sf), ACTIONS, ["dataset", "split"]), "quality", "cost")


@query("SELECT dataset, split, round(avg(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END), 6) AS quality, round(avg(CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END), 6) AS cost, count(*) FILTER (i = 0) AS n_A0, count(*) FILTER (i = 1) AS n_A1, count(*) FILTER (i = 2) AS n_A2 FROM routed GROUP BY 1, 2", ["routed"])
def policy_value(spark, sf):
    return rounded(routing.policy_value(_routed(spark, sf), F.col("action_index"), ACTIONS, ["dataset", "split"]), "quality", "cost")


_GRID3 = "g AS (SELECT a / 100.0::DOUBLE AS t1, b / 100.0::DOUBLE AS t2 FROM range(51) x(a), range(50, 101) y(b) WHERE a < b)"
_GRID2 = "g AS (SELECT a / 100.0::DOUBLE AS t1 FROM range(101) x(a))"
_VAL3 = "v AS (SELECT *, round((S1 + S2 + S3 + S4) / 4.0::DOUBLE, 9) AS score FROM wide JOIN scaled USING (dataset, split, cluster_id, variant_id) WHERE split = 'val')"
_GV3 = """gv AS (SELECT t1, t2, avg(CASE WHEN score >= t2 THEN q2 WHEN score >= t1 THEN q1 ELSE q0 END) AS quality, avg(CASE WHEN score >= t2 THEN c2 WHEN score >= t1 THEN c1 ELSE c0 END) AS cost,
          count(*) FILTER (score < t1) AS n_A0, count(*) FILTER (score >= t1 AND score < t2) AS n_A1, count(*) FILTER (score >= t2) AS n_A2 FROM v, g GROUP BY 1, 2)"""
_PICK3 = "SELECT t1, t2, round(quality, 6) AS quality, round(cost, 6) AS cost, n_A0, n_A1, n_A2, round((SELECT avg(c1) FROM v), 6) AS budget, count(*) OVER () AS n_feasible FROM gv WHERE cost <= (SELECT avg(c1) FROM v) + 1e-12 ORDER BY round(quality, 12) DESC, round(cost, 12), t1, t2 LIMIT 1"


def _validation(spark, sf):
    t = _table(spark, sf).join(_scaled(spark, sf), KEYS).filter("split = 'val'")
    return t.withColumn("score", F.round((F.col("S1") + F.col("S2") + F.col("S3") + F.col("S4")) / 4.0, 9))


def _fit3(spark, sf, values):
    v = _validation(spark, sf)
    grid = routing.pair_grid(spark)
    best = routing.select_thresholds(values(v, grid, "score", ACTIONS), routing.budget_of(v, ACTIONS, "middle"), ["t1", "t2"])
    return rounded(best, "quality", "cost", "budget")


@query(f"+ {_VAL3}, {_GRID3}, {_GV3} {_PICK3}", ["wide", "scaled"])
def threshold_search(spark, sf):
    """The best of 2,600 threshold pairs within the budget, by prefix sums."""
    return _fit3(spark, sf, routing.grid_values)


@query(f"+ {_VAL3}, {_GRID3}, {_GV3} {_PICK3}", ["wide", "scaled"])
def threshold_search_naive(spark, sf):
    """The same, every instance meeting every pair."""
    return _fit3(spark, sf, routing.grid_values_naive)


@query(f"""+ {_VAL3}, {_GRID2}, gv AS (SELECT t1, avg(CASE WHEN score >= t1 THEN q2 ELSE q1 END) AS quality, avg(CASE WHEN score >= t1 THEN c2 ELSE c1 END) AS cost, count(*) FILTER (score < t1) AS n_A1, count(*) FILTER (score >= t1) AS n_A2 FROM v, g GROUP BY 1)
        SELECT t1, round(quality, 6) AS quality, round(cost, 6) AS cost, n_A1, n_A2, round((SELECT (avg(c1) + avg(c2)) / 2 FROM v), 6) AS budget, count(*) OVER () AS n_feasible FROM gv
        WHERE cost <= (SELECT (avg(c1) + avg(c2)) / 2 FROM v) + 1e-12 ORDER BY round(quality, 12) DESC, round(cost, 12), t1 LIMIT 1""", ["wide", "scaled"])
def threshold_search_v4(spark, sf):
    """The best of 101 thresholds between two actions, under the midpoint budget."""
    v = _validation(spark, sf)
    values = routing.grid_values(v, routing.single_grid(spark), "score", C.V4.actions)
    return rounded(routing.select_thresholds(values, routing.budget_of(v, C.V4.actions, "midpoint"), ["t1"]), "quality", "cost", "budget")


@query(f"""+ {_VAL3}, {_GRID3}, {_GV3}, b AS (SELECT DISTINCT round(cost, 12) AS budget FROM gv)
        SELECT round(b.budget, 6) AS budget, round(x.quality, 6) AS quality, round(x.cost, 6) AS cost, x.t1, x.t2 FROM b, LATERAL (SELECT * FROM gv WHERE round(cost, 12) <= b.budget ORDER BY round(quality, 12) DESC, round(cost, 12), t1, t2 LIMIT 1) x""", ["wide", "scaled"])
def cost_frontier(spark, sf):
    """The best quality that each reachable cost buys."""
    v = _validation(spark, sf)
    values = routing.grid_values(v, routing.pair_grid(spark), "score", ACTIONS)
    return rounded(routing.frontier(values, ["t1", "t2"]), "budget", "quality", "cost")


@query(f"""+ {_VAL3}, {_GRID3}, w AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS weight_id, a / 4.0::DOUBLE AS w1, b / 4.0::DOUBLE AS w2, c / 4.0::DOUBLE AS w3, d / 4.0::DOUBLE AS w4 FROM range(5) p(a), range(5) q(b), range(5) r(c), range(5) s(d) WHERE a + b + c + d = 4),
        vw AS (SELECT v.*, w.*, round(S1 * w1 + S2 * w2 + S3 * w3 + S4 * w4, 12) AS sc FROM v, w),
        gv AS (SELECT weight_id, w1, w2, w3, w4, t1, t2, avg(CASE WHEN sc >= t2 THEN q2 WHEN sc >= t1 THEN q1 ELSE q0 END) AS quality, avg(CASE WHEN sc >= t2 THEN c2 WHEN sc >= t1 THEN c1 ELSE c0 END) AS cost FROM vw, g GROUP BY ALL)
        SELECT weight_id, w1, w2, w3, w4, t1, t2, round(quality, 6) AS quality, round(cost, 6) AS cost FROM gv WHERE cost <= (SELECT avg(c1) FROM v) + 1e-12 ORDER BY round(quality, 12) DESC, round(cost, 12), t1, t2, weight_id LIMIT 1""", ["wide", "scaled"])
def fit_weighted(spark, sf):
    """Weights and thresholds together."""
    v = _validation(spark, sf).drop("score")
    best = baselines.fit_weighted(v, SIGNALS, routing.weight_grid(spark), routing.pair_grid(spark), routing.budget_of(v, ACTIONS, "middle"), ACTIONS)
    return rounded(best.select("weight_id", "w1", "w2", "w3", "w4", "t1", "t2", "quality", "cost").withColumn("weight_id", F.col("weight_id").cast("long")), "quality", "cost")


@query(f"""+ {_VAL3}, g AS (SELECT a::DOUBLE AS t1, b::DOUBLE AS t2 FROM range(10) x(a), range(10) y(b) WHERE a < b),
        o AS (SELECT *, {' + '.join(f'CAST({s} >= 0.35::DOUBLE AS INTEGER) + CAST({s} >= 0.65::DOUBLE AS INTEGER)' for s in SIGNALS)} AS sc FROM v),
        gv AS (SELECT t1, t2, avg(CASE WHEN sc >= t2 THEN q2 WHEN sc >= t1 THEN q1 ELSE q0 END) AS quality, avg(CASE WHEN sc >= t2 THEN c2 WHEN sc >= t1 THEN c1 ELSE c0 END) AS cost FROM o, g GROUP BY 1, 2)
        SELECT t1, t2, round(quality, 6) AS quality, round(cost, 6) AS cost, count(*) OVER () AS n_feasible FROM gv WHERE cost <= (SELECT avg(c1) FROM v) + 1e-12 ORDER BY round(quality, 12) DESC, round(cost, 12), t1, t2 LIMIT 1""", ["wide", "scaled"])
def fit_ordinal(spark, sf):
    v = _validation(spark, sf)
    return rounded(baselines.fit_ordinal(v, SIGNALS, routing.budget_of(v, ACTIONS, "middle"), ACTIONS).select("t1", "t2", "quality", "cost", "n_feasible"), "quality", "cost")


_FUZZY3 = _centroid_sql(C.V3.signals, "min", 9).removeprefix("+ ")


@query(f"+ fz AS (WITH {_FUZZY3}), v AS (SELECT w.*, score FROM wide w JOIN fz USING (dataset, split, cluster_id, variant_id) WHERE split = 'val'), {_GRID3}, {_GV3} {_PICK3}", ["wide", "scaled"])
def fit_fuzzy(spark, sf):
    """Thresholds of the fuzzy controller on the validation split."""
    v = _validation(spark, sf).drop("score")
    best = baselines.fit_fuzzy(v, SIGNALS, routing.pair_grid(spark), routing.budget_of(v, ACTIONS, "middle"), ACTIONS)
    return rounded(best, "quality", "cost", "budget")


@query()
def learned_router(spark, sf):
    """A query-only router: softmax regression of each question's oracle action on its features, scored on every question.  Qualities of the actions
    are stand-ins, arithmetic on the item's id."""
    b = st.table(spark, sf, "benchmark")
    f = text.query_features(F.col("text"))
    quality = [((F.col("item_id") * 7919 + i * 104729) % 101 / F.lit(100.0)).alias(f"q_{a}") for i, a in enumerate(ACTIONS)]
    feats = b.select("item_id", *[v.alias(k) for k, v in f.items()], *quality).withColumn("label", evaluation.oracle_index(ACTIONS))
    model = baselines.fit_learned(feats, list(f), "label", 3)
    return feats.select("item_id", F.round(baselines.learned_score(model), 6).alias("score"))


# Evaluation

@query("""+ o AS (SELECT *, CASE WHEN q0 >= greatest(q0, q1, q2) - 0.02::DOUBLE - 1e-12::DOUBLE THEN 0 WHEN q1 >= greatest(q0, q1, q2) - 0.02::DOUBLE - 1e-12::DOUBLE THEN 1 ELSE 2 END AS o FROM wide)
        SELECT dataset, round(avg(CAST(o = 0 AS DOUBLE)), 6) AS share_A0, round(avg(CAST(o = 1 AS DOUBLE)), 6) AS share_A1, round(avg(CAST(o = 2 AS DOUBLE)), 6) AS share_A2, round(avg(CAST(greatest(q0, q1, q2) - least(q0, q1, q2) <= 1e-12 AS DOUBLE)), 6) AS identical FROM o GROUP BY 1""", ["wide"])
def oracle_shares(spark, sf):
    return rounded(evaluation.oracle_shares(_table(spark, sf), ACTIONS, ["dataset"]), "share_A0", "share_A1", "share_A2", "identical")


_FLAGS = """p AS (SELECT a.dataset, a.cluster_id, a.variant_id AS av, b.variant_id AS bv, a.i AS x, b.i AS y, [a.q0, a.q1, a.q2] AS qa, [b.q0, b.q1, b.q2] AS qb FROM routed a JOIN routed b ON a.cluster_id = b.cluster_id AND a.variant_id < b.variant_id JOIN complete k ON k.cluster_id = a.cluster_id),
        f AS (SELECT *, x <> y AS flipped, x <> y AND (qa[y + 1] > qa[x + 1] + 0.02::DOUBLE + 1e-12::DOUBLE OR qb[x + 1] > qb[y + 1] + 0.02::DOUBLE + 1e-12::DOUBLE OR CASE WHEN x > y THEN qa[x + 1] - qa[y + 1] ELSE qb[y + 1] - qb[x + 1] END < 0.02::DOUBLE - 1e-12::DOUBLE) AS harmful FROM p)"""


@query(f"+ {_FLAGS} SELECT cluster_id, CAST(av AS VARCHAR) AS a_v, CAST(bv AS VARCHAR) AS b_v, flipped, harmful FROM f", ["routed", "complete"])
def pair_flags(spark, sf):
    return evaluation.pair_flags(_routed(spark, sf), ACTIONS)


@query(f"+ {_FLAGS} SELECT dataset, round(avg(CAST(flipped AS DOUBLE)), 6) AS rfr, round(avg(CAST(harmful AS DOUBLE)), 6) AS hrfr, count(*) AS n_pairs, count(DISTINCT cluster_id) AS n_clusters FROM f GROUP BY 1", ["routed", "complete"])
def flip_rates(spark, sf):
    flags = evaluation.pair_flags(_routed(spark, sf), ACTIONS, by=["dataset"])
    return rounded(evaluation.flip_rates(flags, ["dataset"]), "rfr", "hrfr")


@query("""+ c AS (SELECT cluster_id, stddev_pop(score) AS s, stddev_pop(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) AS q, max(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) - min(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) AS d FROM routed JOIN complete USING (cluster_id) GROUP BY 1)
        SELECT round(avg(s), 6) AS score_sd, round(avg(q), 6) AS f1_sd, round(avg(d), 6) AS worst_drop, round(max(d), 6) AS worst_drop_max, count(*) AS n_clusters FROM c""", ["routed", "complete"])
def within_cluster(spark, sf):
    return rounded(evaluation.within_cluster(_routed(spark, sf), ACTIONS), "score_sd", "f1_sd", "worst_drop", "worst_drop_max")


@query(f"""+ {_FLAGS}, c AS (SELECT dataset, cluster_id, stddev_pop(score) AS s, max(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) - min(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) AS d FROM routed JOIN complete USING (cluster_id) GROUP BY 1, 2),
        b AS (SELECT dataset, avg(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) AS quality, avg(CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END) AS cost FROM routed GROUP BY 1)
        SELECT dataset, round(quality, 6) AS quality, round(cost, 6) AS cost, round(rfr, 6) AS rfr, round(hrfr, 6) AS hrfr, round(score_sd, 6) AS score_sd, round(worst_drop, 6) AS worst_drop FROM b JOIN (SELECT dataset, avg(CAST(flipped AS DOUBLE)) AS rfr, avg(CAST(harmful AS DOUBLE)) AS hrfr FROM f GROUP BY 1) USING (dataset) JOIN (SELECT dataset, avg(s) AS score_sd, avg(d) AS worst_drop FROM c GROUP BY 1) USING (dataset)""", ["routed", "complete"])
def measure(spark, sf):
    """The bundle that every policy is judged by."""
    m = evaluation.measure(_routed(spark, sf), ACTIONS, by=["dataset"])
    cols = ["quality", "cost", "rfr", "hrfr", "score_sd", "worst_drop"]
    return rounded(m.select("dataset", *cols), *cols)


_BOOT = """h AS (SELECT cluster_id, sum(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) AS s, sum(q1) AS o, count(*) AS n FROM routed GROUP BY 1),
        u AS (SELECT cluster_id, rep, CAST('0x' || substr(md5('42:' || rep || ':' || cluster_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM h, range(100) r(rep)),
        m AS (SELECT cluster_id, rep, (SELECT count(*) FROM (VALUES (0.36787944117144233::DOUBLE), (0.7357588823428847), (0.9196986029286058), (0.9810118431238462), (0.9963401531726563), (0.9994058151824183), (0.999916758850712), (0.9999898050804653), (0.9999989366085494), (0.9999998885523387), (0.9999999898056253), (0.9999999991737786)) e(e) WHERE u >= e) AS m FROM u)"""


@query(f"""+ {_BOOT}, r AS (SELECT rep, sum(m * s) / sum(m * n) AS r FROM m JOIN h USING (cluster_id) WHERE m > 0 GROUP BY 1)
        SELECT round((SELECT sum(s) / sum(n) FROM h), 6) AS mean, round(quantile_cont(r, 0.025::DOUBLE), 6) AS lo, round(quantile_cont(r, 0.975::DOUBLE), 6) AS hi FROM r""", ["routed"])
def bootstrap_quality(spark, sf):
    """Mean quality and its interval over resampled clusters; draws come from hashes, 100 resamples."""
    t = _routed(spark, sf)
    sums = evaluation.cluster_sums(t, routing.chosen("q", F.col("action_index"), ACTIONS))
    return rounded(evaluation.bootstrap_hashed(sums, 100), "mean", "lo", "hi")


@query(f"""+ {_BOOT}, r AS (SELECT rep, sum(m * (s - o)) / sum(m * n) AS r FROM m JOIN h USING (cluster_id) WHERE m > 0 GROUP BY 1), c AS (SELECT quantile_cont(r, 0.025::DOUBLE) AS lo, quantile_cont(r, 0.975::DOUBLE) AS hi FROM r)
        SELECT round((SELECT sum(s - o) / sum(n) FROM h), 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant FROM c""", ["routed"])
def bootstrap_paired(spark, sf):
    """The same resamples for a policy and always-A1: their difference."""
    t = _routed(spark, sf)
    sums = evaluation.cluster_sums(t, routing.chosen("q", F.col("action_index"), ACTIONS)).join(t.groupBy("cluster_id").agg(F.sum("q_A1").alias("o")), "cluster_id")
    return rounded(evaluation.bootstrap_hashed(sums, 100, ["s", "o"]), "diff", "lo", "hi")


@query("""+ p AS (SELECT dataset, signal, value, q2 > q1 + 0.02::DOUBLE AS pos FROM long JOIN wide USING (dataset, split, cluster_id, variant_id)), k AS (SELECT dataset, signal, pos, rank() OVER w + (count(*) OVER (PARTITION BY dataset, signal, value) - 1) / 2.0::DOUBLE AS r FROM p WINDOW w AS (PARTITION BY dataset, signal ORDER BY value))
        SELECT dataset, signal, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg FROM k GROUP BY 1, 2""", ["long", "wide"])
def auc_table(spark, sf):
    """How well each signal tells where the dearest action gains."""
    inst = st.instances(spark, sf)
    t = signals.unpivot(inst, SIGNALS, KEYS).join(_table(spark, sf), KEYS).withColumn("pos", F.col("q_A2") > F.col("q_A1") + 0.02)
    return rounded(evaluation.auc(t, "value", "pos", ["dataset", "signal"]), "auc")


@query("""+ k AS (SELECT S1, S2, S3, S4, """ + ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE AS r{i}" for i, s in enumerate(SIGNALS, 1)) + " FROM inst) " + " UNION ALL ".join(f"SELECT 'S{a}-S{b}' AS pair, round(corr(S{a}, S{b}), 6) AS pearson, round(corr(r{a}, r{b}), 6) AS spearman FROM k" for a in range(1, 5) for b in range(a + 1, 5)), ["inst"])
def signal_correlations(spark, sf):
    return rounded(evaluation.correlations(st.instances(spark, sf), SIGNALS), "pearson", "spearman")


@query("""+ n AS (SELECT dataset, signal, round(value, 12) AS v, count(*) AS n FROM long GROUP BY 1, 2, 3), m AS (SELECT dataset, signal, max(n) / sum(n)::DOUBLE AS most_common_share FROM n GROUP BY 1, 2)
        SELECT dataset, signal, round(most_common_share, 6) AS most_common_share, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM long JOIN m USING (dataset, signal) GROUP BY ALL""", ["long"])
def signal_summary(spark, sf):
    long = signals.unpivot(st.instances(spark, sf), SIGNALS, ["dataset"])
    share = evaluation.modal_share(long, "value", ["dataset", "signal"])
    stats = long.groupBy("dataset", "signal").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return rounded(stats.join(share, ["dataset", "signal"]), "most_common_share", "min", "max", "mean", "sd")


@query("""+ cl AS (SELECT dataset, signal, avg(CAST(raw < 0 OR raw > 1 AS DOUBLE)) AS clipped FROM slong GROUP BY 1, 2) SELECT 'stop' AS level, dataset, 'clipped' AS check, signal AS what FROM cl WHERE clipped > 0.8
        UNION ALL SELECT 'revisit', dataset, 'clipped', signal FROM cl WHERE clipped > 0.2 AND clipped <= 0.8 UNION ALL SELECT 'explain', 'both', 'S3 direction', 'S3'
        UNION ALL SELECT 'explain', dataset, 'calibration', 'all widths at the floor' FROM (SELECT dataset, bool_and(j <= 0.2) AS f FROM (SELECT a.dataset, a.signal, quantile_cont(abs(a.value - b.value), 0.75::DOUBLE) AS j FROM long a JOIN long b USING (dataset, cluster_id, signal) JOIN complete USING (cluster_id) WHERE a.split = 'train' AND a.variant_id < b.variant_id GROUP BY 1, 2) GROUP BY 1) WHERE f""", ["slong", "complete"])
def check_flags(spark, sf):
    """Findings, with a stand-in of opposite S3 directions."""
    inst = st.instances(spark, sf)
    scalers = signals.fit_scaler(inst.filter("split = 'train'"), SIGNALS)
    clipped = signals.clipped_share(signals.apply_scaler(inst, scalers, SIGNALS, raw=True), SIGNALS)
    share = evaluation.modal_share(signals.unpivot(inst, SIGNALS, ["dataset"]), "value", ["dataset", "signal"])
    summary = clipped.join(share, ["dataset", "signal"]).withColumn("non_finite", F.lit(0)).withColumn("auc_hard", F.when(F.col("dataset") == "hp", 0.4).otherwise(0.6))
    cor = evaluation.correlations(inst, SIGNALS).select(F.lit("both").alias("dataset"), "pair", "spearman")
    floors = signals.jitter_widths(inst.filter("split = 'train'"), SIGNALS).select("dataset", "all_at_floor").distinct()
    return evaluation.flags(summary, cor, floors)


@query("""+ a AS (SELECT avg(q0) AS q0, avg(q1) AS q1, avg(q2) AS q2, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2, avg(CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END) AS cost FROM routed),
        p AS (SELECT unnest([q0, q1, q2]) AS q, unnest([c0, c1, c2]) AS c, cost FROM a)
        SELECT round(max(cost), 6) AS cost, round(max(m), 6) AS mixture FROM (SELECT cost, q AS m FROM p WHERE c <= cost + 1e-12 UNION ALL SELECT x.cost, x.q + (x.cost - x.c) / (y.c - x.c) * (y.q - x.q) FROM p x JOIN p y ON x.c <= x.cost AND x.cost < y.c)""", ["routed"])
def random_mixture(spark, sf):
    """The best random mixture of two fixed actions at the router's cost."""
    t = _routed(spark, sf)
    cost = t.agg(F.avg(routing.chosen("c", F.col("action_index"), ACTIONS)).alias("cost"))
    return rounded(evaluation.mixture(t, cost, ACTIONS), "cost", "mixture")


# Diagnostics

@query("""+ c AS (SELECT cluster_id, avg(q1) AS m, var_pop(q1) AS v FROM wide JOIN complete USING (cluster_id) GROUP BY 1), t AS (SELECT var_samp(m) * 3 AS b, avg(v) * 3 / 2 AS w, count(*) AS n FROM c)
        SELECT round((b - w) / (b + 2 * w), 6) AS icc, n AS n_clusters, round((SELECT 2.8::DOUBLE * stddev_samp(m) / sqrt(count(*)) FROM (SELECT avg(q1) AS m FROM wide GROUP BY cluster_id)), 6) AS mde FROM t""", ["wide", "complete"])
def icc_and_mde(spark, sf):
    t = _table(spark, sf)
    return rounded(diagnostics.icc(t, "q_A1").crossJoin(diagnostics.detectable(t, "q_A1").select("mde")), "icc", "mde")


@query("SELECT round(regr_slope(c2, q2), 6) AS slope, round(regr_intercept(c2, q2), 6) AS intercept, round(regr_r2(c2, q2), 6) AS r2, round(sqrt(var_pop(c2) * (1 - regr_r2(c2, q2))), 6) AS residual_sd FROM wide", ["wide"])
def cost_regression(spark, sf):
    return rounded(diagnostics.regression(_table(spark, sf), "c_A2", "q_A2"), "slope", "intercept", "r2", "residual_sd")


@query("""+ o AS (SELECT w.*, CASE WHEN q0 >= greatest(q0, q1, q2) - 0.02::DOUBLE - 1e-12::DOUBLE THEN 0 WHEN q1 >= greatest(q0, q1, q2) - 0.02::DOUBLE - 1e-12::DOUBLE THEN 1 ELSE 2 END AS o FROM wide w JOIN complete USING (cluster_id)),
        a AS (SELECT cluster_id, count(DISTINCT o) AS k, greatest(avg(q0), avg(q1), avg(q2)) AS best FROM o GROUP BY 1),
        s AS (SELECT CASE WHEN (sum(q2 - q1) OVER (PARTITION BY cluster_id) - (q2 - q1)) / 2 > 0.02 THEN q2 ELSE q1 END AS q, (sum(q2 - q1) OVER (PARTITION BY cluster_id) - (q2 - q1)) / 2 > 0.02 AS up FROM o)
        SELECT (SELECT round(avg(CAST(k = 1 AS DOUBLE)), 6) FROM a) AS agreement, (SELECT round(avg(best), 6) FROM a) AS cluster_oracle, (SELECT round(avg(q), 6) FROM s) AS sibling_quality, (SELECT round(avg(CAST(up AS DOUBLE)), 6) FROM s) AS upgraded, (SELECT round(2 * avg(CAST(up AS DOUBLE)) * (1 - avg(CAST(up AS DOUBLE))), 6) FROM s) AS random_rfr""", ["wide", "complete"])
def sibling_headroom(spark, sf):
    """What knowing a phrasing's siblings would be worth."""
    t = _table(spark, sf)
    agree = diagnostics.agreement(t.withColumn("o", evaluation.oracle_index(ACTIONS)), "o").select("agreement")
    sib = diagnostics.sibling_router(t, "A1", "A2").withColumnRenamed("quality", "sibling_quality").withColumn("random_rfr", 2 * F.col("upgraded") * (1 - F.col("upgraded")))
    out = agree.crossJoin(diagnostics.cluster_oracle(t, ACTIONS).withColumnRenamed("quality", "cluster_oracle")).crossJoin(sib)
    return rounded(out, "agreement", "cluster_oracle", "sibling_quality", "upgraded", "random_rfr")


@query("""+ a AS (SELECT qid, list(doc_id ORDER BY rank) AS a, bool_or((doc_id + qid) % 4 = 0) AS ha FROM bm WHERE rank <= 5 GROUP BY 1), b AS (SELECT qid, list(doc_id ORDER BY rank) AS b, bool_or((doc_id + qid) % 4 = 0) AS hb FROM dn WHERE rank <= 5 GROUP BY 1)
        SELECT round(avg(CAST(qid % 7 = 0 AS DOUBLE)), 6) AS fallback, round(avg(CAST(list_sort(a) = list_sort(b) AS DOUBLE)), 6) AS same_set, round(avg(CAST(a = b AS DOUBLE)), 6) AS same_order, round(avg(len(list_filter(b, lambda x: NOT list_contains(a, x)))), 6) AS new_passages, CAST(count_if(ha AND NOT hb) AS BIGINT) AS lost, CAST(count_if(NOT ha AND hb) AS BIGINT) AS rescued FROM a JOIN b USING (qid)""", ["bm", "dn"])
def escalation_diagnosis(spark, sf):
    """What a second search changes among a question's first five."""
    lists = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))
    side = lambda df, ids, hit: df.filter("rank <= 5").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(ids), F.bool_or((F.col("doc_id") + F.col("qid")) % 4 == 0).alias(hit))
    both = side(lists["lexical"], "before", "hit_before").join(side(lists["dense"], "after", "hit_after"), "qid").withColumn("fallback", F.col("qid") % 7 == 0)
    return rounded(diagnostics.diagnosis(both), "fallback", "same_set", "same_order", "new_passages")


@query("SELECT 'S1' AS column, count(*) FILTER (value > 0.9) AS n FROM long WHERE signal = 'S1' UNION ALL SELECT 'S2', 0", ["long"])
def audit_mismatches(spark, sf):
    """Stored signals of which one was tampered with, against recomputed ones."""
    inst = st.instances(spark, sf)
    stored = inst.withColumn("S1", F.when(F.col("S1") > 0.9, F.col("S1") + 1).otherwise(F.col("S1")))
    return diagnostics.mismatches(stored, inst, KEYS, ["S1", "S2"])


# Logs

@query("""WITH c AS (SELECT user_id AS worker, event_id AS seq, value * 10 AS rate FROM events), f AS (SELECT *, sum(CAST(rate >= 120 AS INTEGER)) OVER (PARTITION BY worker ORDER BY seq) AS g FROM c),
        l AS (SELECT *, sum(CAST(rate < 120 AS INTEGER)) OVER (PARTITION BY worker, g ORDER BY seq) AS k FROM f), s AS (SELECT *, min(seq) FILTER (k >= 5) OVER (PARTITION BY worker) AS stop FROM l),
        t AS (SELECT *, max(seq) FILTER (rate >= 120 AND seq < stop) OVER (PARTITION BY worker) AS last FROM s)
        SELECT worker, seq, rate < 120 AS slow, CAST(k AS BIGINT) AS run_length, stop IS NULL OR seq <= coalesce(last, -1) AS accepted FROM t""")
def slow_runs(spark, sf):
    """Calls up to each worker's first five slow ones in a row."""
    calls = st.table(spark, sf, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), (F.col("value") * 10).alias("rate"))
    return guard.guard(calls).select("worker", "seq", "slow", "run_length", "accepted")


@query("""WITH p AS (SELECT event_id, md5(event_type || ':' || (event_id % 97)) AS k, value FROM events)
        SELECT event_id, first_value(event_id) OVER (PARTITION BY k ORDER BY event_id) AS source_id, first_value(value) OVER (PARTITION BY k ORDER BY event_id) AS seconds, row_number() OVER (PARTITION BY k ORDER BY event_id) > 1 AS reused FROM p""")
def prompt_memo(spark, sf):
    """Calls with a prompt seen before take the first one's reply and latency."""
    from waymark.plans.pipeline import memoise

    p = st.table(spark, sf, "events").select("event_id", F.md5(F.concat("event_type", F.lit(":"), (F.col("event_id") % 97).cast("string"))).alias("k"), "value")
    return memoise(p, "k", "event_id", {"source_id": "event_id", "seconds": "value"}).select("event_id", "source_id", "seconds", "reused")


@query("SELECT event_type, count(*) AS todo FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def resume_todo(spark, sf):
    """What a phase has still to do: rows whose key isn't among those done."""
    done = st.table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    return writers.todo(st.table(spark, sf, "events"), done, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("todo"))


@query("""SELECT dataset, action, round(avg(f1), 6) AS f1, round(avg(retrieval + generation), 6) AS latency, count(*) AS n FROM rows GROUP BY GROUPING SETS ((dataset, action), (action))""", ["rows"])
def phase_summary(spark, sf):
    """Means by action, for each dataset and for both (dataset null)."""
    rows = st.outcome_rows(st.instances(spark, sf)).select("dataset", "action", "f1", (F.col("retrieval") + F.col("generation")).alias("latency"))
    out = rows.groupingSets([[F.col("dataset"), F.col("action")], [F.col("action")]], "dataset", "action").agg(F.avg("f1").alias("f1"), F.avg("latency").alias("latency"), F.count("*").alias("n"))
    return rounded(out, "f1", "latency")


@query("""SELECT d.source AS dataset, count(*) AS n, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS same_meaning, round(avg(CAST(toxic = 0 AS DOUBLE)), 6) AS answer_still_correct FROM labels l JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.source)""")
def audit_agreement(spark, sf):
    """A judged sheet's agreement for each source and over all."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    sheet = st.table(spark, sf, "labels").join(st.table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset")), "doc_id").select("dataset", yes(F.col("quality") == 1).alias("same_meaning"), yes(F.col("toxic") == 0).alias("answer_still_correct"))
    return rounded(clusters.audit_score(sheet), "same_meaning", "answer_still_correct")


@query("""+ g AS (SELECT item_id AS qid, source AS gold FROM benchmark JOIN documents ON doc_id = item_id * 3), t AS (SELECT qid, list(DISTINCT d.source) AS got FROM bm JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY 1)
        SELECT qid, CAST(list_contains(got, gold) AS INTEGER) AS n_gold FROM t JOIN g USING (qid)""", ["bm"])
def gold_pages(spark, sf):
    """How many of a question's supporting titles are among its first five passages'."""
    d = st.passages(spark, sf)
    gold = st.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") * 3).alias("doc_id")).join(d.select("doc_id", "title"), "doc_id").select("qid", F.array("title").alias("gold"))
    found = retrieval.bm25(st.questions(spark, sf), d)
    return retrieval.gold_found(found, d, gold.join(found.select("qid").distinct(), "qid", "left_semi"))


@query("""+ t AS (SELECT dataset, q0, q1, q2, c0, c1, c2, i FROM routed WHERE split = 'test' AND dataset = 'hp' UNION ALL SELECT dataset, q0, q1, q2, c0, c1, c2, CAST(score >= 0.5::DOUBLE AS INTEGER) + CAST(score >= 0.7::DOUBLE AS INTEGER) FROM routed WHERE split = 'test' AND dataset = 'nq')
        SELECT round(avg(CASE i WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END), 6) AS quality, round(avg(CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END), 6) AS cost, count(*) FILTER (i = 0) AS n_A0, count(*) FILTER (i = 1) AS n_A1, count(*) FILTER (i = 2) AS n_A2 FROM t""", ["routed"])
def pooled_evaluation(spark, sf):
    """Test instances of both datasets, each routed by its own thresholds."""
    t = _routed(spark, sf).filter("split = 'test'")
    own = baselines.route(t.filter("dataset = 'nq'"), F.col("score"), [0.5, 0.7], ACTIONS)
    both = t.filter("dataset = 'hp'").unionByName(own)
    return rounded(routing.policy_value(both, F.col("action_index"), ACTIONS), "quality", "cost")


# One-call evaluation and audits

_LEVELS = " + ".join(f"CAST({s} >= 0.35::DOUBLE AS INTEGER) + CAST({s} >= 0.65::DOUBLE AS INTEGER)" for s in C.V4.signals)
_ROUTERS = f"""+ fz AS (WITH {_centroid_sql(C.V4.signals, 'min', 9).removeprefix('+ ')}),
        w AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS weight_id, a / 4.0::DOUBLE AS w1, b / 4.0::DOUBLE AS w2, c / 4.0::DOUBLE AS w3 FROM range(5) p(a), range(5) q(b), range(5) r(c) WHERE a + b + c = 4),
        sc AS (SELECT 'B1' AS router, weight_id, dataset, split, cluster_id, variant_id, round(S2 * w1 + S3 * w2 + S4 * w3, 9) AS score FROM scaled, w
          UNION ALL SELECT 'B2', 0, dataset, split, cluster_id, variant_id, ({_LEVELS})::DOUBLE FROM scaled UNION ALL SELECT 'B3', 0, dataset, split, cluster_id, variant_id, score FROM fz),
        bd AS (SELECT (avg(c1) + avg(c2)) / 2 AS budget FROM wide WHERE split = 'val'),
        g AS (SELECT r.router, x / CASE r.router WHEN 'B2' THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS t1 FROM (VALUES ('B1', 101), ('B2', 8), ('B3', 101)) r(router, n), range(101) t(x) WHERE x < n),
        gv AS (SELECT router, weight_id, t1, avg(CASE WHEN score >= t1 THEN q2 ELSE q1 END) AS quality, avg(CASE WHEN score >= t1 THEN c2 ELSE c1 END) AS cost FROM sc JOIN wide USING (dataset, split, cluster_id, variant_id) JOIN g USING (router) WHERE split = 'val' GROUP BY 1, 2, 3),
        fit AS (SELECT router, weight_id, t1 FROM (SELECT *, row_number() OVER (PARTITION BY router ORDER BY round(quality, 12) DESC, round(cost, 12), t1, weight_id) AS k FROM gv, bd WHERE cost <= budget + 1e-12) WHERE k = 1),
        rt AS (SELECT router, cluster_id, variant_id, q1, q2, c1, c2, score, CAST(score >= t1 AS INTEGER) AS i FROM sc JOIN fit USING (router, weight_id) JOIN wide USING (dataset, split, cluster_id, variant_id) WHERE split = 'test'
          UNION ALL SELECT 'always-A' || (a + 1), cluster_id, variant_id, q1, q2, c1, c2, NULL, a FROM wide, range(2) r(a) WHERE split = 'test'
          UNION ALL SELECT 'oracle', cluster_id, variant_id, q1, q2, c1, c2, NULL, CASE WHEN q1 >= greatest(q1, q2) - 0.02::DOUBLE - 1e-12::DOUBLE THEN 0 ELSE 1 END FROM wide WHERE split = 'test'),
        p AS (SELECT a.router, a.cluster_id, a.i AS x, b.i AS y, [a.q1, a.q2] AS qa, [b.q1, b.q2] AS qb FROM rt a JOIN rt b ON a.router = b.router AND a.cluster_id = b.cluster_id AND a.variant_id < b.variant_id JOIN complete k ON k.cluster_id = a.cluster_id),
        f AS (SELECT *, x <> y AS flipped, x <> y AND (qa[y + 1] > qa[x + 1] + 0.02::DOUBLE + 1e-12::DOUBLE OR qb[x + 1] > qb[y + 1] + 0.02::DOUBLE + 1e-12::DOUBLE OR CASE WHEN x > y THEN qa[x + 1] - qa[y + 1] ELSE qb[y + 1] - qb[x + 1] END < 0.02::DOUBLE - 1e-12::DOUBLE) AS harmful FROM p),
        res AS (SELECT router, avg(CASE i WHEN 0 THEN q1 ELSE q2 END) AS quality, avg(CASE i WHEN 0 THEN c1 ELSE c2 END) AS cost, count(*) FILTER (i = 0) AS n_A1, count(*) FILTER (i = 1) AS n_A2 FROM rt GROUP BY 1),
        fl AS (SELECT router, avg(CAST(flipped AS DOUBLE)) AS rfr, avg(CAST(harmful AS DOUBLE)) AS hrfr FROM f GROUP BY 1)"""


def _router_set(spark, sf):
    """Validation and test tables of the two actions, with signals, and B1 to B3 fitted."""
    t = _table(spark, sf).join(_scaled(spark, sf), KEYS)
    split = lambda s: tables.written(t.filter(F.col("split") == s), s)
    val, test = split("val"), split("test")
    own = {k: v for k, v in evaluate.scores(C.V4, ablations={}).items() if k in evaluate.BASELINES}
    return evaluate.fit_routers(val, C.V4, own), val, test


@query(_ROUTERS + " SELECT router, round(quality, 6) AS quality, round(cost, 6) AS cost, n_A1, n_A2, round(rfr, 6) AS rfr, round(hrfr, 6) AS hrfr FROM res JOIN fl USING (router)", ["wide", "scaled", "complete"])
def router_evaluation(spark, sf):
    """Routers fitted on validation and reference policies, measured on test, in one plan."""
    fitted, _, test = _router_set(spark, sf)
    table = evaluate.routed(test, fitted, C.V4.actions)
    m = evaluation.measure(table, C.V4.actions, by=["router"])
    return rounded(m.select("router", "quality", "cost", "n_A1", "n_A2", "rfr", "hrfr"), "quality", "cost", "rfr", "hrfr")


_PAIRS = """, h AS (SELECT router, cluster_id, sum(CASE i WHEN 0 THEN q1 ELSE q2 END) AS s, count(*) AS n FROM rt GROUP BY 1, 2), j AS (SELECT h.*, b.s AS r FROM h JOIN h b ON b.router = 'B3' AND b.cluster_id = h.cluster_id WHERE h.router <> 'B3'),
        u AS (SELECT *, CAST('0x' || substr(md5('42:' || rep || ':' || cluster_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM j, range(50) x(rep)),
        m AS (SELECT *, (SELECT count(*) FROM (VALUES (0.36787944117144233::DOUBLE), (0.7357588823428847), (0.9196986029286058), (0.9810118431238462), (0.9963401531726563), (0.9994058151824183), (0.999916758850712), (0.9999898050804653), (0.9999989366085494), (0.9999998885523387), (0.9999999898056253), (0.9999999991737786)) e(e) WHERE u >= e) AS m FROM u),
        q AS (SELECT router, rep, sum(m * (r - s)) / sum(m * n) AS d FROM m GROUP BY 1, 2), ci AS (SELECT router, quantile_cont(d, 0.025::DOUBLE) AS lo, quantile_cont(d, 0.975::DOUBLE) AS hi FROM q GROUP BY 1)
        SELECT router, round(sum(r - s) / sum(n), 6) AS diff, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, any_value(lo) > 0 OR any_value(hi) < 0 AS significant FROM j JOIN ci USING (router) GROUP BY 1"""


@query(_ROUTERS + _PAIRS, ["wide", "scaled", "complete"])
def router_comparisons(spark, sf):
    """B3's quality less every other router's, with intervals over 50 resamples."""
    fitted, _, test = _router_set(spark, sf)
    table = evaluate.routed(test, fitted, C.V4.actions)
    out = evaluate.paired(table, C.V4.actions, "B3", 50).filter("what = 'quality'").drop("what")
    return rounded(out, "diff", "lo", "hi")


@query(_ROUTERS + """, b AS (SELECT router, quality, cost FROM res WHERE router IN ('B1', 'B2', 'B3') ORDER BY quality DESC, router LIMIT 1), me AS (SELECT quality, cost, CAST(n_A1 > 0 AS INTEGER) + CAST(n_A2 > 0 AS INTEGER) AS used FROM res WHERE router = 'B3'),
        pt AS (SELECT quality AS q, cost AS c FROM res WHERE router LIKE 'always%'), mx AS (SELECT max(m) AS m FROM (SELECT q AS m FROM pt, me WHERE c <= me.cost + 1e-12 UNION ALL SELECT x.q + (me.cost - x.c) / (y.c - x.c) * (y.q - x.q) FROM me, pt x JOIN pt y ON x.c < y.c WHERE x.c <= me.cost AND me.cost < y.c))
        SELECT b.router AS strongest_baseline, abs(me.quality - b.quality) <= 0.01 AS within_1_point, me.cost <= b.cost AS cost_not_higher, used AS actions_used, round(m, 6) AS mixture, m IS NULL OR me.quality >= m AS beats_mixtures FROM b, me, mx""", ["wide", "scaled", "complete"])
def router_criteria(spark, sf):
    """Whether B3 meets the criteria that a router is judged by."""
    fitted, _, test = _router_set(spark, sf)
    table = evaluate.routed(test, fitted, C.V4.actions)
    m = evaluation.measure(table, C.V4.actions, by=["router"])
    none = spark.createDataFrame([], "router string, what string, diff double, significant boolean")
    return rounded(evaluate.criteria(m, none, test, C.V4.actions, "B3").drop("lower_hrfr"), "mixture")


@query(_ROUTERS + """, bud AS (SELECT DISTINCT router, weight_id, round(cost, 12) AS budget FROM gv WHERE router <> 'B1'),
        fr AS (SELECT b.router, b.budget, x.t1, x.quality FROM bud b, LATERAL (SELECT * FROM gv WHERE gv.router = b.router AND round(cost, 12) <= b.budget ORDER BY round(quality, 12) DESC, round(cost, 12), t1 LIMIT 1) x),
        tv AS (SELECT g.router, g.t1, avg(CASE WHEN score >= t1 THEN q2 ELSE q1 END) AS test_quality, avg(CASE WHEN score >= t1 THEN c2 ELSE c1 END) AS test_cost FROM sc JOIN wide USING (dataset, split, cluster_id, variant_id) JOIN g ON g.router = sc.router WHERE split = 'test' AND g.router <> 'B1' GROUP BY 1, 2)
        SELECT router, round(budget, 6) AS budget, t1, round(quality, 6) AS val_quality, round(test_quality, 6) AS test_quality, round(test_cost, 6) AS test_cost FROM fr JOIN tv USING (router, t1)""", ["wide", "scaled", "complete"])
def router_pareto(spark, sf):
    """Frontiers of B2 and B3 on validation, each point measured on test."""
    fitted, val, test = _router_set(spark, sf)
    own = evaluate.Fitted({k: v for k, v in fitted.routers.items() if k != "B1"})
    return rounded(evaluate.pareto(val, test, own, C.V4), "budget", "val_quality", "test_quality", "test_cost")


@query("""+ p AS (SELECT score, cluster_id, q2 > q1 + 0.02::DOUBLE AS pos FROM (SELECT *, round(score, 9) AS s9 FROM routed)), s AS (SELECT cluster_id, round(score, 9) AS v, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM p GROUP BY 1, 2),
        u AS (SELECT *, CAST('0x' || substr(md5('42:' || rep || ':' || cluster_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s, range(20) x(rep)),
        m AS (SELECT *, (SELECT count(*) FROM (VALUES (0.36787944117144233::DOUBLE), (0.7357588823428847), (0.9196986029286058), (0.9810118431238462), (0.9963401531726563), (0.9994058151824183), (0.999916758850712), (0.9999898050804653), (0.9999989366085494), (0.9999998885523387), (0.9999999898056253), (0.9999999991737786)) e(e) WHERE u >= e) AS m FROM u),
        c AS (SELECT -1 AS rep, v, sum(p) AS p, sum(n) AS n FROM s GROUP BY 2 UNION ALL SELECT rep, v, sum(m * p), sum(m * n) FROM m GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
        a AS (SELECT rep, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM b GROUP BY 1)
        SELECT round(max(auc) FILTER (rep = -1), 6) AS auc, round(quantile_cont(auc, 0.025::DOUBLE) FILTER (rep >= 0), 6) AS lo, round(quantile_cont(auc, 0.975::DOUBLE) FILTER (rep >= 0), 6) AS hi FROM a""", ["routed"])
def auc_interval(spark, sf):
    """How well the mean signal tells where the dearest action gains, with an interval over 20 resamples of clusters."""
    t = _routed(spark, sf).select("cluster_id", F.round("score", 9).alias("score"), (F.col("q_A2") > F.col("q_A1") + 0.02).alias("pos"))
    return rounded(audits.bootstrap_auc(t, "score", "pos", 20), "auc", "lo", "hi")


@query("""+ t AS (SELECT *, CASE WHEN cluster_id % 3 = 0 THEN 'bridge' ELSE 'comparison' END AS type FROM wide) SELECT type, count(*) AS n, round(avg(q1), 6) AS low, round(avg(q2), 6) AS high, round(avg(q2 - q1), 6) AS gain, round(avg(CAST(q2 - q1 > 0.02::DOUBLE AS DOUBLE)), 6) AS wins FROM t GROUP BY 1
        UNION ALL SELECT 'router', count(*), round(avg(CASE type WHEN 'bridge' THEN q2 ELSE q1 END), 6), round(avg(CASE type WHEN 'bridge' THEN c2 ELSE c1 END), 6), NULL, NULL FROM t""", ["wide"])
def question_types(spark, sf):
    """Gains by type of question, and a router that goes by type alone (its quality under low, its cost under high); types are a stand-in."""
    t = _table(spark, sf).withColumn("type", F.when(F.col("cluster_id") % 3 == 0, "bridge").otherwise("comparison"))
    none = F.lit(None).cast("double")
    own = audits.type_router(t, "type", "bridge", C.V4.actions).select(F.lit("router").alias("type"), (F.col("n_A1") + F.col("n_A2")).alias("n"), F.col("quality").alias("low"), F.col("cost").alias("high"), none.alias("gain"), none.alias("wins"))
    return rounded(audits.by_type(t, "type", "A1", "A2").unionByName(own), "low", "high", "gain", "wins")


@query("""+ a AS (SELECT qid, list(doc_id ORDER BY rank) AS before FROM bm WHERE rank <= 5 GROUP BY 1), b AS (SELECT qid, list(doc_id ORDER BY rank) AS other FROM dn WHERE rank <= 5 GROUP BY 1),
        t AS (SELECT before, CASE qid % 3 WHEN 0 THEN list_reverse(before) WHEN 1 THEN before ELSE other END AS after, abs((qid * 7919 % 101) / 100.0::DOUBLE - (qid * 104729 % 101) / 100.0::DOUBLE) AS gap FROM a JOIN b USING (qid))
        SELECT count_if(list_sort(before) = list_sort(after) AND before <> after)::BIGINT AS reordered, round(avg(CAST(gap > 0.02::DOUBLE AS DOUBLE)) FILTER (list_sort(before) = list_sort(after) AND before <> after), 6) AS reordered_differ,
          count_if(before = after)::BIGINT AS identical, round(avg(CAST(gap > 1e-12 AS DOUBLE)) FILTER (before = after), 6) AS identical_differ FROM t""", ["bm", "dn"])
def order_noise(spark, sf):
    """What the order of the same passages changes; a third of the questions have theirs turned round, a third the same."""
    lists = retrieval.hybrid(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))
    side = lambda df, name: df.filter("rank <= 5").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    t = side(lists["lexical"], "before").join(side(lists["dense"], "other"), "qid")
    part = F.col("qid") % 3
    t = t.withColumns({"after": F.when(part == 0, F.reverse("before")).when(part == 1, F.col("before")).otherwise(F.col("other")), "q_A1": F.col("qid") * 7919 % 101 / F.lit(100.0), "q_A2": F.col("qid") * 104729 % 101 / F.lit(100.0)})
    return rounded(audits.order_noise(t, "A1", "A2"), "reordered_differ", "identical_differ")


@query(r"""WITH t AS (SELECT regexp_matches(lower(text), 'not specified|not mentioned|no answer|no information|not provided|unknown|not stated|cannot|the') AS no, (conv_id * 7919 + turn) % 101 / 100.0::DOUBLE AS q0, (conv_id * 104729 + turn) % 101 / 100.0::DOUBLE AS q1 FROM conversations)
        SELECT round(avg(CAST(no AS DOUBLE)), 6) AS abstained, round(avg(q1 - q0) FILTER (no), 6) AS gain_A1 FROM t""")
def abstentions(spark, sf):
    """Turns that abstain, and what another action gains on those; as few do, each that holds "the" is made to."""
    c = st.table(spark, sf, "conversations")
    answer = F.when(F.lower("text").contains("the"), F.concat("text", F.lit(" unknown"))).otherwise(F.col("text"))
    t = c.select(answer.alias("answer"), ((F.col("conv_id") * 7919 + F.col("turn")) % 101 / F.lit(100.0)).alias("q_A0"), ((F.col("conv_id") * 104729 + F.col("turn")) % 101 / F.lit(100.0)).alias("q_A1"))
    return rounded(audits.abstention(t, "answer", ["A0", "A1"]), "abstained", "gain_A1")


@query("""+ t AS (SELECT q1, q2, q0 AS old, c1, c2 FROM wide WHERE split IN ('train', 'val')) SELECT count(*) AS n, round(avg(q1), 6) AS low, round(avg(q2), 6) AS high, round(avg(old), 6) AS old_high, round(avg(greatest(q1, q2)), 6) AS oracle, round(avg(greatest(q1, old)), 6) AS old_oracle,
        count_if(q2 > q1 + 0.02::DOUBLE)::BIGINT AS beats, count_if(q2 < q1 - 0.02::DOUBLE)::BIGINT AS loses, count_if(old > q1 + 0.02::DOUBLE)::BIGINT AS old_beats, round(avg(c1), 6) AS low_cost, round(avg(c2), 6) AS high_cost FROM t""", ["wide"])
def trainval_check(spark, sf):
    """The dearer action against its older run (here A0's outcomes) on train and validation."""
    t = _table(spark, sf).filter("split in ('train', 'val')")
    out = audits.trainval_check(t, t.select("cluster_id", "variant_id", F.col("q_A0").alias("quality")), "A1", "A2")
    return rounded(out, "low", "high", "old_high", "oracle", "old_oracle", "low_cost", "high_cost")


_PILOT = """+ r AS (SELECT dataset, cluster_id, variant_id, CASE a WHEN 1 THEN 'A1' WHEN 2 THEN 'A2-V1' ELSE 'A2-V2' END AS action, CASE a WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q0 END AS f1, CASE a WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c0 END AS latency,
        CASE WHEN dataset = 'hp' THEN (cluster_id + variant_id + a) % 3 END AS gold, CASE WHEN cluster_id % 2 = 0 THEN variant_id / 2.0::DOUBLE END AS recall, a > 1 AND cluster_id % 7 = 0 AS fallback FROM wide, range(1, 4) x(a))"""


def _pilot(spark, sf):
    one = lambda name, of, i: F.struct(F.lit(name).alias("action"), F.col(f"q_{of}").alias("f1"), F.col(f"c_{of}").alias("latency"), F.lit(i).alias("a"))
    a = F.explode(F.array(one("A1", "A1", 1), one("A2-V1", "A2", 2), one("A2-V2", "A0", 3))).alias("x")
    t = _table(spark, sf).select("dataset", "cluster_id", "variant_id", a).select("dataset", "cluster_id", "variant_id", "x.*")
    return t.withColumns({"em": (F.col("f1") == 1).cast("double"), "gold": F.when(F.col("dataset") == "hp", (F.col("cluster_id") + F.col("variant_id") + F.col("a")) % 3), "recall": F.when(F.col("cluster_id") % 2 == 0, F.col("variant_id") / 2), "fallback": (F.col("a") > 1) & (F.col("cluster_id") % 7 == 0)})


@query(_PILOT + """ SELECT dataset, action, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(CAST(f1 = 1 AS DOUBLE)), 6) AS em, round(avg(recall), 6) AS recall, round(avg(latency), 6) AS latency, count_if(fallback)::BIGINT AS fallbacks,
        count_if(f1 > b + 0.02::DOUBLE)::BIGINT AS beats, count_if(f1 < b - 0.02::DOUBLE)::BIGINT AS loses, count(*) FILTER (gold = 2) AS gold_2, count(*) FILTER (gold = 1) AS gold_1, count(*) FILTER (gold = 0) AS gold_0
        FROM r JOIN (SELECT dataset, cluster_id, variant_id, f1 AS b FROM r WHERE action = 'A1') USING (dataset, cluster_id, variant_id) GROUP BY 1, 2""", ["wide"])
def pilot_report(spark, sf):
    """A pilot's actions side by side; its second variant is A0's outcomes."""
    return rounded(audits.pilot_report(_pilot(spark, sf)), "f1", "em", "recall", "latency")


@query(_PILOT + """, g AS (SELECT avg(f1) FILTER (action = 'A2-V1') - avg(f1) FILTER (action = 'A1') AS a, avg(f1) FILTER (action = 'A2-V2') - avg(f1) FILTER (action = 'A1') AS b FROM r)
        SELECT round(a, 6) AS gain_first, round(b, 6) AS gain_second, CASE WHEN b - a >= 0.01 THEN 'A2-V2' ELSE 'A2-V1' END AS chosen, CASE WHEN b - a >= 0.01 THEN b ELSE a END >= 0.04 AS passes FROM g""", ["wide"])
def pilot_decision(spark, sf):
    return rounded(audits.pilot_decision(_pilot(spark, sf)), "gain_first", "gain_second")


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract(text, '\p{L}*[éèüöä]\p{L}*', 0) AS a FROM documents),
        t AS (SELECT doc_id, a, ' ' || array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)), ' ') || ' ' AS body FROM w)
        SELECT doc_id, a <> '' AND contains(body, ' ' || lower(a) || ' ') AS apart, a <> '' AND contains(body, ' ' || lower(a) || ' ') AS composed FROM t""")
def unicode_answers(spark, sf):
    """Each text's first word with an accent, searched for where one of the two is decomposed: the answer, or the text."""
    d = st.table(spark, sf, "documents").select("doc_id", "text", F.regexp_extract("text", r"\p{L}*[éèüöä]\p{L}*", 0).alias("a"))
    apart = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "é", "e\u0301"), "è", "e\u0300"), "ü", "u\u0308"), "ö", "o\u0308"), "ä", "a\u0308")
    return d.select("doc_id", text.has_answer(F.array(apart(F.col("a"))), F.col("text")).alias("apart"), text.has_answer(F.array("a"), apart(F.col("text"))).alias("composed"))


# Phases, a model's client, shards and audits

_ASKED = """WITH asked AS (SELECT DISTINCT text AS question, 0 AS kind, text AS t FROM benchmark UNION ALL SELECT DISTINCT text, 1, replace(text, chr(10), ' ') || ' zqzq' FROM benchmark WHERE length(text) % 3 <> 0),
        words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS dl FROM words GROUP BY 1, 2),
        q AS (SELECT question, kind, term, count(*) AS qtf FROM (SELECT question, kind, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS term FROM asked) GROUP BY 1, 2, 3),
        st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(tf) FROM post)::DOUBLE / (SELECT count(*) FROM documents) AS av), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
        bms AS (SELECT question, kind, doc_id, sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 0.9::DOUBLE * (1.0::DOUBLE - 0.4::DOUBLE + 0.4::DOUBLE * dl / av))) AS score FROM post JOIN q USING (term) JOIN dfs USING (term), st GROUP BY 1, 2, 3),
        dns AS (SELECT question, kind, vec_id AS doc_id, list_sum(list_transform(range(0, 64), lambda i: ((length(t) * 31 + i * 17) % 101 / 100.0::DOUBLE - 0.5::DOUBLE) * embedding[i + 1]::DOUBLE)) AS score FROM asked, embeddings),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, kind, src ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT *, 1 AS src FROM bms UNION ALL SELECT *, 2 FROM dns)) WHERE rank <= 50),
        mm AS (SELECT question, kind, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM best WINDOW w AS (PARTITION BY question, kind, src)),
        fus AS (SELECT question, kind, doc_id, sum(s) / 2.0::DOUBLE AS score FROM mm GROUP BY 1, 2, 3),
        fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, kind ORDER BY round(score, 12) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fus) WHERE rank <= 50),"""


def _stand_ins():
    """Models by rule: rewrites add a word but for questions of certain lengths, vectors and scores are arithmetic on lengths."""

    def chat(prompt):
        question = prompt.rsplit("Question: ", 1)[1].removesuffix("\nAnswer:").removesuffix("\nSearch query:")
        line = question.replace("\n", " ")
        raw = (f"{line} zqzq" if len(question) % 3 else line) if prompt.startswith(("Rewrite", "Below")) else "a reply"
        return {"raw": raw, "input_tokens": len(prompt), "output_tokens": len(raw), "prompt_tps": 200.0}

    encode = lambda q: F.array(*[((F.length(q) * 31 + i * 17) % 101 / F.lit(100.0) - 0.5) for i in range(64)])
    cross = lambda q, t: (F.length(t) * 7 + F.length(q) * 31) % 17 / F.lit(17.0)
    return outcomes.Models(chat, encode, cross, rerank_seconds=0.01, retrieval_seconds=0.25)


@query(_ASKED + """ ce AS (SELECT question, doc_id, (length(d.text) * 7 + length(question) * 31) % 17 / 17.0::DOUBLE AS ce FROM (SELECT DISTINCT question, doc_id FROM fu) JOIN documents d USING (doc_id)),
        mx AS (SELECT question, doc_id, max(score) AS score FROM fu WHERE question IN (SELECT question FROM asked WHERE kind = 1) GROUP BY 1, 2),
        ms AS (SELECT question, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM mx WINDOW w AS (PARTITION BY question)),
        pools AS (SELECT question, 'A1' AS action, doc_id, rank FROM fu WHERE kind = 0 AND rank <= 20 UNION ALL SELECT * FROM (SELECT question, 'A2', doc_id, row_number() OVER (PARTITION BY question ORDER BY round(score, 12) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM ms) WHERE rank <= 30),
        ranked AS (SELECT *, count(*) OVER (PARTITION BY question, action) AS passes, row_number() OVER (PARTITION BY question, action ORDER BY ce DESC, rank) AS nr FROM pools JOIN ce USING (question, doc_id)),
        chosen AS (SELECT question, action, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY nr) AS docs, max(passes) AS ce_passes, false AS fallback FROM ranked WHERE nr <= 5 GROUP BY 1, 2),
        every AS (SELECT question, 'A0' AS action, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS docs, 0 AS ce_passes, false AS fallback FROM fu WHERE kind = 0 AND rank <= 5 GROUP BY 1 UNION ALL SELECT * FROM chosen
          UNION ALL SELECT question, 'A2', docs, 0, true FROM chosen WHERE action = 'A1' AND question NOT IN (SELECT question FROM asked WHERE kind = 1))
        SELECT item_id, action, docs, fallback, CAST(ce_passes AS BIGINT) AS ce_passes, CASE WHEN action = 'A2' AND NOT fallback THEN 2 ELSE 1 END AS retrievals, CASE WHEN action = 'A2' THEN 2 ELSE 1 END AS llm_calls FROM every JOIN benchmark ON text = question""")
def outcome_phases(spark, sf):
    """Questions to outcomes in one call: passages of each action, fallbacks and counts of work."""
    b = st.table(spark, sf, "benchmark")
    instances = b.select(F.col("item_id").alias("cluster_id"), F.lit(0).alias("variant_id"), F.col("text").alias("question"), F.array(F.lit("a reply")).alias("answers"))
    root = f"{tables.shared_dir(spark).rstrip('/')}/waymark-phases-{uuid.uuid4().hex}"
    made, _ = outcomes.outcome_table(instances, st.passages(spark, sf), st.index(spark, sf), _stand_ins(), root)
    chosen = made["selection"].join(b.select("item_id", F.col("text").alias("question")), "question").select("item_id", "action", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("docs"))
    rows = made["outcomes"].withColumnRenamed("cluster_id", "item_id")
    return rows.join(chosen, ["item_id", "action"]).select("item_id", "action", "docs", "fallback", "ce_passes", "retrievals", "llm_calls")


@query(_ASKED + """ ce AS (SELECT question, kind, doc_id, rank, row_number() OVER (PARTITION BY question, kind ORDER BY (length(d.text) * 7 + length(question) * 31) % 17 DESC, rank) AS nr, count(*) OVER (PARTITION BY question, kind) AS passes FROM fu JOIN documents d USING (doc_id) WHERE rank <= 20),
        one AS (SELECT question, list(doc_id ORDER BY nr) AS a, max(passes) AS passes FROM ce WHERE kind = 0 AND nr <= 5 GROUP BY 1), two AS (SELECT question, list(doc_id ORDER BY nr) AS b, max(passes) AS passes FROM ce WHERE kind = 1 GROUP BY 1),
        hop AS (SELECT question, a, one.passes AS own, b IS NULL AS fallback, coalesce(two.passes, 0) AS more, CASE WHEN b IS NULL THEN [] ELSE list_filter(b, lambda x: NOT list_contains(a, x))[1:2] END AS f FROM one LEFT JOIN two USING (question)),
        every AS (SELECT question, 'A1' AS action, a AS docs, false AS fallback, own AS ce_passes, 0 AS n_new FROM hop UNION ALL SELECT question, 'A2', (list_concat(list_concat(a[1:3], f), a[4:5]))[1:5], fallback, own + more, len(f) FROM hop)
        SELECT item_id, action, array_to_string(docs, ',') AS docs, fallback, CAST(ce_passes AS BIGINT) AS ce_passes, CAST(n_new AS INTEGER) AS n_new, CASE WHEN action = 'A2' AND NOT fallback THEN 2 ELSE 1 END AS retrievals FROM every JOIN benchmark ON text = question""")
def escalation_outcomes(spark, sf):
    """Questions to outcomes of the two actions in one call: passages, new ones of the second hop, fallbacks and counts of work."""
    b = st.table(spark, sf, "benchmark")
    instances = b.select(F.col("item_id").alias("cluster_id"), F.lit(0).alias("variant_id"), F.col("text").alias("question"), F.array(F.lit("a reply")).alias("answers"))
    root = f"{tables.shared_dir(spark).rstrip('/')}/waymark-phases-{uuid.uuid4().hex}"
    made, _ = outcomes.outcome_table(instances, st.passages(spark, sf), st.index(spark, sf), _stand_ins(), root, made=outcomes.escalation_phases)
    chosen = made["selection"].join(b.select("item_id", F.col("text").alias("question")), "question").select("item_id", "action", "n_new", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("docs"))
    rows = made["outcomes"].withColumnRenamed("cluster_id", "item_id")
    return rows.join(chosen, ["item_id", "action"]).select("item_id", "action", "docs", "fallback", "ce_passes", "n_new", "retrievals")


@query("""SELECT item_id, CASE WHEN item_id % 7 = 3 THEN NULL ELSE 'reply of ' || item_id END AS reply, CASE WHEN item_id % 7 = 3 THEN 'ConnectionError' WHEN item_id % 11 = 5 THEN 'Refused' END AS error,
        CAST(CASE WHEN item_id % 7 = 3 THEN 4 WHEN item_id % 11 = 5 THEN 1 ELSE item_id % 3 + 1 END AS INTEGER) AS attempts FROM benchmark WHERE item_id % 7 = 3 OR item_id % 11 <> 5
        UNION ALL SELECT item_id, NULL, 'Refused', 1 FROM benchmark WHERE item_id % 7 <> 3 AND item_id % 11 = 5""")
def client_replies(spark, sf):
    """Every item's reply from a model that fails at first, for good, or refuses, by rule."""
    seen = {}

    def model(prompt):
        i = int(prompt.split()[-1])
        seen[i] = seen.get(i, 0) + 1
        if i % 7 != 3 and i % 11 == 5:
            raise client.Refused("no")
        if i % 7 == 3 or seen[i] <= i % 3:
            raise ConnectionError("busy")
        return {"reply": f"reply of {i}"}

    rows = st.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("item "), F.col("item_id")).alias("prompt"))
    journal = f"{tables.shared_dir(spark).rstrip('/')}/waymark-journal-{uuid.uuid4().hex}"
    got = client.ask(rows, "prompt", model, "reply string", journal, client.Policy(first_wait=0.001, flush=64))
    # replies come from calls: they are kept, as another evaluation would not be the same
    return tables.written(got.select("item_id", "reply", F.regexp_extract("error", r"^(\w+)", 1).alias("error"), "attempts"), "replies")


@query("""WITH k AS (SELECT vec_id, vec_id // 128 AS s, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings WHERE vec_id NOT BETWEEN 40 AND 49 AND vec_id NOT BETWEEN 250 AND 260),
        g AS (SELECT s, count(*) AS n, min(vec_id) AS lo, max(vec_id) AS hi, min(norm) AS a, max(norm) AS b FROM k GROUP BY 1), w AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY s) + 1, 0) AS due, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g)
        SELECT printf('passages_%05d.parquet', s) AS shard, n, CAST(start AS BIGINT) AS start, CAST(lo AS VARCHAR) AS first_id, CAST(hi AS VARCHAR) AS last_id, round(a, 5) AS low_norm, round(b, 5) AS high_norm,
          CASE WHEN lo <> due OR hi - lo + 1 <> n THEN 'ids ' || lo || ' to ' || hi || ' of ' || n || ' rows do not follow from ' || due END AS wrong FROM w""")
def shard_checks(spark, sf):
    """Vectors in shards of 128 ids, two runs of which are missing: what the inspection says of each shard."""
    own = st.index(spark, sf).filter("doc_id not between 40 and 49 and doc_id not between 250 and 260").select(F.col("doc_id").alias("id"), "embedding")
    folder = f"{tables.shared_dir(spark).rstrip('/')}/waymark-shards-{uuid.uuid4().hex}"
    shards.write_shards(own, folder, 128)
    return rounded(shards.inspect_shards(spark, folder, 64, "passages_*", first=0).drop("path"), "low_norm", "high_norm", digits=5)


_CODE = "CAST('0x' || substr(md5(concat_ws(chr(31), CAST(cluster_id AS VARCHAR), CAST(variant_id AS VARCHAR), action, split, CAST(CAST(round(f1 * 100) AS BIGINT) AS VARCHAR))), 1, 15) AS BIGINT)"


@query(f"""+ r AS (SELECT *, {_CODE} AS code, cluster_id || ':' || variant_id || ':' || action AS key FROM rows), t AS (SELECT dataset, count(*) AS n, CAST(sum(code::HUGEINT) AS VARCHAR) AS digest_sum, bit_xor(code) AS digest_xor FROM r GROUP BY 1),
        b AS (SELECT dataset, key, unnest([{{'i': 'f1 is a share', 'bad': NOT f1 BETWEEN 0 AND 1}}, {{'i': 'cheap actions generate fast', 'bad': action = 'A0' AND generation > 1.4::DOUBLE}}, {{'i': 'retrieval counts hops', 'bad': retrieval <> CAST(action[2:2] AS DOUBLE)}}, {{'i': 'train is answered', 'bad': split = 'train' AND f1 = 0}}]) AS x FROM r)
        SELECT dataset, x.i AS invariant, n, CAST(count_if(x.bad) AS BIGINT) AS violations, min(key) FILTER (x.bad) AS example, digest_sum, digest_xor FROM b JOIN t USING (dataset) GROUP BY dataset, x.i, n, digest_sum, digest_xor""", ["rows"])
def integrity_audit(spark, sf):
    """Invariants of the outcome rows, their violations and each dataset's digest, in one pass."""
    rules = {
        "f1 is a share": F.col("f1").between(0, 1),
        "cheap actions generate fast": (F.col("action") != "A0") | (F.col("generation") <= 1.4),
        "retrieval counts hops": F.col("retrieval") == F.substring("action", 2, 1).cast("double"),
        "train is answered": (F.col("split") != "train") | (F.col("f1") != 0),
    }
    digest = ["cluster_id", "variant_id", "action", "split", F.round(F.col("f1") * 100).cast("long")]
    return integrity.audit(st.outcome_rows(st.instances(spark, sf)), rules, F.concat_ws(":", "cluster_id", "variant_id", "action"), digest, ["dataset"])


@query("""+ x AS (SELECT item_id AS qid, unnest([item_id * 3, item_id * 3 + 1]) AS doc_id FROM benchmark JOIN questions ON qid = item_id), l AS (SELECT 'lexical' AS list, qid, doc_id, rank FROM bm UNION ALL SELECT 'dense', qid, doc_id, rank FROM dn UNION ALL SELECT 'fused', qid, doc_id, rank FROM fu)
        SELECT n.list, x.qid, CAST(20 AS INTEGER) AS k, count(*) AS expected, count(*) FILTER (rank <= 20) AS found, CAST(min(rank) AS BIGINT) AS first_rank, count(*) FILTER (rank <= 20) > 0 AS passed
        FROM x CROSS JOIN (VALUES ('lexical'), ('dense'), ('fused')) n(list) LEFT JOIN l ON l.list = n.list AND l.qid = x.qid AND l.doc_id = x.doc_id GROUP BY 1, 2""", ["bm", "dn", "fu"])
def smoke_retrieval(spark, sf):
    """Whether each question's expected passages are among the first 20 of its three lists."""
    q = st.questions(spark, sf)
    lists = retrieval.hybrid(q, st.passages(spark, sf), st.index(spark, sf))
    return retrieval.smoke(lists, q.select("qid", F.array(F.col("qid") * 3, F.col("qid") * 3 + 1).alias("doc_ids"), F.lit(20).alias("k")))


@query(r"""WITH f AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::DOUBLE AS n_words, CAST(regexp_matches(text, '\d') AS DOUBLE) AS has_digit, (length(text) % 7)::DOUBLE AS odd, (item_id * 7919) % 101 AS a, (item_id * 7919 + 104729) % 101 AS b, (item_id * 7919 + 209458) % 101 AS c FROM benchmark),
        y AS (SELECT *, CASE WHEN a >= greatest(a, b, c) - 2 THEN 0 WHEN b >= greatest(a, b, c) - 2 THEN 1 ELSE 2 END AS label FROM f),
        z AS (SELECT label, unnest([{'f': 'n_words', 'v': (n_words - avg(n_words) OVER ()) / CASE WHEN stddev_pop(n_words) OVER () < 1e-12 THEN 1 ELSE stddev_pop(n_words) OVER () END}, {'f': 'has_digit', 'v': (has_digit - avg(has_digit) OVER ()) / CASE WHEN stddev_pop(has_digit) OVER () < 1e-12 THEN 1 ELSE stddev_pop(has_digit) OVER () END},
          {'f': 'odd', 'v': (odd - avg(odd) OVER ()) / CASE WHEN stddev_pop(odd) OVER () < 1e-12 THEN 1 ELSE stddev_pop(odd) OVER () END}, {'f': 'bias', 'v': 1.0::DOUBLE}]) AS x FROM y)
        SELECT x.f AS feature, j AS class, round(avg(x.v * CAST(label = j AS DOUBLE)), 6) + 0.0 AS observed, round(avg(x.v * CAST(label = j AS DOUBLE)), 6) + 0.0 AS fitted FROM z, (VALUES (0), (1), (2)) c(j) GROUP BY 1, 2""")
def learned_optimum(spark, sf):
    """The learned router at its optimum: what the data hold of each feature and class, and what the model and its penalty make of it, agree."""
    f = text.query_features(F.col("text"))
    label = F.array(*[(F.col("item_id") * 7919 + i * 104729) % 101 for i in range(3)])
    feats = st.table(spark, sf, "benchmark").select(f["n_words"].cast("double").alias("n_words"), f["has_digit"].cast("double").alias("has_digit"), (F.length("text") % 7).cast("double").alias("odd"), label.alias("q"))
    feats = feats.withColumn("label", F.array_position(F.transform("q", lambda x: x >= F.array_max("q") - 2), F.lit(True)).cast("int") - 1)
    model = baselines.fit_optimum(feats, ["n_words", "has_digit", "odd"], "label", 3)
    return rounded(baselines.fitted_moments(feats, model, "label"), "observed", "fitted")


@query("""+ n AS (SELECT dataset, split, cluster_id, count(*) AS n FROM inst GROUP BY 1, 2, 3)
        SELECT dataset, split, count(*) AS clusters, count(*) FILTER (n = 3) AS complete, count(*) FILTER (n < 3) AS skipped, count(*) FILTER (n > 3) AS larger FROM n GROUP BY 1, 2""", ["inst"])
def calibration_coverage(spark, sf):
    """How many clusters of each split a calibration uses and how many it leaves out."""
    return signals.cluster_coverage(st.instances(spark, sf), by=["dataset", "split"])


@query("""+ l AS (SELECT 'lexical' AS list, qid, doc_id, rank FROM bm UNION ALL SELECT 'dense', qid, doc_id, rank FROM dn UNION ALL SELECT 'fused', qid, doc_id, rank FROM fu),
        h AS (SELECT list, qid, rank, ' ' || array_to_string(list_transform(regexp_extract_all(d.text, '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'), lambda t: lower(t)), ' ') || ' ' AS body,
          array_to_string(list_transform(regexp_extract_all(answers[1], '[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]'), lambda t: lower(t)), ' ') AS a FROM l JOIN documents d USING (doc_id) JOIN questions USING (qid)),
        f AS (SELECT list, qid, min(rank) FILTER (a <> '' AND contains(body, ' ' || a || ' ')) AS first FROM h GROUP BY 1, 2)
        SELECT list, CAST(k AS INTEGER) AS k, round(avg(CAST(coalesce(first <= k, false) AS DOUBLE)), 6) AS recall FROM f, (VALUES (1), (5), (10), (20), (50)) v(k) GROUP BY 1, 2""", ["bm", "dn", "fu"])
def smoke_recall(spark, sf):
    """The smoke report's recall of the lexical, dense and fused lists."""
    return rounded(smoke.smoke_report(st.questions(spark, sf), st.passages(spark, sf), st.index(spark, sf))["recall"], "recall")
