"""The relations of the experiment, made from the tables at hand.

Instances are events: three in a row are a cluster of phrasings, and errors leave clusters
incomplete.  Outcomes and raw signals are integer arithmetic on ids, so that every
engine computes the same doubles.  Questions are benchmark items, passages documents, and vectors embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.config import V3

SIGNALS = V3.signals
#: Of each signal: multiplier, share of a cluster's phrasings in its thousandths, multiplier of a phrasing.
_MADE = {"S1": (7919, 100, 37), "S2": (104729, 300, 41), "S3": (1299709, 400, 43), "S4": (15485863, 500, 47)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, cluster_id, variant_id, dataset, split and raw signals."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    c = F.expr("event_id div 3")
    part = c * 7919 % 10
    signals = [((c * p % (1000 - own) + F.col("event_id") * q % own) / F.lit(1000.0)).alias(s) for s, (p, own, q) in _MADE.items()]
    return e.select("event_id", c.alias("cluster_id"), (F.col("event_id") % 3).cast("int").alias("variant_id"), F.when(c % 2 == 0, "hp").otherwise("nq").alias("dataset"), F.when(part < 6, "train").when(part < 8, "val").otherwise("test").alias("split"), *signals)


def outcome_rows(inst: DataFrame) -> DataFrame:
    """Long outcomes: action, f1, and costs in two fields."""
    a = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("a")
    t = inst.select("event_id", "cluster_id", "variant_id", "dataset", "split", a)
    f1 = (F.col("event_id") * 7919 + F.col("a") * 104729) % 101 / F.lit(100.0)
    return t.select("cluster_id", "variant_id", "dataset", "split", F.concat(F.lit("A"), F.col("a")).alias("action"), f1.alias("f1"), F.col("a").cast("double").alias("retrieval"), (1.0 + (F.col("event_id") * 31 + F.col("a") * 17) % 50 / F.lit(100.0)).alias("generation"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, answers (one: its third to fifth words) and vector."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    answer = F.array_join(F.slice(F.split(F.col("text"), r"\s+"), 3, 3), " ")
    return b.join(e, "item_id").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.array(answer).alias("answers"), "vector")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


#: The same for DuckDB, each a WITH item; later ones use earlier ones.
SQL = {
    "inst": "inst AS (SELECT event_id, event_id // 3 AS cluster_id, CAST(event_id % 3 AS INTEGER) AS variant_id, "
    "CASE WHEN (event_id // 3) % 2 = 0 THEN 'hp' ELSE 'nq' END AS dataset, "
    "CASE WHEN (event_id // 3) * 7919 % 10 < 6 THEN 'train' WHEN (event_id // 3) * 7919 % 10 < 8 THEN 'val' ELSE 'test' END AS split, "
    + ", ".join(f"((event_id // 3) * {p} % {1000 - own} + event_id * {q} % {own}) / 1000.0::DOUBLE AS {s}" for s, (p, own, q) in _MADE.items())
    + " FROM events WHERE event_type <> 'error')",
    "long": "long AS (SELECT dataset, split, cluster_id, variant_id, signal, value FROM inst UNPIVOT (value FOR signal IN (S1, S2, S3, S4)))",
    "scalers": "scalers AS (SELECT dataset, signal, quantile_cont(value, 0.05::DOUBLE) AS p5, quantile_cont(value, 0.95::DOUBLE) AS p95 FROM long WHERE split = 'train' GROUP BY 1, 2)",
    "slong": "slong AS (SELECT l.*, (value - p5) / (p95 - p5 + 1e-9::DOUBLE) AS raw, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - p5) / (p95 - p5 + 1e-9::DOUBLE))) AS s FROM long l JOIN scalers USING (dataset, signal))",
    "scaled": "scaled AS (SELECT dataset, split, cluster_id, variant_id, " + ", ".join(f"max(s) FILTER (signal = '{s}') AS {s}" for s in SIGNALS) + " FROM slong GROUP BY 1, 2, 3, 4)",
    "rows": "rows AS (SELECT dataset, split, cluster_id, variant_id, 'A' || a AS action, (event_id * 7919 + a * 104729) % 101 / 100.0::DOUBLE AS f1, "
    "a::DOUBLE AS retrieval, 1.0::DOUBLE + (event_id * 31 + a * 17) % 50 / 100.0::DOUBLE AS generation FROM inst, (VALUES (0), (1), (2)) v(a))",
    "wide": "wide AS (SELECT dataset, split, cluster_id, variant_id, " + ", ".join(f"max(f1) FILTER (action = '{a}') AS q{a[1]}, max(retrieval + generation) FILTER (action = '{a}') AS c{a[1]}" for a in V3.actions) + " FROM rows GROUP BY 1, 2, 3, 4)",
    "complete": "complete AS (SELECT cluster_id FROM inst GROUP BY 1 HAVING count(*) = 3)",
    "routed": "routed AS (SELECT w.*, (S1 + S2 + S3 + S4) / 4.0::DOUBLE AS score, CAST((S1 + S2 + S3 + S4) / 4.0::DOUBLE >= 0.4::DOUBLE AS INTEGER) + CAST((S1 + S2 + S3 + S4) / 4.0::DOUBLE >= 0.6::DOUBLE AS INTEGER) AS i FROM wide w JOIN scaled USING (dataset, split, cluster_id, variant_id))",
    "questions": r"questions AS (SELECT b.item_id AS qid, b.text AS question, [array_to_string((regexp_split_to_array(b.text, '\s+'))[3:5], ' ')] AS answers, e.embedding AS vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)",
    "post": r"terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id) AS dl FROM terms GROUP BY 1, 2)",
    "bm": r"q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS term FROM questions) GROUP BY 1, 2), "
    "st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(tf) FROM post)::DOUBLE / (SELECT count(*) FROM documents) AS av), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), "
    "bms AS (SELECT qid, doc_id, sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 0.9::DOUBLE * (1.0::DOUBLE - 0.4::DOUBLE + 0.4::DOUBLE * dl / av))) AS score FROM post JOIN q USING (term) JOIN dfs USING (term), st GROUP BY 1, 2), "
    "bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bms) WHERE rank <= 50)",
    "dn": "dns AS (SELECT qid, vec_id AS doc_id, list_sum(list_transform(range(1, len(vector) + 1), lambda i: vector[i]::DOUBLE * embedding[i]::DOUBLE)) AS score FROM questions, embeddings), "
    "dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dns) WHERE rank <= 50)",
    "fu": "mm AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s "
    "FROM (SELECT qid, doc_id, score, 1 AS src FROM bm UNION ALL SELECT qid, doc_id, score, 2 FROM dn) WINDOW w AS (PARTITION BY qid, src)), "
    "fus AS (SELECT qid, doc_id, sum(s) / 2.0::DOUBLE AS score FROM mm GROUP BY 1, 2), "
    "fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM fus) WHERE rank <= 50)",
}
_NEEDS = {"long": ["inst"], "scalers": ["long"], "slong": ["scalers"], "scaled": ["slong"], "rows": ["inst"], "wide": ["rows"], "complete": ["inst"], "routed": ["wide", "scaled"], "bm": ["questions", "post"], "dn": ["questions"], "fu": ["bm", "dn"]}


def with_sql(body: str, *names: str) -> str:
    """body behind the WITH items that it names and those that they need."""
    order: list[str] = []

    def add(x: str) -> None:
        for y in _NEEDS.get(x, []):
            add(y)
        if x not in order:
            order.append(x)

    for x in names:
        add(x)
    return "WITH " + ", ".join(SQL[x] for x in order) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
