"""From raw documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; docs are its
predecessor's rows, written as Parquet and read again.  All but the last return the columns
of documents, rows without a verdict against them unchanged.  In every stage other columns are left out, whatever their names, an
empty table gives an empty one, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import languages
from waymark.llm.decontaminate import contaminated
from waymark.llm.hilbert import hilbert_shards
from waymark.llm.mixing import mix_documents
from waymark.llm.order_minhash import near_copies
from waymark.llm.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of documents to broadcast at most.
BROADCAST_IDS = 500_000


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it is small; else joined by a shuffle."""
    ids = keep(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go, as empty ones do."""
    docs = docs.select(*COLUMNS)
    names, model = languages.train(docs, "text", "lang")
    rows = languages.document_evidence(docs).withColumn("row_hash", F.xxhash64("text"))
    found = languages.identify(rows, names, model)
    bad = _few(found.filter(~F.col("accepted")).select(F.col("doc_id").alias("b_id"), F.col("row_hash").alias("b_hash")).distinct())
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("b_id")) & (F.xxhash64(docs.text) == F.col("b_hash")), "left_anti").select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least id.  Rows without an id stay, and rows of one id
    whose texts differ; of those that agree in id and text one stays."""
    docs = docs.select(*COLUMNS)
    found = keep(near_copies(docs).filter("doc_id <> class_id").select("doc_id").distinct(), "copies")
    kept = docs.join(_few(found), "doc_id", "left_anti")
    # rows that share the id and the text are copies too
    many = _few(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    once = kept.join(many, "doc_id", "left_anti")
    again = kept.join(many, "doc_id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    return once.select(*COLUMNS).unionByName(again.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = docs.select(*COLUMNS)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = _few(found.select(F.col("doc_id").alias("b_id"), F.col("row_hash").alias("b_hash")).distinct())
    return docs.join(bad, docs.doc_id.eqNullSafe(F.col("b_id")) & (F.xxhash64(docs.text) == F.col("b_hash")), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that the tokens meet the target shares of sources, languages and topics.  Nulls are a class of
    their own, empty texts stay, repeated rows share their fate."""
    mixed = mix_documents(docs.select(*COLUMNS))
    return mixed.filter(mixed.columns[-1]).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards along a Hilbert curve: the columns of documents, curve, shard and slot.  Nulls come first, ties go by id and
    size, and every row has a place, repeated ones too."""
    return hilbert_shards(docs.select(*COLUMNS), ["source", "lang", "n_chars", "doc_id"], 8, ["doc_id", "n_chars"])


STAGES = [
    ("language_id", language_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained models, sketches and raked weights are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
