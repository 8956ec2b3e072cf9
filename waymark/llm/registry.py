"""The queries opN_<name> with their production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import languages, sql, toxicity
from waymark.llm.audit import audit_report
from waymark.llm.centroids import cluster_report, kmeans
from waymark.llm.decontaminate import contaminated
from waymark.llm.forest import link_vectors
from waymark.llm.hilbert import hilbert_shards
from waymark.llm.licenses import license_scan
from waymark.llm.mixing import mix_documents
from waymark.llm.order_minhash import near_copies
from waymark.llm.spotsigs import edited_likeness
from waymark.llm.store import keep
from waymark.llm.substrings import cut_repeats
from waymark.llm.url_lists import listed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and every page, by text models trained on the documents."""
    docs = table(spark, sf_dir, "documents")
    names, model = languages.train(docs, "text", "lang")
    none = F.lit(None).cast("long")
    pages = languages.page_evidence(table(spark, sf_dir, "pages"))
    rows = languages.document_evidence(docs).withColumn("page_id", none).unionByName(pages.withColumn("doc_id", none))
    found = languages.identify(rows, names, model)
    return found.select("doc_id", "page_id", "declared", "language", "confidence", "text_language", "accepted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's weight and probability under raked source, language and topic marginals, and whether it is drawn."""
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equally many rows along a Hilbert curve over source, language, size and id."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    slim = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    # texts are read once; what the curve needs is small
    out = hilbert_shards(keep(slim, "slim"), ["source", "lang", "size", "doc_id"], 8, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return license_scan(table(spark, sf_dir, "documents"))


#: The query's lists, as the tables hold none: of each host with first page id m, if m mod 3 = 0, one entry that adds
#: it on day 53 m mod 300 of 2024 and one that removes it 10 to 99 days later; if m mod 6 = 0 it is added again
#: 30 days after that.  Domains are added on a day from their first page's id, for 20 days.
def url_entries(pages: DataFrame) -> DataFrame:
    day0 = F.lit("2024-01-01").cast("date")
    url = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    m = F.col("m")
    hosts = pages.select("page_id", url.alias("pattern")).groupBy("pattern").agg(F.min("page_id").alias("m")).filter("pattern <> '' and m % 3 = 0")
    add = (m * 53 % 300).cast("int")
    drop = add + 10 + (m % 90).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in ("ads", "malware", "adult", "spam")]), (m % 4 + 1).cast("int"))
    turns = F.array(F.struct(F.lit("add").alias("action"), add.alias("d")), F.struct(F.lit("remove").alias("action"), drop.alias("d")), F.struct(F.when(m % 6 == 0, "add").otherwise("remove").alias("action"), (drop + 30).alias("d")))
    rows = hosts.select(name.alias("list"), "pattern", F.explode(turns).alias("t"))
    domains = pages.select("page_id", F.regexp_extract(url, r"([^.]+\.[^.]+)$", 1).alias("pattern")).groupBy("pattern").agg(F.min("page_id").alias("m")).filter("pattern <> ''")
    at = (m * 97 % 330).cast("int")
    both = F.array(F.struct(F.lit("add").alias("action"), at.alias("d")), F.struct(F.lit("remove").alias("action"), (at + 20).alias("d")))
    rows = rows.unionByName(domains.select(F.lit("domains").alias("list"), "pattern", F.explode(both).alias("t")))
    return rows.select("list", "pattern", "t.action", F.date_add(day0, F.col("t.d")).alias("dated"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's host, or a domain above it, was listed on the day it was fetched (37 page_id mod 366 days into 2024)."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetched"))
    found = listed(captures, url_entries(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies (alignment of 0.8 or more over five-word shingles) of every document."""
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    few = labels.count() <= 500_000
    labelled = docs.select("doc_id", "text").join(F.broadcast(labels) if few else labels, "doc_id").filter(code % 5 != 0)
    model = toxicity.train(docs, labelled.select("text", "toxic"))
    held = F.coalesce(code % 5 == 0, F.lit(False))
    return toxicity.score(docs.select("text", "doc_id", held.alias("held_out")), model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a window of 13 that also starts in an earlier document go."""
    return cut_repeats(table(spark, sf_dir, "documents"), length=13, with_text=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names or units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "coverage", "n_slots", "verbatim")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs of every document and of its edited text, and how alike they and the next document's are."""
    return edited_likeness(table(spark, sf_dir, "documents"))


def op11_persistent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by a rule of its rows' ids."""
    return audit_report(table(spark, sf_dir, "conversations"))


def op12_pca_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty integer centroids after five rounds, and every vector's nearest."""
    found, centers = kmeans(table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    return cluster_report(found, centers)


def op13_forest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between all vectors of a label, and their components."""
    return link_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_license_scan": op4_license_scan,
    "op5_url_lists": op5_url_lists,
    "op6_order_minhash": op6_order_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_spotsigs": op10_spotsigs,
    "op11_persistent_audit": op11_persistent_audit,
    "op12_pca_centroids": op12_pca_centroids,
    "op13_forest_links": op13_forest_links,
}

ORACLE = {
    "op3_sharding": sql.sharding(),
    "op4_license_scan": sql.license_scan(),
    "op5_url_lists": r"""
        WITH p AS (
          SELECT DISTINCT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host,
                 CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched FROM pages
        ), hosts AS (
          SELECT host AS pattern, min(page_id) AS m FROM p WHERE host <> '' GROUP BY host HAVING min(page_id) % 3 = 0
        ), domains AS (
          SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS pattern, min(page_id) AS m FROM p GROUP BY 1
        ), spans AS (
          SELECT (['ads', 'malware', 'adult', 'spam'])[m % 4 + 1] AS list, pattern, m * 53 % 300 AS a, m * 53 % 300 + 10 + m % 90 AS b FROM hosts
          UNION ALL
          SELECT (['ads', 'malware', 'adult', 'spam'])[m % 4 + 1], pattern, m * 53 % 300 + 40 + m % 90, NULL FROM hosts WHERE m % 6 = 0
          UNION ALL
          SELECT 'domains', pattern, m * 97 % 330, m * 97 % 330 + 20 FROM domains WHERE pattern <> ''
        ), hits AS (
          SELECT p.page_id, s.list, CAST(DATE '2024-01-01' + CAST(s.a AS INTEGER) AS DATE) AS since
          FROM p JOIN spans s ON p.host = s.pattern OR p.host LIKE '%.' || s.pattern
          WHERE p.page_id * 37 % 366 >= s.a AND (s.b IS NULL OR p.page_id * 37 % 366 < s.b)
        ), g AS (
          SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max(since) AS since FROM hits GROUP BY page_id
        )
        SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, g.since IS NOT NULL AS blocked, coalesce(g.lists, '') AS lists, CAST(g.since AS VARCHAR) AS since
        FROM p LEFT JOIN g USING (page_id)
    """,
    "op8_substring_dedup": r"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), g AS (
          SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
        ), f AS (
          SELECT h, min(doc_id) AS first_id FROM g GROUP BY h
        ), c AS (
          SELECT DISTINCT g.doc_id, g.i + r.j AS i FROM g JOIN f USING (h) CROSS JOIN range(13) AS r(j) WHERE f.first_id < g.doc_id
        ), x AS (
          SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
        ), k AS (
          SELECT x.doc_id, count(*) AS n_kept, string_agg(x.word, ' ' ORDER BY x.i) AS kept
          FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id
        )
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id
    """,
    "op11_persistent_audit": sql.persistent_audit(),
    "op12_pca_centroids": sql.centroids(),
    "op13_forest_links": sql.vector_links(),
}
