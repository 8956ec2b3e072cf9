"""Language of a text, as Bayesian fusion of what speaks for each language.

Evidence: the text (byte trigrams), the language that the markup declares, the suffix of
the address, and a prior of the host.  Host priors are smoothed towards their domain's,
these towards the corpus's, all counted by grouped aggregation of a first, text-only guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import keep
from waymark.llm.words import LOWER, pieces

BUCKETS = 1 << 15
#: A text's trigrams depend on one another: n of them weigh as n / (1 + n / WEIGHT).
WEIGHT = 64.0
#: Share of the uniform model in each language's model; it is all of the undetermined one's.
FLAT = 0.1
#: Counted as so many texts: the next wider prior within a host's or domain's.
PRIOR = 20.0
#: Hosts and domains to broadcast at most.
BROADCAST_ROWS = 100_000
UNDETERMINED = "und"
EVIDENCE = ("declared", "host", "domain", "suffix")
_LETTER = LOWER.copy()
_LETTER[:0x80] = np.where(((_LETTER[:0x80] >= 0x61) & (_LETTER[:0x80] <= 0x7A)), _LETTER[:0x80], 0x20)
_ANY = np.ones(256, bool)


def _trigrams(column: pa.Array) -> Iterator[tuple]:
    """For each piece: bucket of the trigram at each byte (BUCKETS: none), and the piece."""
    for p in pieces(column, _ANY):
        data = _LETTER[p.data].astype(np.uint32)
        code = np.full(len(data), BUCKETS, np.uint32)
        if len(data) > 2:
            gram = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            code[:-2] = np.where(gram == 0x202020, BUCKETS, ((gram * np.uint32(2654435761)) >> np.uint32(17)) % BUCKETS)
            last = p.offsets[1:][np.diff(p.offsets) > 0]
            code[last - 1] = BUCKETS
            code[np.maximum(last - 2, 0)] = BUCKETS
        else:
            code[:] = BUCKETS
        yield code, p


def _count(languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages) + 1) * (BUCKETS + 1), np.int64)
        for batch in batches:
            label = np.array([place.get(x, len(languages)) for x in batch.column(1).to_pylist()], np.int64)
            for code, p in _trigrams(batch.column(0)):
                own = np.repeat(label[p.rows.start : p.rows.stop], np.diff(p.offsets))
                total += np.bincount(own * (BUCKETS + 1) + code, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // (BUCKETS + 1), pa.int32()), pa.array(at % (BUCKETS + 1), pa.int32()), pa.array(total[at], pa.int64())], names=["language", "bucket", "n"])

    return count


def train(rows: DataFrame, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by trigram bucket, from all labelled rows.  Every
    label is a class; the result has BUCKETS numbers for each, whatever the rows."""
    languages = sorted(r[0] for r in rows.filter(F.col(label_col).isNotNull()).select(label_col).distinct().collect())
    model = np.zeros((len(languages) + 1, BUCKETS + 1), np.float32)
    model[-1, :BUCKETS] = -np.log(BUCKETS)
    if not languages:
        return languages, model
    slim = rows.filter(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    found = slim.mapInArrow(_count(languages), "language int, bucket int, n long").filter(f"language < {len(languages)} and bucket < {BUCKETS}").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    n = np.full((len(languages), BUCKETS), 0.5)
    got = found.toArrow().to_pandas()
    n[got["language"], got["bucket"]] += got["n"]
    share = n / n.sum(axis=1, keepdims=True)
    model[:-1, :BUCKETS] = np.log((1 - FLAT) * share + FLAT / BUCKETS)
    return languages, model


def _likelihoods(model):
    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(table)))
            for code, p in _trigrams(batch.column(0)):
                full = np.flatnonzero(np.diff(p.offsets))
                if not len(full):
                    continue
                at = p.offsets[:-1][full]
                n = np.add.reduceat((code < BUCKETS).astype(np.int64), at)
                weight = 1.0 / (1.0 + n / WEIGHT)
                for i in range(len(table)):
                    out[p.rows.start + full, i] = np.add.reduceat(table[i][code].astype(np.float64), at) * weight
            flat = pa.array(out.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(table), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], lists], names=[*batch.schema.names[1:], "likelihoods"])

    return likelihoods


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, least: float = 0.5) -> DataFrame:
    """rows: text, declared, host, domain, suffix (all nullable strings) and any others, which are kept.

    Adds language, confidence (its posterior), text_language (what the text alone says) and
    accepted: not undetermined, and confidence at least ``least``.  Missing evidence (null) says
    nothing.  A null or empty text, or one without letters, is undetermined with confidence 1
    and not accepted.  Long texts are read whole.  Repeated rows each get their result; ties go to the first language in alphabetical order.  Other columns may have any name but
    those that are added."""
    spark = rows.sparkSession
    called = {c: f"_own{i}" for i, c in enumerate(rows.columns) if c not in ("text", *EVIDENCE)}
    rows = rows.select("text", *[F.col(f"`{c}`").alias(called.get(c, c)) for c in rows.columns if c != "text"])
    names = [*languages, UNDETERMINED]
    array = F.array(*[F.lit(x) for x in names])
    others = [c for c in rows.columns if c != "text"]
    lead = rows.select(F.coalesce("text", F.lit("")).alias("text"), *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lead.schema.fields[1:])
    scored = keep(lead.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)), f"{schema}, likelihoods array<double>"), "likelihoods")
    guess = F.array_position(F.col("likelihoods"), F.array_max("likelihoods")).cast("int")
    scored = scored.withColumn("guess", guess)
    one = [F.count_if(F.col("guess") == i + 1).alias(f"n{i}") for i in range(len(names))]
    vector = F.array(*[F.col(f"n{i}").cast("double") for i in range(len(names))])
    total = scored.agg(*one).select(vector.alias("v")).head()[0]
    share = [(x + 1.0) / (sum(total) + len(names)) for x in total]
    corpus = F.array(*[F.lit(x) for x in share])

    def smoothed(v: Column, wider: Column) -> Column:
        n = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(v, wider, lambda x, w: (x + PRIOR * w) / (n + PRIOR))

    def lookup(by: list[str]) -> DataFrame:
        return scored.filter(F.col(by[0]).isNotNull()).groupBy(*by).agg(*one).select(*by, vector.alias("v"))

    domains = lookup(["domain"]).select(F.col("domain"), smoothed(F.col("v"), corpus).alias("domain_prior"))
    hosts = lookup(["host", "domain"]).join(domains, "domain", "left").select("host", "domain", smoothed(F.col("v"), F.coalesce("domain_prior", corpus)).alias("prior"))
    hosts = keep(hosts, "hosts")
    few = hosts.count() <= BROADCAST_ROWS

    def channel(by: str) -> DataFrame:
        """log P(value | language) for each value, from the same counts."""
        logs = [F.log((F.element_at("v", i + 1) + F.lit(PRIOR * 0.05)) / F.lit(total[i] + PRIOR)) for i in range(len(names))]
        return lookup([by]).select(by, F.array(*logs).alias(f"{by}_logs"))

    none = F.array(*[F.lit(0.0)] * len(names))
    found = scored.join(F.broadcast(hosts) if few else hosts, (scored.host == hosts.host) & scored.domain.eqNullSafe(hosts.domain), "left").drop(hosts.host).drop(hosts.domain)
    for by in ("declared", "suffix"):
        values = keep(channel(by), by)
        found = found.join(F.broadcast(values) if values.count() <= BROADCAST_ROWS else values, by, "left")
    logs = _plus(F.col("likelihoods"), F.transform(F.coalesce("prior", corpus), lambda x: F.log(x)))
    for by in ("declared", "suffix"):
        logs = _plus(logs, F.coalesce(f"{by}_logs", none))
    blank = F.array_max("likelihoods") == 0.0
    found = found.withColumn("posterior", _softmax(logs)).withColumn("confidence", F.when(blank, 1.0).otherwise(F.array_max("posterior")))
    best = F.element_at(array, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    found = found.withColumn("language", F.when(blank, UNDETERMINED).otherwise(best))
    back = {v: k for k, v in called.items()}
    return found.select(*[F.col(c).alias(back.get(c, c)) for c in others], "language", F.round("confidence", 6).alias("confidence"), F.when(blank, UNDETERMINED).otherwise(F.element_at(array, F.col("guess"))).alias("text_language"), ((F.col("language") != UNDETERMINED) & (F.col("confidence") >= least)).alias("accepted"))


#: Parts of a page that are not its own words.
_ASIDE = r"(?is)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, domain, suffix of raw pages: the article's words if the page
    has one, the html element's lang, and the parts of the address."""
    main = F.regexp_extract("html", r"(?is)<article\b.*?</article\s*>", 0)
    text = F.regexp_replace(F.when(main != "", main).otherwise(F.col("html")), _ASIDE, " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"), blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), blank(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """The same of documents, whose lang column is what was declared and whose source is the host."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"))
