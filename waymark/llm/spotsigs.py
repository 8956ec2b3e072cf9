"""SpotSigs: a text as the set of short chains of content words that follow anchors.

Anchors are common words, the text's start, and one in ANCHOR_SHARE of all words, told by a hash, so that texts of any length
and language have some.  Built from DataFrame functions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.hilbert import places
from waymark.llm.store import keep

# Common words.
COMMON = "the is that of and to in a an are as at be by for from has he it its on or was were with this you not der die und ist zu das den dem des ein eine von mit auf für im nicht sich auch le est la de et les un une du en qui dans par pour sur au el que los y lo las una del al por con su para se es".split()
#: Content words of a chain, and how many words after the anchor they are looked for among.
CHAIN, SPAN = 2, 8
ANCHOR_SHARE = 8
_LEAST = -(1 << 63)


def with_spots(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a text column's signatures: sorted 32-bit hashes of an anchor and the first CHAIN words of the SPAN after
    it that are not common (fewer at the end).  A text without a content word after an anchor has one signature, of all its words, so
    texts of nothing but common words, and empty ones, are like their equals only."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    out = df.select(*kept, F.concat(F.array(F.lit("")), words).alias("_words"))
    w = F.col("_words")
    anchor = lambda x: x.isin("", *COMMON) | (F.pmod(F.hash(x), F.lit(ANCHOR_SHARE)) == 0)
    chain = lambda i: F.slice(F.filter(F.slice(w, i + 2, F.lit(SPAN)), lambda x: ~x.isin(*COMMON)), F.lit(1), F.lit(CHAIN))
    spots = F.filter(F.transform(w, lambda x, i: F.when(anchor(x), F.struct(x.alias("a"), chain(i).alias("c")))), lambda s: F.size(s["c"]) > 0)
    out = out.select(*kept, "_words", spots.alias("_spots"))
    hashes = F.when(F.size("_spots") > 0, F.transform("_spots", lambda s: F.hash(s))).otherwise(F.array(F.hash(F.lit("="), w)))
    return out.select(*kept, F.array_sort(F.array_distinct(hashes)).alias(name))


def fingerprint(signatures: Column) -> Column:
    """All signatures of a set, eight hex digits each."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of signatures."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spots, next_head (the first floor(n / 4) code points of the text that follows, n being
    this one's), next_spots.  Order: ascending id, then a hash of the text; the first follows the last.  Equal rows
    count once in the order and each get the same result.  Null texts are empty; a null id comes first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # k stands for the id and is never null, so that all joins are on the same plain keys
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(_LEAST)))
    h = F.xxhash64("text")
    slim = rows.select("k", h.alias("h"), F.floor(F.length("text") / 4).cast("int").alias("head")).distinct()
    placed = keep(places(slim, ["k", "h"], "order"), "placed")
    n = placed.count()
    before = placed.select(F.col("k").alias("p_k"), F.col("h").alias("p_h"), F.col("head").alias("p_head"), F.pmod(F.col("_place") + 1, F.lit(max(1, n))).alias("_place"))
    pairs = placed.join(before, "_place").select("k", "h", "p_k", "p_h", "p_head")
    # signatures are made once, after the exchange of texts, which both joins read; each goes to its own row and to the one before
    own = rows.select("k", "text", h.alias("h"))
    once = with_spots(own.join(pairs, ["k", "h"]), "text", "spots")
    null = lambda kind: F.lit(None).cast(kind)
    mine = F.struct("k", "h", F.col("spots").alias("spots"), null("string").alias("next_head"), null("array<int>").alias("next_spots"))
    theirs = F.struct(F.col("p_k").alias("k"), F.col("p_h").alias("h"), null("array<int>").alias("spots"), F.expr("substring(text, 1, p_head)").alias("next_head"), F.col("spots").alias("next_spots"))
    sent = once.select(F.explode(F.array(mine, theirs)).alias("x")).select("x.*")
    got = sent.groupBy("k", "h").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("spots", "next_head", "next_spots")])
    return own.join(got, ["k", "h"]).select(F.nullif("k", F.lit(_LEAST)).alias("doc_id"), "text", "spots", "next_head", "next_spots")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the next text's
    head, and their likeness."""
    n = F.length("text")
    rows = with_next(docs, id_col, text_col).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), "next_head"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", F.col("spots").alias("a"), "next_spots")
    rows = with_spots(rows, "edited", "b")
    return rows.select(F.col("doc_id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_spots")).alias("near_next"))


def spot_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, spots): texts with equal fingerprints are one class, named by its least id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_spots(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), "text", "spots").drop("text")
    least = rows.filter("doc_id is not null").groupBy("spots").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "spots", "left").select("doc_id", "class_id", "spots")


def like_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a < b, likeness) of class representatives whose sets' Jaccard is at least ``least``: all of them.

    Sets meet only if one of their rarest signatures is common to both (of n the n - ceil(least n) + 1
    rarest must hold one) and their sizes are in the same or neighbouring parts of a geometric
    partition with ratio ``least``; sizes are compared before sets are."""
    own = keep(spot_classes(docs, id_col, text_col).filter("doc_id = class_id").select(F.col("class_id").alias("id"), "spots").dropDuplicates(["id"]), "spots")
    tokens = own.select("id", F.size("spots").alias("n"), F.explode("spots").alias("t"))
    count = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ranked = tokens.join(count, "t").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    heads = ranked.select("id", "n", F.floor(F.log(F.col("n").cast("double")) / -log(least)).cast("int").alias("part"), F.explode(F.expr(f"slice(o, 1, n - cast(ceil({least}D * n - 1e-9D) as int) + 1)")).alias("h")).select("id", "n", "part", F.col("h.t").alias("t"))
    a = heads.select("t", F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    b = heads.select("t", F.col("id").alias("b"), F.col("n").alias("nb"), "part")
    pairs = a.join(b, ["t", "part"]).filter(f"a <> b and na <= nb and na >= {least}D * nb - 1e-9D").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = pairs.join(own.select(F.col("id").alias("a"), F.col("spots").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("spots").alias("y")), "b")
    return sides.select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).filter(F.col("likeness") >= least)
