"""Toxicity by two class-conditional Kneser-Ney bigram models.

Both levels of a class's model rest on continuation counts: a pair counts by how many different words precede it, a word
by how many different words precede it, so copies of a text add nothing.  Each count is discounted, and what
the discounts leave goes to the next level: from pairs to the class's words, and from these to continuation counts that
the whole corpus shares.  Each level sums to one.  With a discount of several contexts, expressions that are rare in a class are left
to the shared counts, which speak for neither class.

A text's passages are its runs of PASSAGE words, and the whole text if it is shorter.  A passage's evidence is the
difference of its two log likelihoods over its length; a text's is that of its worst passage, so that a few words are not
lost in a long text.  One logistic curve, fitted on labelled rows that the counts have not seen, makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import free_name, keep, partitions
from waymark.llm.words import ALNUM, U, Piece, after, mix, pieces

#: Words and rows of labelled texts to learn from at most, drawn by a hash of the text; so the model's size is bounded too.
MAX_WORDS = 4_000_000
MAX_ROWS = 200_000
#: The same of rows to calibrate on.
MAX_CALIBRATE = 1_500_000
#: Words of a passage.
PASSAGE = 3
#: Contexts that are taken off each continuation count.
DISCOUNT = 5
#: Pairs of a task to take together before its distinct ones go on, and bytes of text for each part that counts them.
TOGETHER = 1 << 20
PART = 8 << 20
#: Words that are at least this share of the labelled words are dealt to all parts, by what precedes them.
COMMON = 1e-3
#: Stands before a text's first word.
_START = np.frombuffer(b"<start> ", U)[0]


def _before(p: Piece, words: np.ndarray) -> np.ndarray:
    """The word before each word; at a text's start a mark."""
    before = np.r_[_START, words[:-1]] if len(words) else words.copy()
    before[p.first[:-1][np.diff(p.first) > 0]] = _START
    return before


def _contexts(parts: int, common: np.ndarray):
    """Distinct pairs of words, by part: of each word how many words precede it, and 40 bits of each of them."""

    def send(u: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = u >> U(24)
        part = w % U(parts)
        at = np.minimum(np.searchsorted(common, w), max(0, len(common) - 1))
        if len(common):
            hot = common[at] == w
            part[hot] = (mix(w[hot]) ^ cut[hot]) % U(parts)
        order = np.lexsort((cut, w, part))
        cut, w, part = cut[order], w[order], part[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (cut[1:] != cut[:-1])]
        cut, w, part = cut[new], w[new], part[new]
        heads = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (part[1:] != part[:-1])])
        n = np.diff(np.r_[heads, len(w)]).astype(np.uint32)
        five = cut.view(np.uint8).reshape(-1, 8)[:, :5]
        ends = np.r_[heads, len(w)]
        bounds = np.searchsorted(part[heads], np.arange(parts + 1, dtype=U))
        out = [(k, int(b - a), w[heads[a:b]].tobytes() + n[a:b].tobytes() + five[ends[a] : ends[b]].tobytes()) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "n", "blob"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, ws, size = [], [], 0
        for batch in batches:
            for p in pieces(batch.column(0), ALNUM, lower=True):
                words = p.hashes()
                us.append(_before(p, words))
                ws.append(words)
                size += len(words)
                if size >= TOGETHER:
                    yield from send(np.concatenate(us), np.concatenate(ws))
                    us, ws, size = [], [], 0
        if size:
            yield from send(np.concatenate(us), np.concatenate(ws))

    return contexts


def _count_contexts(sent: pa.Table) -> pa.Table:
    """(w, n): distinct words before each word of one part."""
    ws, cuts = [], []
    for n, blob in zip(sent.column("n").to_pylist(), sent.column("blob").to_pylist(), strict=True):
        each = np.frombuffer(blob, np.uint32, n, 8 * n)
        five = np.zeros((int(each.sum()), 8), np.uint8)
        five[:, :5] = np.frombuffer(blob, np.uint8, -1, 12 * n).reshape(-1, 5)
        ws.append(np.repeat(np.frombuffer(blob, U, n), each))
        cuts.append(five.reshape(-1).view(U))
    w, cut = np.concatenate(ws), np.concatenate(cuts)
    order = np.lexsort((cut, w))
    w, cut = w[order], cut[order]
    w = w[np.r_[True, (w[1:] != w[:-1]) | (cut[1:] != cut[:-1])]]
    heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    return pa.table([pa.array(w[heads].view(np.int64)), pa.array(np.diff(np.r_[heads, len(w)]))], names=["w", "n"])


def continuation_counts(corpus: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """(w, n): for each word (as its hash) of the texts the number of different words that precede it, a text's start being one.
    common: sorted hashes of words so common that one part shouldn't hold them."""
    text = corpus.select("text")
    size = text.agg(F.sum(F.octet_length("text"))).head()[0] or 0  # one number
    parts = max(partitions(corpus.sparkSession), -(-size // PART))
    sent = text.mapInArrow(_contexts(parts, np.zeros(0, U) if common is None else common), "part int, n int, blob binary")
    return sent.groupBy("part").applyInArrow(_count_contexts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (toxic, triple, pair, u, w) of labelled texts: each word with the one and the two before it, as hashes."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for p in pieces(batch.column(0), ALNUM, lower=True):
            words = p.hashes()
            if not len(words):
                continue
            u, label = _before(p, words), toxic[p.rows.start : p.rows.stop][p.doc]
            pair, triple = after(u, words), after(_before(p, u), after(u, words))
            order = np.lexsort((triple, label))
            own = order[np.r_[True, (triple[order][1:] != triple[order][:-1]) | (label[order][1:] != label[order][:-1])]]
            yield pa.RecordBatch.from_arrays([pa.array(label[own], pa.int32()), *[pa.array(x[own].view(np.int64)) for x in (triple, pair, u, words)]], names=["toxic", "triple", "pair", "u", "w"])


def class_pairs(sample: DataFrame) -> DataFrame:
    """(toxic, pair, u, w, n) of texts and their labels: n different words precede the pair u, w."""
    triples = sample.select("text", "toxic").mapInArrow(_triples, "toxic int, triple long, pair long, u long, w long").distinct()
    return triples.groupBy("toxic", "pair", "u", "w").agg(F.count("*").alias("n"))


@dataclass
class Model:
    """log p(w|u, toxic) - log p(w|u, ordinary) is ratio[pair] where the pair has one, else before[u] + alone[w]; words
    without an entry have 0 and rest.  A score is the logistic of bias + slope times a text's evidence."""

    pairs: np.ndarray
    ratio: np.ndarray
    words: np.ndarray
    before: np.ndarray
    alone: np.ndarray
    rest: float
    slope: float = 0.0
    bias: float = 0.0


def _look_up(keys: np.ndarray, values: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of sought keys, and which are known."""
    if not len(keys):
        return np.zeros(len(sought)), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return values[at].astype(np.float64), keys[at] == sought


def evidence(text: pa.Array, m: Model) -> np.ndarray:
    """Of each text the length-normalised difference of its worst passage; 0 without words."""
    out = np.zeros(len(text))
    for p in pieces(text, ALNUM, lower=True):
        words = p.hashes()
        if not len(words):
            continue
        u = _before(p, words)
        s, seen = _look_up(m.pairs, m.ratio, after(u, words))
        alone, known = _look_up(m.words, m.alone, words[~seen])
        before, met = _look_up(m.words, m.before, u[~seen])
        s[~seen] = np.where(known, alone, m.rest) + np.where(met, before, 0.0)
        n = np.diff(p.first)
        full = np.flatnonzero(n)
        sums = np.r_[0.0, np.cumsum(s)]
        # passages begin at each word that leaves room, at the first at least
        last = np.maximum(p.first[1:] - PASSAGE, p.first[:-1])[p.doc]
        start = np.minimum(np.arange(len(s)), last)
        end = np.minimum(start + PASSAGE, p.first[1:][p.doc])
        out[p.rows.start + full] = np.maximum.reduceat((sums[end] - sums[start]) / (end - start), p.first[:-1][full])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton's method with a slight ridge."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (q - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _of(df: DataFrame, *aggs) -> dict:
    return {k: v or 0 for k, v in df.agg(*aggs).head().asDict().items()}


def class_tables(pairs: DataFrame, shared: DataFrame, d: int = DISCOUNT) -> tuple[DataFrame, DataFrame, float]:
    """Of pairs (toxic, pair, u, w, n) and shared continuation counts (w, n): tables (pair, ratio) and (word, alone, before), and the rest's
    ratio; see Model.  What no class has in more than d contexts has no row, as it follows from the level below.  A class without pairs is the shared distribution."""
    total = _of(shared, F.sum("n").alias("t"))["t"] + 1.0  # one for unknown words
    over = lambda c: F.greatest(F.col(c) - F.lit(float(d)), F.lit(0.0))
    most = lambda c: F.least(F.col(c), F.lit(float(d)))
    words = pairs.groupBy("w").agg(*[F.count_if(F.col("toxic") == c).alias(f"k{c}") for c in (0, 1)])
    facts = _of(words, *[x for c in (0, 1) for x in (F.sum(f"k{c}").alias(f"t{c}"), F.sum(most(f"k{c}")).alias(f"l{c}"))])
    left = {c: facts[f"l{c}"] / facts[f"t{c}"] if facts[f"t{c}"] else 1.0 for c in (0, 1)}
    rest = float(np.log(left[1] / left[0]))
    both = pairs.groupBy("pair", "u", "w").agg(*[F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    heads = both.groupBy("u").agg(*[x for c in (0, 1) for x in (F.sum(f"n{c}").alias(f"t{c}"), F.sum(most(f"n{c}")).alias(f"l{c}"))])
    heads = heads.select("u", "t0", "t1", *[F.when(F.col(f"t{c}") > 0, F.col(f"l{c}") / F.col(f"t{c}")).otherwise(1.0).alias(f"a{c}") for c in (0, 1)])
    share = (F.col("n") / F.lit(total)).alias("p")
    own = both.filter(f"n0 > {d} or n1 > {d}").join(heads, "u")
    words = keep(words.join(shared, "w").select("w", "k0", "k1", share), "words")
    known = words.select("w", "k0", "k1", *[(over(f"k{c}") / F.lit(float(facts[f"t{c}"] or 1)) + F.lit(left[c]) * F.col("p")).alias(f"q{c}") for c in (0, 1)])
    chance = {c: over(f"n{c}") / F.greatest(F.col(f"t{c}"), F.lit(1)) + F.col(f"a{c}") * F.col(f"q{c}") for c in (0, 1)}
    ratios = own.join(known, "w").select("pair", F.log(chance[1] / chance[0]).cast("float").alias("ratio"))
    alone = known.filter(f"k0 > {d} or k1 > {d}").select(F.col("w").alias("word"), F.log(F.col("q1") / F.col("q0")).alias("alone"))
    before = heads.filter("a0 < 1 or a1 < 1").select(F.col("u").alias("word"), F.log(F.col("a1") / F.col("a0")).alias("before"))
    table = alone.join(before, "word", "full").select("word", F.coalesce("alone", F.lit(rest)).cast("float").alias("alone"), F.coalesce("before", F.lit(0.0)).cast("float").alias("before"))
    return ratios, table, rest


def _sorted(table: pa.Table, key: str, *values: str) -> list[np.ndarray]:
    keys = table.column(key).to_numpy().view(U)
    order = np.argsort(keys)
    return [keys[order], *[table.column(v).to_numpy()[order] for v in values]]


def train(corpus: DataFrame, labelled: DataFrame) -> Model:
    """corpus: text (all of it, unlabelled); labelled: text, toxic (0 or 1; null: left out), of which texts whose hash is 0 modulo 4 calibrate.

    Equal texts count once for each label.  Labelled texts over MAX_WORDS, MAX_ROWS and MAX_CALIBRATE are thinned by a hash of the text, so
    neither the order of rows nor their number of copies matters.  With one class only, or none, scores are the base rate."""
    spark = corpus.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = labelled.filter("toxic is not null").select(text.alias("text"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(text).alias("h"), (F.octet_length(text) / 6 + 1).alias("words"))
    rows = rows.withColumns({"fold": F.pmod("h", F.lit(4)) == 0, "draw": F.pmod(F.floor(F.col("h") / 4), F.lit(1 << 20))})
    each = keep(rows.groupBy("h", "toxic").agg(F.first("fold").alias("fold"), F.first("draw").alias("draw"), F.first("words").alias("words")), "labelled")
    n = _of(each, *[x for k, c in (("fit", ~F.col("fold")), ("check", F.col("fold"))) for x in (F.sum(F.when(c, F.col("words"))).alias(k), F.count_if(c).alias(f"{k}_n"))])
    share = {k: min(1.0, most / max(n[k], 1), MAX_ROWS / max(n[f"{k}_n"], 1)) for k, most in (("fit", MAX_WORDS), ("check", MAX_CALIBRATE))}
    drawn = F.col("draw") < F.when(F.col("fold"), int((1 << 20) * share["check"])).otherwise(int((1 << 20) * share["fit"]))
    # a bounded number of texts: one for each hash and label
    sample = keep(rows.filter(drawn).groupBy("h", "toxic").agg(F.first("text").alias("text"), F.first("fold").alias("fold")), "sample")
    pairs = keep(class_pairs(sample.filter("not fold")), "pairs")
    tokens = _of(pairs, F.sum("n").alias("n"))["n"]
    # at most 1 / COMMON words come to the driver
    common = np.sort(np.array([r[0] for r in pairs.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON * max(tokens, 1)).select("w").collect()], np.int64).view(U))
    shared = keep(continuation_counts(corpus, common), "shared")
    ratios, table, rest = class_tables(pairs, shared)
    # bounded by MAX_WORDS: a row for each pair and word of the labelled sample
    keys, ratio = _sorted(ratios.toArrow(), "pair", "ratio")
    words, alone, before = _sorted(table.toArrow(), "word", "alone", "before")
    model = Model(keys, ratio, words, before, alone, rest)
    handed = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(evidence(batch.column(0), handed.value))], names=["toxic", "x"])

    got = sample.filter("fold").select("text", "toxic").mapInArrow(weigh, "toxic int, x double").toArrow()
    x, y = got.column("x").to_numpy(), got.column("toxic").to_numpy().astype(float)
    if len(set(y.tolist())) == 2:
        order = np.lexsort((y, x))
        model.slope, model.bias = _logistic(x[order], y[order])
    else:
        rate = (y.sum() + 0.5) / (len(y) + 2)
        model.bias = float(np.log(rate / (1 - rate)))
    return model


def score(rows: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """rows without the text, with its toxicity (0 to 1).  Null and empty texts have no evidence and score
    what the curve says of none; every row gets a score, repeated rows the same.  Long texts are scored whole.  If rows has a column of the name, an underscore is added."""
    name = free_name(rows, name)
    handed = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = handed.value
            s = 1 / (1 + np.exp(-np.clip(m.bias + m.slope * evidence(batch.column(0), m), -35, 35)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], pa.array(s)], names=[*batch.schema.names[1:], name])

    rest = [c for c in rows.columns if c != text_col]
    slim = rows.select(text_col, *rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(scored, f"{schema}, {name} double")
