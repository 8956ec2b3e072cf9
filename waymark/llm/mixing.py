"""Mixing documents to target weights by iterative proportional fitting.

Built from DataFrame functions only.  Token counts are gathered into cells of source,
language and topic once; the fit then works on cells.  Sources may be many, so their
factors stay in a table; languages and topics are few, and theirs are literals.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import free_name, hidden, keep

# What a text is about: the first topic of which it holds a term; else other.
TOPICS = {
    "legal": ("icense", "opyright", "ights reserved"),
    "contact": ("@",),
    "web": ("http", "www.", ".com"),
    "table": (" | ",),
    "code": ("{", ";\n", "()"),
    "question": ("?",),
}
OTHER = "other"
MISSING = "missing"
#: Rounds before a share counts as out of reach, and how near a marginal must come to its target.
ROUNDS = 40
CLOSE = 1e-5
#: The factor of a language or topic that is drawn whole.
WHOLE = 1e6
#: Shares to try, each 0.8 of the one before; targets that contradict one another (a source of one language alone, say) are out of reach at any, and warned of.
ATTEMPTS = 5


@dataclass
class Targets:
    """Target shares.  A power tempers the corpus's own shares (1: as they are, 0: all equal): the lower, the more sources, languages
    and topics are drawn whole, as they have less than their share."""

    source_power: float = 0.7
    language: dict[str, float] | None = None
    topic: dict[str, float] | None = None
    power: float = 0.7


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """The first topic of which text holds a term; other without any."""
    out = F.lit(OTHER)
    for topic, terms in reversed(topics.items()):
        out = F.when(reduce(or_, [F.contains(text, F.lit(t)) for t in terms]), topic).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Tokens are estimated as a quarter of the UTF-8 bytes, as no tokenizer runs here; at least 1 of a text that isn't empty."""
    return F.ceil(F.octet_length(text) / 4).cast("double")


def tempered(totals: dict[str, float], power: float, given: dict[str, float] | None = None) -> dict[str, float]:
    """Target shares over the keys of totals: given ones, where there are any, or tempered totals."""
    raw = {k: (given.get(k, 0.0) if given else v**power if v > 0 else 0.0) for k, v in totals.items()}
    s = sum(raw.values())
    return {k: v / s if s else 0.0 for k, v in raw.items()}


def filled(have: dict[str, float], shares: dict[str, float], wanted: float) -> tuple[dict[str, float], set[str]]:
    """How much of each class to draw, and which are drawn whole: wanted is dealt out by shares, and a class that has less than its part
    gives what it has, its rest dealt out to the others."""
    out, whole, left = {x: 0.0 for x in have}, set(), wanted
    while True:
        rest = {x: p for x, p in shares.items() if x not in whole and p > 0}
        total = sum(rest.values())
        out |= {x: left * p / total for x, p in rest.items()}
        over = {x for x in rest if out[x] >= have[x] * (1 - 1e-12)}
        if not over:
            return out, whole
        out |= {x: have[x] for x in over}
        whole |= over
        left -= sum(have[x] for x in over)


@dataclass
class Rake:
    """What raking found: a document of a cell is drawn with the chance min(1, factor x languages x topics), factors being a
    table (source, factor).  share: of all tokens, how many are then expected; off: the furthest that a marginal is from
    its target, as a share; rounds: jobs; whole: the languages and topics that are drawn whole; sources: how many sources are."""

    factors: DataFrame
    languages: dict[str, float]
    topics: dict[str, float]
    share: float
    off: float
    rounds: int
    whole: dict[str, set[str]]
    sources: int


def _step(goal: float, capped: float, free: float) -> float:
    """The factor for what isn't capped, so that both are the goal; where caps alone exceed it, all falls in proportion."""
    if free <= 0 and capped <= goal * (1 + 1e-12):
        return 1.0
    return min(1e6, max(1e-6, (goal - capped) / free if goal > capped and free > 0 else goal / (capped + free)))


def rake(cells: DataFrame, targets: Targets, share: float = 0.8) -> Rake:
    """cells: source, lang, topic, tokens.  Iterative proportional fitting of chances that are at most 1: the expected tokens of
    each source, language and topic are its target, and ``share`` of all tokens are expected.

    A class that has fewer tokens than its target share is drawn whole, and the others' targets share out the rest, so a rare class
    never makes the sample small.  Only where targets contradict one another (a class to be drawn whole stands in one to be
    drawn thinly) fewer tokens are tried.  A round is one job: each source's factor is solved for in its own row, its capped
    cells fixed, and only sums by language and topic reach the driver, at most the languages times the topics."""
    own = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()  # languages times topics
    sums = {(r["lang"], r["topic"]): r["tokens"] for r in own}
    langs, topics = sorted({a for a, _ in sums}), sorted({b for _, b in sums})
    rows = keep(cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"), F.sum("tokens").alias("tokens")), "sources")
    raw = F.pow("tokens", F.lit(targets.source_power))
    all_raw, total = rows.agg(F.sum(raw), F.sum("tokens")).head()
    if not total:
        return Rake(rows.select("source", F.lit(1.0).alias("factor")), {}, {}, 0.0, 0.0, 0, {"lang": set(), "topic": set()}, 0)
    have_l, have_t = {x: sum(sums.get((x, t), 0.0) for t in topics) for x in langs}, {x: sum(sums.get((l, x), 0.0) for l in langs) for x in topics}
    share_l, share_t = tempered(have_l, targets.power, targets.language), tempered(have_t, targets.power, targets.topic)
    share = min(share, *(sum(have[x] for x in have if shares[x] > 0) / total for have, shares in ((have_l, share_l), (have_t, share_t))))

    def level(wanted: float) -> tuple[float, int]:
        """What a unit of a source's raw share is worth in tokens, and how many sources are drawn whole: a few jobs, as each can but add some."""
        rate, whole = wanted / all_raw, 0
        while True:
            over = F.col("tokens") <= raw * F.lit(rate) * (1 + 1e-12)
            n, have, free = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, raw)), F.lit(0.0))).head()
            if n == whole or free <= 0:
                return rate, n
            rate, whole = (wanted - have) / free, n

    def factor(b: dict, c: dict, rate: float) -> Column:
        """A source's factor, so that its expected tokens are its goal: rate for a unit of its raw share, at most all it has."""
        lang, topic = (F.create_map(*[F.lit(y) for k, v in x.items() for y in (k, v)]) for x in (b, c))
        # the largest factors first: while one would be over 1, its cell is capped and the rest is solved for
        each = F.array_sort(F.transform("cells", lambda x: F.named_struct(F.lit("r"), -F.element_at(lang, x["lang"]) * F.element_at(topic, x["topic"]), F.lit("n"), x["tokens"])))
        goal = F.least(F.col("tokens"), raw * F.lit(rate))
        start = F.named_struct(F.lit("g"), goal, F.lit("s"), F.aggregate(each, F.lit(0.0), lambda a, x: a - x["r"] * x["n"]), F.lit("done"), F.lit(False), F.lit("left"), F.size("cells"))

        def cap(a: Column, x: Column) -> Column:
            over = ~a["done"] & (-x["r"] * a["g"] > a["s"])
            return F.named_struct(F.lit("g"), F.when(over, a["g"] - x["n"]).otherwise(a["g"]), F.lit("s"), F.when(over, a["s"] + x["r"] * x["n"]).otherwise(a["s"]), F.lit("done"), ~over, F.lit("left"), a["left"] - over.cast("int"))

        return F.aggregate(each, start, cap, lambda a: F.when(a["left"] > 0, a["g"] / a["s"]).otherwise(1e12))

    n, tried = 0, []
    for _ in range(ATTEMPTS):
        wanted, trail = share * total, []
        goal_l, whole_l = filled(have_l, share_l, wanted)
        goal_t, whole_t = filled(have_t, share_t, wanted)
        rate, sources = level(wanted)
        # what is drawn whole has a factor beyond all others
        b, c = ({x: WHOLE if x in whole else 1.0 for x in names} for names, whole in ((langs, whole_l), (topics, whole_t)))
        for _ in range(ROUNDS):
            n += 1
            chance = F.col("f") * F.element_at(F.create_map(*[F.lit(y) for kv in b.items() for y in kv]), F.col("c.lang")) * F.element_at(F.create_map(*[F.lit(y) for kv in c.items() for y in kv]), F.col("c.topic"))
            full = chance >= 1
            now = rows.select(factor(b, c, rate).alias("f"), F.explode("cells").alias("c")).groupBy("c.lang", "c.topic").agg(F.sum(F.when(full, F.col("c.tokens")).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(chance * F.col("c.tokens"))).alias("free")).collect()
            capped, free = ({(r["lang"], r["topic"]): r[k] for r in now} for k in ("capped", "free"))
            is_ = lambda of, x, i: sum(v for k, v in of.items() if k[i] == x)
            off = max(abs(is_(capped, x, i) + is_(free, x, i) - goal[x]) / wanted for i, goal in ((0, goal_l), (1, goal_t)) for x in goal)
            trail.append(off)
            # no nearer than a few rounds ago: fewer tokens might help
            if off < CLOSE or len(trail) > 6 and off > 0.9 * trail[-6]:
                break
            for i, goal, by, whole in ((0, goal_l, b, whole_l), (1, goal_t, c, whole_t)):
                for x in goal.keys() - whole:
                    r = _step(goal[x], is_(capped, x, i), is_(free, x, i))
                    by[x] *= r
                    free = {k: v * r if k[i] == x else v for k, v in free.items()}
        tried.append((off, share, b, c, rate, {"lang": whole_l, "topic": whole_t}, sources))
        # where fewer tokens do not help, targets contradict one another: then the first try holds
        if off < CLOSE or len(tried) > 1 and off > 0.9 * tried[-2][0]:
            break
        share *= 0.8
    off, share, b, c, rate, whole, sources = tried[-1] if tried[-1][0] < CLOSE else tried[0]
    if off >= CLOSE:
        warnings.warn(f"marginals are up to {off:.2g} from their targets", stacklevel=2)
    return Rake(rows.select("source", factor(b, c, rate).alias("factor")), b, c, share, off, n, whole, sources)


def mix_documents(docs: DataFrame, share: float = 0.8, targets: Targets | None = None, seed: int = 0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """docs with topic, tokens, weight (of its cell, raked), probability and sampled.

    A document's probability is min(1, weight), and the expected tokens by source, language and topic have the
    target shares, but for classes that have less, which are drawn whole; they are ``share`` of all tokens (see rake).  A document is sampled if a hash of its
    id, text and seed, as a number in [0, 1), is less than its probability.  So samples are the same on every run.  Null sources, languages and texts: class "missing", and
    no tokens (the probability is 1 then: nothing to weigh).  Repeated rows, and ties of all that the hash reads, share their fate.  Columns that docs has
    already get an underscore; an empty table gives an empty one; long texts are read whole."""
    targets = targets or Targets()
    given, new = docs.columns, [free_name(docs, x) for x in ("topic", "tokens", "weight", "probability", "sampled")]
    docs, called = hidden(docs)
    text_col, id_col, source_col, lang_col = (called[c] for c in (text_col, id_col, source_col, lang_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in (source_col, lang_col))
    slim = docs.select(source.alias("source"), lang.alias("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("tokens"))
    cells = keep(slim.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "cells")
    found = rake(cells, targets, share)
    lookup = lambda x, k: F.element_at(F.create_map(*[F.lit(y) for kv in x.items() for y in kv]), k) if x else F.lit(1.0)
    weighed = keep(cells.join(found.factors, "source").withColumn("weight", F.col("factor") * lookup(found.languages, F.col("lang")) * lookup(found.topics, F.col("topic"))), "weights")
    few = weighed.count() <= 100_000
    w = weighed.select(F.col("source").alias("w_s"), F.col("lang").alias("w_l"), F.col("topic").alias("w_t"), F.round("weight", 9).alias("w_weight"))
    own = docs.select("*", topic_of(text).alias("topic"), tokens_of(text).alias("tokens"))
    own = own.join(F.broadcast(w) if few else w, (source == F.col("w_s")) & (lang == F.col("w_l")) & (F.col("topic") == F.col("w_t")), "left")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.coalesce("w_weight", F.lit(1.0)))).otherwise(1.0)
    out = own.select(*docs.columns, "topic", F.col("tokens").cast("long"), F.coalesce("w_weight", F.lit(1.0)), p, u < p)
    return out.toDF(*given, *new)
