"""The registered queries against brute force on a small fixture, and what once went wrong."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from waymark.llm import decontaminate, hilbert, languages, licenses, mixing, order_minhash, registry, spotsigs, substrings, toxicity
from waymark.llm.words import ALNUM, SPACE_SPLIT, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ("nasty", "vile")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels, benchmark and pages, and the documents' rows."""
    rng = random.Random(11)
    lexicon = {"en": [f"the of and is {a}{b}er" for a in "bcdf" for b in "aeiou"], "de": [f"der und ist {a}{b}ung" for a in "klmn" for b in "aeiou"]}
    lexicon = {k: " ".join(v).split() for k, v in lexicon.items()}
    item = "A train leaves Paris at 12 km per hour with 30 people on board and meets the other one later"
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de")[i % 3 == 0]
        w = rng.choices(lexicon[lang], k=rng.randrange(15, 90))
        toxic = i % 5 == 1
        if toxic:
            for at in rng.sample(range(len(w)), 3):
                w[at] = rng.choice(INSULTS)
        rows.append([i, " ".join(w).capitalize() + ".", lang, f"src{min(i % 11, 3)}", 0])
        labels.append((i, 1, int(toxic)))
    rows[7][1] += " " + item
    rows[8][1] += " " + item.replace("Paris", "Lyon").replace("30", "44")
    rows[20][1] = rows[10][1]
    rows[21][1] = rows[30][1] + " one more"
    rows += [[500, "", "en", "src0", 0], [501, None, None, None, None], [None, rows[3][1], "en", "src1", 0], [502, "Ünïcode — 日本語 テキスト", "de", "src2", 0], rows[5]]
    for r in rows:
        r[4] = None if r[4] is None else len(r[1] or "")
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "Who wrote it?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.example.de/x", "<html lang='de'><p>der und ist kaung</p></html>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows


def null_first(x):
    return (x is not None, x or 0)


def test_sharding(spark, tables):
    path, rows = tables
    got = [r.asDict() for r in registry.QUERIES["op3_sharding"](spark, path).collect()]
    data = [{"source": r[2 + 1], "lang": r[2], "size": len((r[1] or "").encode()) + 1, "doc_id": r[0], "crc": zlib.crc32((r[1] or "").encode())} for r in rows]

    def part(name):
        own = [d[name] for d in data]
        order = sorted(own, key=lambda v: (v is not None, v if v is not None else 0))
        return {v: order.index(v) * 16 // len(own) for v in own}

    parts = {n: part(n) for n in ("source", "lang", "size", "doc_id")}
    assert all(parts[n].get(None, 0) == 0 for n in parts)
    # a step along the curve changes one coordinate by one, so the curve tells cells apart; rows of one cell share it
    cells = {}
    by = {(g["doc_id"], g["text_crc32"]): g["curve"] for g in got}
    for d in data:
        cells.setdefault(by[d["doc_id"], d["crc"]], set()).add(tuple(parts[n][d[n]] for n in parts))
    assert all(len(v) == 1 for v in cells.values()) and len({next(iter(v)) for v in cells.values()}) == len(cells)
    order = sorted(got, key=lambda g: (g["shard"], g["slot"]))
    keys = [(g["curve"], null_first(g["doc_id"]), g["text_crc32"], g["size"]) for g in order]
    assert keys == sorted(keys)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == Counter((d["doc_id"], d["size"], d["crc"]) for d in data)
    n = Counter(g["shard"] for g in got)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(g["slot"] for g in got if g["shard"] == s) == list(range(n[s])) for s in n)
    assert {(g["law"], g["grown_shard"]) for g in got} == {("rows", None)}


def test_values_that_begin_alike_are_told_apart(spark):
    rows = [(i, f"common-crawl-2024-{i % 16:02d}", f"2024-01-{i % 28 + 1:02d}") for i in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, source string, day string").withColumn("day", F.col("day").cast("date"))
    curve = hilbert.curve_index(df, ["source", "day"])
    assert curve.select("source", "curve").distinct().groupBy("curve").count().filter("count > 1").isEmpty()
    out = hilbert.hilbert_shards(df, ["source", "day"], 8, ["doc_id"])
    # files are pruned: a source is in few shards
    assert out.groupBy("source").agg(F.count_distinct("shard").alias("n")).agg(F.avg("n")).head()[0] < 4
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [tuple(r) for r in hilbert.hilbert_shards(df.orderBy(F.desc("doc_id")), ["source", "day"], 8, ["doc_id"]).orderBy("doc_id").collect()]


def test_spotsigs(spark, tables):
    path, rows = tables
    got = defaultdict(list)
    for g in registry.QUERIES["op10_spotsigs"](spark, path).collect():
        got[g.doc_id].append(g)
    texts = sorted({(-(1 << 63) if r[0] is None else r[0], r[1] or "") for r in rows})
    words = lambda t: [x for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x]
    edits = [t[: len(t) - len(t) // 4] + texts[(at + 1) % len(texts)][1][: len(t) // 4] for at, (_, t) in enumerate(texts)]
    vocabulary = sorted({w for t in [*edits, *[t for _, t in texts]] for w in words(t)})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.hash("w").alias("h")).collect()}
    common = set(spotsigs.COMMON)

    def spots(t):
        w = ["", *words(t)]
        out = set()
        for i, x in enumerate(w):
            if x == "" or x in common or hashed[x] % spotsigs.ANCHOR_SHARE == 0:
                if chain := [y for y in w[i + 1 : i + 1 + spotsigs.SPAN] if y not in common][: spotsigs.CHAIN]:
                    out.add((x, *chain))
        return out or {("=", *w)}

    like = lambda a, b: len(a & b) / len(a | b)
    prints = {}
    for at, (i, t) in enumerate(texts):
        nxt = texts[(at + 1) % len(texts)][1]
        edited = edits[at]
        for g in got[None if i == -(1 << 63) else i]:
            assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert g.near_edited == pytest.approx(like(spots(t), spots(edited))) and g.near_next == pytest.approx(like(spots(t), spots(nxt)))
            for f, own in ((g.fingerprint, spots(t)), (g.edited_fingerprint, spots(edited))):
                assert len(f) == 8 * len(own) and prints.setdefault(f, own) == own
    assert sum(map(len, got.values())) == len(rows)


def test_signatures_at_any_length(spark):
    """A text and the same with a word more or fewer are alike, short or long, and in any language."""
    rng = random.Random(3)
    rows, n = [], 0
    for words in (8, 20, 99, 101, 400):
        for make in (lambda: f"w{rng.randrange(900)}", lambda: chr(0x4E00 + rng.randrange(900))):
            w = [make() for _ in range(words)]
            rows += [(n, " ".join(w)), (n + 1, " ".join(w[:-1]))]
            n += 2
    df = spotsigs.with_spots(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    s = {r.doc_id: set(r.s) for r in df.collect()}
    assert all(len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) >= (0.9 if len(s[i]) > 20 else 0.4) for i in range(0, n, 2))


def test_near_copies(spark, tables):
    path, rows = tables
    got = {r.doc_id: r for r in registry.QUERIES["op6_order_minhash"](spark, path).collect() if r.doc_id is not None}
    grams = {}
    for r in rows:
        if r[0] is not None:
            w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
            g, seen = [], Counter()
            for x in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
                seen[x] += 1
                g.append((x, seen[x]))
            grams[r[0]] = g
    number = {x: i for i, x in enumerate(sorted({x for g in grams.values() for x in g}))}
    arrays = {i: np.array([number[x] for x in g], np.uint32) for i, g in grams.items()}
    for i in arrays:
        alike = {j for j in arrays if order_minhash.alignment(arrays[i], arrays[j], 0.8) >= 0.8 or (not len(arrays[i]) and not len(arrays[j])) or i == j}
        assert got[i].class_id == min(alike), i
        assert got[i].n_links == len({tuple(grams[j]) for j in alike} - {tuple(grams[i])})


def test_texts_of_one_id(spark):
    """Links do not depend on which of an id's texts comes first."""
    rng = random.Random(5)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(2))
    for rows in ([(1, a), (1, b), (2, b + " more")], [(1, b), (1, a), (2, b + " more")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {r.class_id for r in order_minhash.near_copies(df).collect()} == {1}
    corpus = pytest.importorskip("corpus_pipeline")
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "en", "s", 1), (1, a[::-1], "en", "s", 1)]
    out = corpus.near_copy_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.text for r in out.collect()) == sorted([a, b, a[::-1]])


def test_decontamination(spark, tables):
    path, _ = tables
    got = {(r.doc_id, r.item_id, r.verbatim) for r in registry.QUERIES["op9_decontamination"](spark, path).collect()}
    assert got == {(7, 1, True), (8, 1, False)}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    names, plain = ["Alice", "Bob", "Carol", "Dora"], [f"p{x}" for x in "abcdefghijklmnopqrst"]
    items = []
    for i in range(6):
        w = ["Now"] + [rng.choice(names + ["12", "7", "345"]) if rng.random() < 0.25 else rng.choice(plain) for _ in range(rng.randrange(12, 24))]
        items.append((i, " ".join(w)))
    docs = []
    for i in range(60):
        w = rng.choice(items)[1].split()
        swap = {x: rng.choice(names if x in names else ["3", "99", "7"]) for x in [*names, "12", "7", "345"]}
        if rng.random() < 0.6:
            w = [swap.get(x, x) for x in w]
        if rng.random() < 0.5:
            w.insert(rng.randrange(1, len(w)), "extra")
        docs.append((i, "so then " + " ".join(["now", *w[1:]]) + " and on"))

    def template(text):
        out = []
        for x in text.split():
            kind = "NUM" if x.isdigit() else "NAME" if x in names else x
            if out and kind == out[-1][0] and kind in ("NAME", "NUM"):
                out[-1] = (kind, out[-1][1] + " " + x.lower())
            else:
                out.append((kind, x.lower()))
        return out

    def windows(t, size):
        return [(i, t[i : i + size]) for i in range(len(t) - size + 1)]

    def consistent(pairs):
        ok = len({a for a, _ in pairs}) == len(pairs)
        named = [b for a, b in pairs if a[0] == "NAME"]
        return ok and len(set(named)) == len(named)

    def best(own, doc, n):
        runs = defaultdict(lambda: (set(), set()))
        for i, a in own:
            for j, b in doc:
                if [x for x, _ in a] == [x for x, _ in b]:
                    runs[j - i][0].add(i)
                    runs[j - i][1].update((x, y) for x, y in zip(a, b) if x[0] in ("NUM", "NAME"))
        runs = [r for r in runs.values() if consistent(r[1])]
        if not runs:
            return 0
        places, pairs = set().union(*[r[0] for r in runs]), set().union(*[r[1] for r in runs])
        return (len(places) if consistent(pairs) else max(len(r[0]) for r in runs)) / n

    want = set()
    for i, text in docs:
        for j, item in items:
            t = template(item)
            size = min(8, len(t) - 1)
            own = [(k, x) for k, x in windows(t, size) if k >= 1 and sum(y[0] not in ("NUM", "NAME") for y in x) >= 4]
            doc = [(k, x) for k, x in windows(template(text), size) if sum(y[0] not in ("NUM", "NAME") for y in x) >= 4]
            words, said = item.lower().split(), text.lower().split()
            plain_own = [words[k : k + 8] for k in range(len(words) - 7)]
            plain_doc = [said[k : k + 8] for k in range(len(said) - 7)]
            share = max(best(own, doc, len(own)) if own else 0, sum(x in plain_doc for x in plain_own) / len(plain_own))
            if share >= 0.5:
                want.add((i, j, round(share, 6)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want and 20 < len(want) and len({i for i, _, _ in want}) < 60


def test_toxicity(spark, tables):
    path, rows = tables
    got = registry.QUERIES["op7_toxicity"](spark, path).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        own = 0 if math.isnan(r.doc_id) else zlib.crc32(str(int(r.doc_id)).encode()) % 5
        assert r.held_out == (own == 0 and not math.isnan(r.doc_id)) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    toxic = {r[0] for r in rows if r[1] and any(x in r[1].lower() for x in INSULTS) and r[0] is not None}
    found = {int(r.doc_id) for r in got.itertuples() if r.predicted and not math.isnan(r.doc_id)}
    assert found <= toxic and len(found) > 0.9 * len(toxic)


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(12)] + ["bad"]
    text = lambda bad: " ".join(rng.choices(vocabulary, weights=[*range(12, 0, -1), 4 * bad], k=40))
    labelled = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(30)]
    corpus = [t for t, _ in labelled] + [text(0) + f" rare{i}" for i in range(10)]
    start, d = "<s>", 2
    before = lambda w: [start, *w[:-1]]
    shared = defaultdict(set)
    for t in corpus:
        w = t.split()
        for u, x in zip(before(w), w):
            shared[x].add(u)
    total = sum(map(len, shared.values())) + 1
    sh = {x: len(u) / total for x, u in shared.items()} | {"<unk>": 1 / total}
    model = {}
    for c in (0, 1):
        triples = {(t2, u, x) for t, y in labelled if y == c for w in [t.split()] for t2, u, x in zip(before(before(w)), before(w), w)}
        n = Counter((u, x) for _, u, x in triples)
        k = Counter(x for _, x in n)
        left = sum(min(v, d) for v in k.values()) / sum(k.values())
        q = {x: max(k[x] - d, 0) / sum(k.values()) + left * p for x, p in sh.items()}
        heads, low = Counter(), Counter()
        for (u, x), v in n.items():
            heads[u] += v
            low[u] += min(v, d)
        model[c] = lambda u, x, n=n, q=q, heads=heads, low=low: max(n[u, x] - d, 0) / max(heads[u], 1) + (low[u] / heads[u] if heads[u] else 1) * q[x]
        assert sum(q.values()) == pytest.approx(1)
        assert all(sum(model[c](u, x) for x in sh) == pytest.approx(1) for u in (start, "v0", "bad", "rare1"))
    ratio = lambda u, x: math.log(model[1](u, x) / model[0](u, x))
    pairs = toxicity.class_pairs(spark.createDataFrame(labelled, "text string, toxic int").repartition(3)).cache()
    counts = toxicity.continuation_counts(spark.createDataFrame([(t,) for t in corpus], "text string").repartition(3), np.sort(next(pieces(pa.array(["v0"]), ALNUM)).hashes()))
    ratios, table, rest = toxicity.class_tables(pairs, counts, d)
    keys, values = toxicity._sorted(ratios.toArrow(), "pair", "ratio")
    words, alone, ahead = toxicity._sorted(table.toArrow(), "word", "alone", "before")
    m = toxicity.Model(keys, values, words, alone=alone, before=ahead, rest=rest)
    for t in [*corpus, "unknown words here", "bad", "v0 bad", ""]:
        w = [x if x in sh else "<unk>" for x in t.split()]
        s = [ratio(u, x) for u, x in zip(before(w), w)]
        size = min(toxicity.PASSAGE, len(s))
        want = max((sum(s[i : i + size]) / size for i in range(len(s) - size + 1)), default=0.0) if s else 0.0
        assert toxicity.evidence(pa.array([t]), m)[0] == pytest.approx(want, abs=1e-5), t


def test_toxicity_minds_neither_order_nor_copies(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices([f"v{i}" for i in range(30)], k=30)) + (" vile" * (i % 4 == 0)), int(i % 4 == 0)) for i in range(200)]
    df = lambda x: spark.createDataFrame(x, "text string, toxic int")
    a, b = (toxicity.train(df(x), df(x)) for x in (rows, rows[::-1]))
    assert (a.slope, a.bias) == (b.slope, b.bias)
    c = toxicity.train(df(rows), df(rows + rows[:50] * 5))
    assert (a.slope, a.bias) == (c.slope, c.bias)
    none = toxicity.train(df(rows), df([]))
    assert none.slope == 0
    assert toxicity.train(df(rows), spark.createDataFrame([(r[0], None) for r in rows], "text string, toxic int")).slope == 0


def test_languages_against_brute_force(spark, tables):
    path, rows = tables
    got = {r.doc_id: r for r in registry.QUERIES["op1_language_id"](spark, path).collect() if r.page_id is None and r.doc_id is not None}
    letter = lambda c: c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20

    def grams(t):
        b = [letter(c) for c in (t or "").encode()]
        codes = [(x << 16) | (y << 8) | z for x, y, z in zip(b, b[1:], b[2:])]
        return [((g * 2654435761 & 0xFFFFFFFF) >> 17) % languages.BUCKETS for g in codes if g != 0x202020]

    names = ["de", "en"]
    counts = {x: Counter(g for r in rows if r[2] == x for g in grams(r[1])) for x in names}
    logs = {x: {g: math.log(0.9 * (c[g] + 0.5) / (sum(c.values()) + 0.5 * languages.BUCKETS) + 0.1 / languages.BUCKETS) for g in range(languages.BUCKETS)} for x, c in counts.items()}
    logs["und"] = dict.fromkeys(range(languages.BUCKETS), -math.log(languages.BUCKETS))
    every = [*names, "und"]
    lik = lambda t: [sum(logs[x][g] for g in grams(t)) / (1 + len(grams(t)) / languages.WEIGHT) for x in every]
    page = "der und ist kaung"
    scored = [(r[0], r[2], r[3], lik(r[1])) for r in rows] + [(None, "de", "a.example.de", lik(f"  {page}  ")), (None, None, None, lik(""))]
    guess = [max(range(3), key=lambda i: (v[i], -i)) for *_, v in scored]
    total = Counter(guess)
    corpus = [(total[i] + 1) / (len(scored) + 3) for i in range(3)]
    for (i, declared, host, v) in scored:
        if i is None:
            continue
        mine = Counter(g for g, s in zip(guess, scored) if s[2] == host and host is not None)
        prior = corpus if host is None else [(mine[k] + 20 * corpus[k]) / (sum(mine.values()) + 20) for k in range(3)]
        said = Counter(g for g, s in zip(guess, scored) if s[1] == declared)
        post = [v[k] + math.log(prior[k]) + (math.log((said[k] + 1) / (total[k] + 20)) if declared is not None else 0) for k in range(3)]
        e = [math.exp(x - max(post)) for x in post]
        if max(v) == 0:
            assert (got[i].language, got[i].confidence, got[i].accepted) == ("und", 1.0, False)
        else:
            k = e.index(max(e))
            assert got[i].language == every[k] and got[i].confidence == pytest.approx(e[k] / sum(e), abs=2e-6)
            assert got[i].accepted == (every[k] != "und" and e[k] / sum(e) >= 0.5)


def test_languages_keep_columns_of_any_name(spark):
    rows = spark.createDataFrame([("der und ist", "de", "h", None, None, 1, 2, 3, 4)], "text string, declared string, host string, domain string, suffix string, guess int, likelihoods int, prior int, posterior int")
    names, model = languages.train(rows.withColumn("lang", F.lit("de")), "text", "lang")
    out = languages.identify(rows.unionAll(rows), names, model).collect()
    assert len(out) == 2 and (out[0].guess, out[0].likelihoods, out[0].prior, out[0].posterior, out[0].language) == (1, 2, 3, 4, "de")


def test_words_of_one_length_with_other_letters(spark):
    """Thue and Morse's word and its opposite, on which polynomials modulo a power of two agree."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    p = next(pieces(pa.array([f"{word} {other}"]), SPACE_SPLIT))
    assert len(set(p.hashes().tolist())) == 2
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.cut_repeats(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_substring_query(spark, tables):
    path, rows = tables
    got = registry.QUERIES["op8_substring_dedup"](spark, path)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.count() == len(rows)
    by = {r.doc_id: r for r in got.collect()}
    assert by[20].n_removed == by[20].n_words and by[501].n_words == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_against_its_sql(spark, name):
    duckdb, sf = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    plain = lambda rows, at: sorted(tuple(str(r[at(c)]) for c in names) for r in rows)
    assert plain(df.collect(), lambda c: c) == plain(want.fetchall(), want.columns.index)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """No rows; and columns that stages use within, long texts, nulls and repeated rows."""
    corpus = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "no such words are in any of these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    rng = random.Random(8)
    text = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, text(40), "en", f"s{i % 2}", 1) for i in range(20)] + [(30, text(20_000), "en", "s0", 1), (None, text(30), None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.lit("x") for c in ("guess", "likelihoods", "row_hash", "curve", "shard", "topic", "class_id", "h", "b_id")})
    for name, stage in corpus.STAGES[:3]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == corpus.COLUMNS and {r.doc_id for r in out.collect()} == {r[0] for r in rows}, name
    assert corpus.STAGES[3][1](spark, df, str(tmp_path)).columns == corpus.COLUMNS
    assert corpus.STAGES[4][1](spark, df, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(7, "a", "en", "s", 1)] * 9, [(None, None, None, None, None)] * 3, [(i, "a", "en", "s", 1) for i in range(40)]])
def test_sharding_where_dimensions_have_one_value(spark, tmp_path, rows):
    """Empty, one row, all alike, all null, and one dimension of several values: each ends, and quickly."""
    began = time.monotonic()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op3_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert not rows or max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    corpus = pytest.importorskip("corpus_pipeline")
    assert corpus.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(rows)
    assert time.monotonic() - began < 60


def test_mixing_query_against_brute_force(spark, tables, tmp_path):
    """Every probability of op2_mixing, by raking cells in plain Python to targets of which small classes give what they have; and one rare
    document more changes the sample by no more than itself."""
    _, rows = tables
    path = str(tmp_path / "a")
    rng = random.Random(4)
    own = [[i, " ".join(rng.choices(["word", "other", "thing?", "{code", "http"], [9, 9, 1, 1, 1], k=rng.randrange(5, 200))), rng.choices(["en", "de", "fr"], [8, 3, 1])[0], f"s{rng.choices(range(5), [50, 20, 9, 3, 1])[0]}", 0] for i in range(600)]
    spark.createDataFrame(own, SCHEMA).write.parquet(f"{path}/documents.parquet")
    got = registry.op2_mixing(spark, path).toPandas()
    got["expected"] = got["tokens"] * got["probability"]
    share, power = 0.8, mixing.Targets().power
    axes = ("source", "lang", "topic")
    cells = got.groupby(list(axes)).agg(n=("tokens", "sum"), p=("probability", "first"), lo=("probability", "min"), hi=("probability", "max"))
    assert (cells["lo"] == cells["hi"]).all()
    n, goal, total = cells["n"].to_numpy(float), {}, float(got["tokens"].sum())
    for c in axes:
        have = got.groupby(c)["tokens"].sum().to_dict()
        goal[c], left, free = {}, share * total, dict(have)
        while True:
            raw = {k: v ** (mixing.Targets().source_power if c == "source" else power) for k, v in free.items()}
            part = {k: left * v / sum(raw.values()) for k, v in raw.items()}
            small = [k for k in free if part[k] >= have[k] * (1 - 1e-12)]
            if not small:
                break
            for k in small:
                goal[c][k] = have[k]
                left -= free.pop(k)
        goal[c] |= part
    names = {c: np.array(cells.index.get_level_values(c)) for c in axes}
    f = np.ones(len(cells))
    for _ in range(4000):
        for c in axes:
            for k, want in goal[c].items():
                mine = names[c] == k
                f[mine] = np.minimum(f[mine] * want / np.minimum(n[mine], n[mine] * f[mine]).sum(), 1e9)
    assert np.abs(np.minimum(1, f) - cells["p"].to_numpy()).max() < 2e-3
    assert got["expected"].sum() / total == pytest.approx(share, rel=1e-3)
    for c in axes:
        sums = got.groupby(c)["expected"].sum()
        assert all(sums[k] == pytest.approx(want, rel=1e-2, abs=1) for k, want in goal[c].items())
    more = str(tmp_path / "b")
    spark.createDataFrame([*own, [9999, "a", "xx", "alone", 1]], SCHEMA).write.parquet(f"{more}/documents.parquet")
    again = registry.op2_mixing(spark, more).toPandas()
    assert abs(again["tokens"].mul(again["probability"]).sum() - got["expected"].sum()) < 3
    assert again.loc[again["doc_id"] == 9999, "probability"].item() == 1.0
    assert len(set(again["doc_id"][again["sampled"]]) ^ set(got["doc_id"][got["sampled"]])) <= 4


LICENSED = {
    "Apache 2.0 version: the license is under discussion": "",
    "This is not about the BSD but the license of the house under which it was released": "",
    "MIT License": "mit",
    "SPDX-License-Identifier: MIT": "mit",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "gpl-3.0",
    "It is licensed under the GNU GPL v3.": "gpl-3.0",
    "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa-3.0",
    "License MIT the under released": "",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-terms",
    "Permitted are forms binary and source in use and redistribution, modification without or with": "",
    "the license of MIT, the institute": "",
}


def test_licenses_mind_the_order_of_words(spark, tmp_path):
    """Notices by their words' order, also with words between them and over lines; and the same by the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    texts = [*LICENSED, *(f"Some words before.\n{t}\nand after it" for t in LICENSED), "Released then\nunder the very MIT\nLicense"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.op4_license_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts[:-1]):
        assert got[i].labels == LICENSED[texts[i % len(LICENSED)]], t
    assert got[len(texts) - 1].labels == "mit"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE["op4_license_scan"])
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.values()))) == sorted(map(str, want.fetchall()))


def test_license_chains():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices(range(4), k=rng.randrange(0, 8)) for _ in range(2))
        best = max((sum(1 for _ in c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if (it := iter(b)) is not None and all(x in it for x in c)), default=0)
        assert licenses.chain(a, b) == best
