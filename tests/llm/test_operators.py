"""Each operator against a brute-force version on small fixtures, and the awkward cases: nulls, empty and long texts,
ties, repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import decontaminate, hilbert, languages, licenses, mixing, order_minhash, spotsigs, substrings, toxicity, url_lists
from waymark.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASH = ("shard", "slot", "score", "keys", "places", "rank", "label", "row_hash", "weight", "topic", "_place", "curve")


def clash(df, *but):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in but})


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with passages in common, near and exact copies, and what is awkward."""
    rng = random.Random(5)
    base = [words_of(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = words_of(rng, 30)
    for i in (3, 9, 17, 20):
        base[i][5:5] = passage
    near = list(base[0])
    near[10] = "changed"
    texts = [" ".join(w) for w in base] + [" ".join(near), " ".join(base[4]), "  " + "\n".join(base[4])]
    texts += ["", None, "one", "one two", " ".join(words_of(rng, 6000))]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{min(i % 7, 3)}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], (None, texts[2], "en", "s0", 3), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return -(1 << 63) if x is None else x


def test_substrings_against_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first: dict = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(first.get(g, 1 << 62), key(i))
    want = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < key(i):
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substrings.cut_repeats(clash(docs)).collect()]
    order = lambda x: (key(x[0]), x[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(x[2] > 0 for x in want) > 3


def test_levels_double(spark):
    rng = random.Random(1)
    shared = words_of(rng, 60, 10_000)
    rows = [(1, " ".join(words_of(rng, 20, 10_000) + shared)), (2, " ".join(shared + words_of(rng, 20, 10_000))), (3, " ".join(words_of(rng, 50, 10_000))), (4, " ".join(shared[:15]))]
    got = {r.doc_id: r.longest for r in substrings.longest_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 52, 2: 52, 4: 13}


def test_substrings_empty(empty):
    assert substrings.cut_repeats(empty).count() == 0
    assert substrings.longest_repeats(empty).count() == 0


def shingles(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_near_copies_against_brute_force(docs):
    got = {(r.doc_id, r.same): r.class_id for r in order_minhash.near_copies(clash(docs)).collect()}
    ids = {i: c for (i, _), c in got.items() if i is not None}
    rows = [(r.doc_id, set(shingles(r.text))) for r in docs.collect() if r.doc_id is not None]
    for i, a in rows:
        for j, b in rows:
            like = len(a & b) / len(a | b) if a | b else 1.0
            assert (ids[i] == ids[j]) == (like >= 0.8), (i, j, like)
    assert all(c is None for (i, _), c in got.items() if i is None)
    assert order_minhash.near_copies(docs).count() == docs.count()


def test_near_copies_empty(empty):
    assert order_minhash.near_copies(empty).count() == 0


def test_many_variants_are_one_class(spark):
    """A large bucket: variants of one text, each near the original though not near each other."""
    rng = random.Random(2)
    base = words_of(rng, 300)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for at in rng.sample(range(300), 5):
            w[at] = f"new{i}q{at}"
        rows.append((i, " ".join(w)))
    got = order_minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.class_id for r in got.collect()} == {0}


@pytest.mark.parametrize("block", [1 << 18, 3000])
def test_links_of_a_large_bucket_against_brute_force(spark, monkeypatch, block):
    """n_links counts every text that is linked, within one block and over several."""
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = random.Random(8)
    base = words_of(rng, 120, 5000)
    texts = [base]
    for i in range(1, 130):
        w = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 4)):
            w[at] = f"new{i}q{at}"
        if i % 10 == 0:
            w[20:20] = w[60:75]
        if i % 7 == 0:
            w = w[: 120 - rng.randrange(20)]
        if i % 13 == 0:
            w[0:10], w[30:40] = w[30:40], w[0:10]
        texts.append(w)
    texts += [words_of(rng, 50, 5000) for _ in range(5)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in order_minhash.near_copies(df).collect()}
    grams = {}
    for b in order_minhash._shingles(5)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([" ".join(w) for w in texts])], names=["id", "text"])])):
        grams = {i: np.frombuffer(g, np.uint32) for i, g in enumerate(b.column(1).to_pylist())}
    want = {i: sum(i != j and order_minhash.alignment(grams[i], grams[j], 0.8) >= 0.8 for j in grams) for i in grams}
    assert got == want and max(want.values()) > 30


def test_near_copies_in_few_tasks(spark):
    """Classes of a large bucket take few exchanges, so many shuffle partitions don't fill an executor's memory with their buffers."""
    rng, conf = random.Random(3), {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    base = words_of(rng, 80)
    rows = []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(80), 2):
            w[at] = f"new{i}q{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "few-tasks")
        assert order_minhash.near_copies(df).count() == 40
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in was.items():
            spark.conf.set(k, v)
    told = spark.sparkContext.statusTracker()
    stages = {k for j in told.getJobIdsForGroup("few-tasks") for k in told.getJobInfo(j).stageIds}
    assert 0 < sum(x.numCompletedTasks for k in stages if (x := told.getStageInfo(k))) < 700


def test_sketches_hold_some_texts_at_a_time():
    rng = random.Random(4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([" ".join(words_of(rng, 60)) for _ in range(10_000)])], names=["id", "text"])
    sketch = order_minhash._sketch(5)
    list(sketch(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in sketch(iter([batch]))) == 10_000
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_alignment_minds_the_order():
    a = np.arange(100, dtype=np.uint32)
    assert order_minhash.alignment(a, a, 0.8) == 1.0
    assert order_minhash.alignment(a, np.r_[a[50:], a[:50]], 0.8) < 0.8
    assert order_minhash.alignment(a, a[:70], 0.8) == 0.0
    assert order_minhash.alignment(a, np.zeros(0, np.uint32), 0.8) == 0.0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), *[(i, i + 1) for i in range(20, 60)]]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{i: 20 for i in range(20, 61)}}


def test_components_with_labels_sent_to_every_task(spark):
    rng = random.Random(6)
    links = [(i, i) for i in (1, 90)] + [(i + 1, i) for i in range(20, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(7, j) for j in range(200, 230)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {r.id: r.label for r in components(df).collect()}
    assert {r.id: r.label for r in components(df, 1000).collect()} == want == {r.id: r.label for r in components(df, 10).collect()}
    assert want[60] == 20 and want[229] == 7 and want[90] == 90


def test_shards(docs, empty):
    out = hilbert.hilbert_shards(clash(docs), ["source", "lang", "n_chars", "doc_id"], 8, ["doc_id", "n_chars"])
    assert out.columns[-3:] == ["curve_", "shard_", "slot_"]
    rows = out.collect()
    assert len(rows) == docs.count()
    sizes = [sum(r.shard_ == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot_ for r in rows if r.shard_ == s) == list(range(sizes[s]))
    order = sorted(rows, key=lambda r: (r.shard_, r.slot_))
    assert [r.curve_ for r in order] == sorted(r.curve_ for r in rows)
    assert hilbert.hilbert_shards(empty, ["source"], 8, ["doc_id"]).count() == 0


def test_curve_steps_to_neighbours(spark):
    """Every cell once, and each next cell one step along one axis."""
    cells = spark.range(4**3).select((F.col("id") % 4).alias("a"), (F.floor(F.col("id") / 4) % 4).alias("b"), F.floor(F.col("id") / 16).alias("c"))
    got = sorted((r.curve, (r.a, r.b, r.c)) for r in hilbert.curve_index(cells, ["a", "b", "c"], bits=2).collect())
    assert [i for i, _ in got] == list(range(64))
    assert all(sum(abs(x - y) for x, y in zip(p, q)) == 1 for (_, p), (_, q) in zip(got, got[1:]))


def test_mixing_meets_the_targets(spark, docs, empty):
    rng = np.random.default_rng(0)
    cells = [(s, l, t, float(rng.integers(1, 1000))) for s in "abc" for l in ("en", "de") for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    total = sum(n for *_, n in cells)
    found = mixing.rake(df, mixing.Targets(power=0.7), 0.2)
    assert found.share == 0.2 and found.off < mixing.CLOSE
    f = {r.source: r.factor for r in found.factors.collect()}
    w = {(s, l, t): n * f[s] * found.languages[l] * found.topics[t] / (0.2 * total) for s, l, t, n in cells}
    # by brute force
    x = {(s, l, t): n for s, l, t, n in cells}
    goals = []
    for axis in range(3):
        totals: dict = {}
        for k, n in ((k[:3], k[3]) for k in cells):
            totals[k[axis]] = totals.get(k[axis], 0) + n
        goals.append({k: v**0.7 / sum(u**0.7 for u in totals.values()) for k, v in totals.items()})
    for _ in range(200):
        for axis in range(3):
            sums: dict = {}
            for k, n in x.items():
                sums[k[axis]] = sums.get(k[axis], 0) + n
            x = {k: n * goals[axis][k[axis]] / sums[k[axis]] for k, n in x.items()}
    for k in x:
        assert w[k] == pytest.approx(x[k], rel=1e-3)
    out = mixing.mix_documents(clash(docs))
    assert out.count() == docs.count() and out.columns[-5:] == ["topic_", "tokens", "weight_", "probability", "sampled"]
    assert mixing.mix_documents(empty).count() == 0


def test_mixing_with_chances_at_their_limit(spark):
    """Where chances of 1 stand in the way, the others make up for it: the expected shares are the targets, and a class that has less
    than its target is drawn whole."""
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for s, weight in (("a", 60), ("b", 25), ("c", 6)):
        for l, share in (("en", 0.7), ("de", 0.3)):
            for text, much in (("plain words " * 20, 1.0), ("is it so? " * 20, 0.1)):
                for _ in range(int(weight * share * much * 4) + 1):
                    rows.append((i, text + "x" * int(rng.integers(0, 40)), l, s, 1))
                    i += 1
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_documents(df, share=0.9, targets=mixing.Targets(power=0.7)).toPandas()
    assert (out["probability"] == 1).any() and (out["probability"] < 1).any()
    out["expected"] = out["tokens"] * out["probability"]
    goal = {}
    for c in ("source", "lang", "topic"):
        have, got = out.groupby(c)["tokens"].sum().to_dict(), out.groupby(c)["expected"].sum()
        goal[c], _ = mixing.filled(have, mixing.tempered(have, 0.7), 0.9 * sum(have.values()))
        assert max(abs(got[k] - v) for k, v in goal[c].items()) < 1e-3 * got.sum(), c
    # by brute force: a cell's chance is the product of its factors, cut at 1
    cells = out.groupby(["source", "lang", "topic"]).agg(n=("tokens", "sum"), p=("probability", "first"), lo=("probability", "min"), hi=("probability", "max"))
    assert (cells["lo"] == cells["hi"]).all()
    axes = {c: np.array(cells.index.get_level_values(c)) for c in ("source", "lang", "topic")}
    f, n = np.ones(len(cells)), cells["n"].to_numpy(float)
    for _ in range(3000):
        for c, names in axes.items():
            for k, want in goal[c].items():
                mine = names == k
                f[mine] = np.minimum(1e9, f[mine] * want / np.minimum(n[mine], n[mine] * f[mine]).sum())
    assert np.abs(np.minimum(1, f) - cells["p"].to_numpy()).max() < 1e-3
    small, large = (set(mixing.mix_documents(df, share=s).filter("sampled").toPandas()["doc_id"]) for s in (0.2, 0.5))
    assert len(small) < len(large)


def held(w, template, must, never):
    """Whether some run of twice the template's words, from one of them on, holds 0.8 of them."""
    t = re.findall(r"[0-9a-z]+", template.lower())
    for i in range(len(w)):
        if w[i] in t:
            at = [j for j in range(i, min(i + 2 * len(t), len(w))) if w[j] in t]
            own = {w[j] for j in at}
            if len(own) >= math.ceil(0.8 * len(set(t)) - 1e-9) and set(must.split()) <= own and not set(never.split()) & set(w[i : at[-1] + 1]):
                return True
    return False


def test_licenses_against_brute_force(spark, docs, empty):
    notes = ["Licensed under CC BY-NC 4.0", "GNU General  Public License. All rights reserved", "cc\nby cc by", "Licensed under the Apache License, Version 2.0 etc", "Licensed Apache Version 2.0 License", "ALL RIGHTS\nRESERVED", "nothing", "", None]
    # what says one license is not another
    notes += ["Licensed under CC BY 4.0", "Released under the BSD License", "Released under the Apache License", "Licensed under the Eclipse License, Version 2.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under the MIT License"]
    df = spark.createDataFrame(list(enumerate(notes)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(clash(df)).collect()}
    for i, t in enumerate(notes):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        also = {name for name, *x in licenses.TEMPLATES if held(w, *x)}
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert r.labels == ",".join(sorted({x for _, x in at} | also))
        assert 0 <= r.score <= 1
    assert [got[i].labels for i in range(9, 15)] == ["cc-by,cc-by-4.0", "bsd", "", "", "cc-by-nc-4.0", "mit"]
    assert licenses.license_scan(docs).count() == docs.count()
    assert licenses.license_scan(empty).count() == 0


def test_notices_over_lines(spark):
    """A notice counts however its lines break; words strewn over a long line do not."""
    bsd, mit = (next(t for n, t, _, _ in licenses.TEMPLATES if n == x).split() for x in ("bsd-terms", "mit-terms"))
    strewn = " ".join(f"{w} " + " ".join(f"x{i}y{j}" for j in range(20)) for i, w in enumerate(bsd))
    texts = ["before\n" + " ".join(bsd[:10]) + "\n" + " ".join(bsd[10:]) + "\nafter", "/*\n" + "\n".join(" * " + " ".join(mit[i : i + 4]) for i in range(0, len(mit), 4)), strewn, "word " * 3000 + " ".join(bsd) + " word" * 3000, " ".join(bsd[:7])]
    # the next text's words end no notice of this one
    texts.append(" ".join(bsd[7:]))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    assert got == {0: ("bsd-terms", 1.0), 1: ("mit-terms", 1.0), 2: ("", 0.0), 3: ("bsd-terms", 1.0), 4: ("", 0.0), 5: ("", 0.0)}


def test_url_lists(spark):
    d = lambda x: f"2024-01-{x:02d}"
    entries = [("ads", "Example.com", "add", d(5)), ("ads", "example.com", "remove", d(10)), ("ads", "example.com", "add", d(20)), ("bad", "a.example.com", "add", d(1)), ("bad", "a.example.com", "remove", d(1)), ("bad", "b.example.com", "add", d(3)), ("bad", "b.example.com", "add", d(4)), ("x", None, "add", d(1)), ("x", "com", "remove", d(1))]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, dated string").withColumn("dated", F.col("dated").cast("date"))
    captures = [(i, u, d(t)) for i, (u, t) in enumerate([("http://a.example.com/x", 4), ("http://a.example.com/x", 5), ("https://EXAMPLE.com:80/", 10), ("http://example.com", 9), ("http://b.example.com/?q", 31), ("http://notexample.com", 6), ("nonsense", 6), (None, 6)])] + [(8, "http://example.com", None)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast("date"))
    got = {r.page_id: (r.blocked, r.lists, str(r.since) if r.since else None) for r in url_lists.listed(clash(c), e).collect()}
    no = (False, "", None)
    assert got == {0: no, 1: (True, "ads", d(5)), 2: no, 3: (True, "ads", d(5)), 4: (True, "ads,bad", d(20)), 5: no, 6: no, 7: no, 8: no}
    assert url_lists.listed(c.filter("false"), e).count() == 0
    assert url_lists.listed(c, e.filter("false")).filter("blocked").count() == 0


def test_decontamination(spark, docs, empty):
    items = [(1, "A train leaves Paris at 12 km per hour with 30 people on board and meets the other one later"), (2, "short one"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "before it. A train leaves Paris at 12 km per hour with 30 people on board and meets the other one later. after",
        "A train leaves Berlin at 99 km per hour with 41 people on board and meets the other one later",
        "A train of thought leaves nobody on board",
        None,
        "",
        "x " * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(clash(df), bench).collect()}
    assert set(got) == {0, 1}
    assert got[0].verbatim and not got[1].verbatim and got[1].n_slots >= 2 and got[0].coverage == 1.0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(df, bench.filter("false")).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0


def test_items_of_few_plain_words_are_found_verbatim(spark):
    items = ["Who wrote Hamlet?", "Who wrote Romeo and Juliet?", "What is 17 times 23?", "Did Alice Smith meet Bob Jones in Paris or Carol White in Rome with David Brown"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["so: " + x + " end" for x in items] + [x.lower() for x in items] + ["Who wrote Macbeth?", "Who wrote it? Hamlet", "WHAT IS 17 TIMES 24"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.verbatim) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(i, i % 4, 1.0, True) for i in range(8)]


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "add 5 apples to 5 pears and then 5 plums for all of us today")], "item_id long, text string")
    rows = [(1, "add 7 apples to 7 pears and then 7 plums for all of us today"), (2, "add 7 apples to 8 pears and then 9 plums for all of us today")]
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1}


def test_languages(spark, empty):
    rng = random.Random(0)
    lexicon = {"en": "the of and house river stone walking through green".split(), "de": "der die und haus strasse gehen durch zwischen schön".split()}
    rows = [(i, " ".join(rng.choices(lexicon[l], k=40)), l, f"host{i % 2}", 1) for i, l in enumerate(["en", "de"] * 40)]
    rows += [(100, "der und haus gehen durch die strasse", "en", "host1", 1), (101, "", "en", "host0", 1), (102, None, None, None, None), (103, "12 34 !!", "de", "host1", 1), (104, "qqq zzz xxx kkk jjj " * 30, None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names, model = languages.train(docs, "text", "lang")
    assert names == ["de", "en"]
    got = {r.doc_id: r for r in languages.identify(languages.document_evidence(docs), names, model).collect()}
    assert all(got[i].language == l and got[i].accepted for i, l in enumerate(["en", "de"] * 40))
    assert got[100].text_language == "de"
    for i in (101, 102, 103, 104):
        assert got[i].language == "und" and not got[i].accepted
    none, blank = languages.train(empty, "text", "lang")
    assert none == []
    assert {r.language for r in languages.identify(languages.document_evidence(docs), none, blank).collect()} == {"und"}
    assert languages.identify(languages.document_evidence(empty), names, model).count() == 0
    pages = spark.createDataFrame([(1, "http://u@Www.Example.de:80/x", "<html lang='DE-at'><style>p</style><p>der haus</p>"), (2, None, None)], "page_id long, url string, html string")
    p = {r.page_id: r for r in languages.page_evidence(pages).collect()}
    assert (p[1].declared, p[1].host, p[1].domain, p[1].suffix, p[1].text.split()) == ("de", "www.example.de", "example.de", "de", ["der", "haus"])
    assert p[2].host is None


def test_more_than_64_languages(spark):
    """Every label is a class of its own, also those beyond the 64 most frequent."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = {f"l{i:02d}": ["".join(rng.choices(letters, k=5)) for _ in range(6)] for i in range(68)}
    rows = [(10 * i + j, " ".join(rng.choices(lexicon[x], k=40)), x, f"h{i}", 1) for i, x in enumerate(lexicon) for j in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    names, model = languages.train(docs, "text", "lang")
    assert names == list(lexicon)
    got = {r.doc_id: (r.language, r.accepted) for r in languages.identify(languages.document_evidence(docs), names, model).collect()}
    assert got == {i: (x, True) for i, _, x, _, _ in rows}
    mixed = mixing.mix_documents(docs.withColumn("source", F.lit("s")), targets=mixing.Targets(power=0.0)).groupBy("lang").agg(F.sum(F.col("tokens") * F.col("weight")).alias("m")).collect()
    assert len(mixed) == 68 and max(r.m for r in mixed) == pytest.approx(min(r.m for r in mixed), rel=1e-3)


def test_evidence_decides_between_equal_texts(spark):
    """A text that says little goes with what is declared, and without that with its host."""
    rng = random.Random(0)
    words = {"en": "abab cdcd efef".split(), "de": "ghgh klkl mnmn".split()}
    rows = [(i, " ".join(rng.choices(words[l], k=30)), l, f"{l}.host", 1) for i, l in enumerate(["en", "de"] * 60)]
    both = " ".join(["abab", "ghgh"])
    rows += [(900, both, "en", None, 1), (901, both, "de", None, 1), (902, both, None, "en.host", 1), (903, both, None, "de.host", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    names, model = languages.train(docs.filter("doc_id < 900"), "text", "lang")
    got = {r.doc_id: r.language for r in languages.identify(languages.document_evidence(docs), names, model, least=0.0).collect()}
    assert [got[i] for i in (900, 901, 902, 903)] == ["en", "de", "en", "de"]


def test_toxicity(spark, empty):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        w = words_of(rng, 60, 300)
        toxic = i % 4 == 0
        if toxic:
            for at in rng.sample(range(60), 3):
                w[at] = rng.choice(["nasty", "vile", "awful"])
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fold = F.pmod(F.col("doc_id"), F.lit(3))
    model = toxicity.train(df, df.filter(fold != 0).select("text", "toxic"))
    test = df.filter(fold == 0).select("text", "doc_id", "toxic")
    test = clash(test, "score")
    got = toxicity.score(test, model).toPandas()
    right = ((got["score"] >= 0.5).astype(int) == got["toxic"]).mean()
    assert right > 0.9
    odd = spark.createDataFrame([("",), (None,), ("nasty " * 20_000,)], "text string")
    s = [r.score for r in toxicity.score(odd.withColumn("i", F.monotonically_increasing_id()), model).orderBy("i").collect()]
    assert all(0 <= x <= 1 for x in s) and s[0] == s[1] < 0.5 < s[2]
    assert toxicity.score(empty.select("text", "doc_id"), model).count() == 0
    one = toxicity.train(df, df.filter("toxic = 0").select("text", "toxic"))
    assert toxicity.score(df.limit(3), one).count() == 3


def test_spotsigs(spark, docs, empty):
    rows = sorted({(key(r.doc_id), r.text or "") for r in docs.collect()})
    got = [tuple(r) for r in spotsigs.edited_likeness(clash(docs)).select("doc_id", "n_chars", "edited_sha256").collect()]
    # ties of the id go by a hash of the text, so only ids that come once are told by brute force
    ids = [i for i, _ in rows]
    for at, (i, t) in enumerate(rows):
        nxt = rows[(at + 1) % len(rows)]
        if ids.count(i) == 1 and ids.count(nxt[0]) == 1:
            k = len(t) // 4
            edited = t[: len(t) - k] + nxt[1][:k]
            assert (i, len(t), hashlib.sha256(edited.encode()).hexdigest()) in got
    assert len(got) == docs.count()
    assert spotsigs.edited_likeness(empty).count() == 0
    one = spotsigs.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).head()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_spot_pairs_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for i in range(12):
        w = words_of(rng, 150)
        for at in range(0, 150, 5):
            w[at] = "the"
        texts.append(w)
        for edits in (1, 6):
            v = list(w)
            for at in rng.sample(range(150), edits):
                v[at] = f"z{at}"
            texts.append(v)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, " ".join(texts[0]))], "doc_id long, text string")
    sets = {r.class_id: set(r.spots) for r in spotsigs.spot_classes(df).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.like_classes(df).collect()} == want and want


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    item = "how many apples are left in the old basket when seven of them fall down the long hill"
    rows = [(i, " ".join(words_of(rng, 60)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, rows[0][1], "en", "s0", 1), (51, " ".join(words_of(rng, 20)) + " " + item, "en", "s0", 1), (52, "", "en", "s0", 1), (53, None, None, None, None), (7, rows[7][1], "en", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d, gone = docs, []
    for name, stage in corpus.STAGES[:3]:
        new = stage(spark, d, str(tmp_path))
        assert new.columns == corpus.COLUMNS
        gone.append((name, sorted(set(r.doc_id for r in d.collect()) - set(r.doc_id for r in new.collect())), d.count() - new.count()))
        d = new
    assert gone == [("language_id", [52, 53], 2), ("near_copies", [50], 2), ("decontamination", [51], 1)]
    out = corpus.run(spark, str(tmp_path))
    assert set(out.columns) == {*corpus.COLUMNS, "curve", "shard", "slot"}
    assert 20 < out.count() <= 40
