import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.plans import pipeline as P
from waymark.sources import readers, writers
from waymark.streaming import guard


def test_passages_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'T "x"', "a\tb"), ("2", "U", "c")], "id string, title string, text string")
    writers.export_corpus(df, str(tmp_path / "c"))
    got = readers.passages(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert readers.passages(spark, str(tmp_path / "c"), got.filter("id = '2'")).count() == 1
    with pytest.raises(KeyError):
        readers.load_passages(got, spark.createDataFrame([("9",)], "id string"))
    with pytest.raises(ValueError):
        writers.export_corpus(df.union(df), str(tmp_path / "d"))
    (tmp_path / "bad.tsv").write_text("id\ttitle\ttext\n")
    with pytest.raises(ValueError):
        readers.passages(spark, str(tmp_path / "bad.tsv"))


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a", "answer": ["x"]}\n\n{"question": "b", "answer": ["y"]}\n')
    (tmp_path / "q.json").write_text('[{"_id": "1", "question": "a", "answer": "x", "type": "bridge", "level": "hard"}]')
    assert [r.question for r in readers.questions(spark, str(tmp_path / "q.jsonl"), 1).collect()] == ["a"]
    assert readers.questions(spark, str(tmp_path / "q.json")).head().asDict() == {"_id": "1", "question": "a", "answer": ["x"], "type": "bridge", "level": "hard"}
    with pytest.raises(ValueError):
        readers.questions(spark, "q.txt")
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "a int", missing_ok=True).count() == 0


def test_flat_index(spark, tmp_path, monkeypatch):
    import struct

    import numpy as np

    x = np.arange(12, dtype="<f4").reshape(4, 3)
    head = lambda magic=b"IxFI", d=3, n=4, trained=True, metric=0, codes=12: struct.pack("<4siqqq?iq", magic, d, n, 1 << 20, 1 << 20, trained, metric, codes)
    path, ids = str(tmp_path / "i.bin"), str(tmp_path / "docid")
    (tmp_path / "i.bin").write_bytes(head() + x.tobytes())
    (tmp_path / "docid").write_text("a\nb\nc\nd\n")
    got = readers.flat_index(spark, path, 3, ids).orderBy("row").collect()
    assert [r.embedding for r in got] == x.tolist() and [r.id for r in got] == list("abcd")
    for bad in (head(magic=b"IxF2"), head(d=4), head(metric=1), head(codes=11), head(n=5)):
        (tmp_path / "i.bin").write_bytes(bad + x.tobytes())
        with pytest.raises(Exception, match="header|magic"):
            readers.flat_index(spark, path, 3).collect()
    (tmp_path / "i.bin").write_bytes(head() + x.tobytes()[:-2])
    with pytest.raises(Exception, match="no whole vectors"):
        readers.flat_index(spark, path, 3).collect()
    (tmp_path / "i.bin").write_bytes(head() + x.tobytes())
    (tmp_path / "docid").write_text("a\nb\n")
    with pytest.raises(ValueError, match="as many ids"):
        readers.flat_index(spark, path, 3, ids)


def test_npy(spark, tmp_path):
    import numpy as np

    x = np.arange(24, dtype="<f4").reshape(4, 3, 2)
    np.save(tmp_path / "x.npy", x)
    got = readers.npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()
    assert [r.embedding for r in got] == x.reshape(4, 6).tolist()
    np.save(tmp_path / "y.npy", x.astype("<f8"))
    with pytest.raises(ValueError, match="float32"):
        readers.npy(spark, str(tmp_path / "y.npy"))


def test_load_config(tmp_path):
    import json

    from waymark import config

    (tmp_path / "c.json").write_text(json.dumps({s: {} for s in config.SECTIONS}))
    assert set(config.load_config(str(tmp_path / "c.json"))) == set(config.SECTIONS)
    (tmp_path / "c.json").write_text(json.dumps({s: {} for s in config.SECTIONS[1:]}))
    with pytest.raises(ValueError, match="missing"):
        config.load_config(str(tmp_path / "c.json"))


def test_audit_sheet(spark, tmp_path):
    df = spark.createDataFrame([("p1", "d")], "pair_id string, dataset string")
    writers.audit_sheet(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.audit_sheet(df, str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfpair_id")
    assert readers.audit_sheet(spark, str(tmp_path / "s")).columns == ["pair_id", "dataset", "same_meaning", "answer_still_correct", "notes"]
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfpair_id,notes\np1,\n")
    assert readers.audit_sheet(spark, str(tmp_path / "b.csv")).columns == ["pair_id", "notes"]


def test_phase_resumes_and_prompts_are_asked_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "qid int, prompt string")
    ask = lambda prompts: [{"reply": x.upper()} for x in prompts]
    work = lambda df: P.call_model(df, "qid", "prompt", ask, "reply string").select("qid", "reply")
    path = str(tmp_path / "t")
    P.run_phase(spark, path, rows.limit(1), ["qid"], work)
    out = P.run_phase(spark, path, rows, ["qid"], work)
    assert sorted(map(tuple, out.collect())) == [(1, "P"), (2, "P"), (3, "Q")]


def test_escalation_falls_back(spark):
    first = spark.createDataFrame([(1, "a b", ["1", "2", "3", "4", "5"]), (2, "a b", ["1", "2", "3", "4", "5"])], "qid int, question string, doc_ids array<string>")
    follow = spark.createDataFrame([(1, "more"), (2, "A B")], "qid int, followup string")
    second = spark.createDataFrame([(1, ["9", "1", "8"]), (2, ["9"])], "qid int, ranked array<string>")
    got = {r.qid: (r.fallback, r.context, r.n_new) for r in P.escalate(first, follow, second).collect()}
    assert got == {1: (False, ["1", "2", "3", "9", "8"], 2), 2: (True, ["1", "2", "3", "4", "5"], 0)}


RATES = [200, 90, 200, 90, 90, 90, 90, 90, 300]


def test_guard_batch_and_stream_agree(spark, tmp_path):
    rows = [("w", i, float(x)) for i, x in enumerate(RATES)] + [("v", 0, 50.0), ("v", 1, 150.0)]
    df = spark.createDataFrame(rows, "worker string, seq long, rate double")
    batch = {(r.worker, r.seq) for r in guard.guard(df).filter("accepted").collect()}
    assert batch == {("w", 0), ("w", 1), ("w", 2), ("v", 0), ("v", 1)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = guard.guard_stream(stream).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.worker, r.seq) for r in spark.table("kept").collect()} == batch


def test_ingest_adds_each_key_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.7)], "k int, f1 double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        q = guard.ingest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / run), ["k"])
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_outcomes(spark):
    gen = spark.createDataFrame([(1, "A2", "the x", 2.0)], "qid int, action string, answer string, generation_latency double")
    ans = spark.createDataFrame([(1, ["x"])], "qid int, answers array<string>")
    lat = spark.createDataFrame([(1, "A2", 1.0, 0.5, 0.25)], "qid int, action string, retrieval_latency double, rerank_latency double, followup_latency double")
    r = P.outcomes(gen, ans, lat).head()
    assert (r.em, r.f1, r.latency_total, r.llm_calls) == (1.0, 1.0, 3.75, 2)


def test_phases_of_the_second_generation(spark):
    """Candidates, follow-ups and answers through a model that is a function."""
    from pyspark.sql import functions as F

    echo = lambda prompts: [{"raw": f"Query: {p.splitlines()[-2]}" if p.endswith("query:") else f"Rewrite: {p.splitlines()[0]} other words\nmore"} for p in prompts]
    q = spark.createDataFrame([("c1", "Who wrote it?", ["X"]), ("c2", "When was it?", ["Y"])], "cluster_id string, question string, answers array<string>")
    c = P.candidates(q, echo, n=3)
    assert sorted((r.cluster_id, r.pos, r.seed, r.text) for r in c.collect()) == [(k, i, 42 + i, f"{42 + i} other words") for k in ("c1", "c2") for i in range(3)]
    out = P.screen_all(c, lambda a, b: F.lit(True), lambda a, b: F.when(b.startswith("43"), 0.1).otherwise(0.9))
    assert {(r.pos, r.reason) for r in out.collect()} == {(0, None), (1, "cosine"), (2, None)}
    first = spark.createDataFrame([(1, "Who?", [("t", "body")])], "qid int, question string, passages array<struct<title:string,text:string>>")
    assert [r.followup for r in P.followups(first, echo).collect()] == ["Question: Who?"]
    assert [tuple(r) for r in P.rewrites(first, lambda p: [{"raw": "who ?"} for _ in p]).collect()] == [(1, "who ?", True)]
    assert [r.usable for r in P.rewrites(first, lambda p: [{"raw": "WHO?"} for _ in p]).collect()] == [False]
    said = lambda p: [{"raw": "Reasoning: so.\nAnswer: it"} for _ in p]
    assert [tuple(r) for r in P.generations(first.withColumn("action", F.lit("A2")), said, reason=True).collect()] == [(1, "A2", "it")]
