"""Phases as a graph: what is worked on again, runs that break off, and outcomes in one call."""

import re

import pytest
from pyspark.sql import functions as F

from waymark.plans import graph
from waymark.plans.client import Policy, Refused
from waymark.plans.graph import Phase
from waymark.plans.outcomes import Models, escalation_phases, fallback_report, outcome_table


def two_phases(seen, version="1", fail=()):
    def double(rows, t):
        seen.append(("double", sorted(r.k if r.k is not None else -1 for r in rows.select("k").collect())))
        if "double" in fail:
            raise RuntimeError("stopped")
        return rows.select("k", (F.col("v") * 2).alias("w"))

    def spread(rows, t):
        seen.append(("spread", sorted(r.g for r in rows.collect())))
        if "spread" in fail:
            raise RuntimeError("stopped")
        return rows.select("g", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("i")).filter("g <> 'none'")

    return [
        Phase("spread", ["g"], ["double", "source"], lambda t: t["source"].join(t["double"], "k").groupBy("g").agg(F.sum("w").alias("total")), spread),
        Phase("double", ["k"], ["source"], lambda t: t["source"].select("k", "v"), double, version),
    ]


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, g string, v int")


def test_only_changed_keys_are_worked_on(spark, tmp_path):
    root, seen = str(tmp_path / "r"), []
    rows = [(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "none", 1)]
    out, report = graph.run(two_phases(seen), {"source": table(spark, rows)}, root)
    assert [(d.phase, d.keys, d.worked) for d in report] == [("double", 4, 4), ("spread", 3, 3)]
    assert sorted(map(tuple, out["spread"].collect())) == [("a", i) for i in range(1, 7)] + [("b", 1), ("b", 2)]
    seen.clear()
    _, report = graph.run(two_phases(seen), {"source": table(spark, rows)}, root)
    assert not seen and [d.worked for d in report] == [0, 0]
    changed = [(1, "a", 1), (3, "b", 2), (4, "none", 1), (5, "c", 1)]
    out, report = graph.run(two_phases(seen), {"source": table(spark, changed)}, root)
    assert seen == [("double", [3, 5]), ("spread", ["a", "b", "c"])]
    assert sorted(map(tuple, out["spread"].collect())) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 1), ("c", 2)]
    # what comes back was kept
    seen.clear()
    out, _ = graph.run(two_phases(seen), {"source": table(spark, rows)}, root)
    assert not seen and out["double"].count() == 4
    _, report = graph.run(two_phases(seen, version="2"), {"source": table(spark, rows)}, root)
    assert [d.worked for d in report] == [4, 0]


def test_a_run_that_breaks_off_is_taken_up(spark, tmp_path):
    rows = table(spark, [(1, "a", 1), (2, "b", 2)])
    want = sorted(map(tuple, graph.run(two_phases([]), {"source": rows}, str(tmp_path / "whole"))[0]["spread"].collect()))
    root, seen = str(tmp_path / "broken"), []
    for fail in ("double", "spread"):
        with pytest.raises(RuntimeError):
            graph.run(two_phases(seen, fail=(fail,)), {"source": rows}, root)
    out, report = graph.run(two_phases(seen), {"source": rows}, root)
    assert [d.worked for d in report] == [0, 2] and sorted(map(tuple, out["spread"].collect())) == want


def test_a_part_without_a_manifest_is_not_seen(spark, tmp_path):
    root, rows = str(tmp_path / "r"), table(spark, [(1, "a", 1)])
    rows.select("k", "v", F.lit("x").alias("_key"), F.lit("y").alias("_input")).write.parquet(f"{root}/double/half/rows")
    out, report = graph.run(two_phases([]), {"source": rows}, root)
    assert report[0].worked == 1 and out["double"].count() == 1


def test_orders_and_errors(spark, tmp_path):
    p = lambda name, *needs: Phase(name, ["k"], needs, None, None)
    assert [x.name for x in graph.ordered([p("c", "b"), p("b", "a", "s"), p("a", "s")], ["s"])] == ["a", "b", "c"]
    for bad in ([p("a", "b"), p("b", "a")], [p("a", "z")], [p("a"), p("a")], [p("s")]):
        with pytest.raises(ValueError):
            graph.ordered(bad, ["s"])
    twice = table(spark, [(1, "a", 1), (1, "a", 2), (None, "a", 1)])
    with pytest.raises(ValueError, match="3 rows of inputs for 2 keys"):
        graph.run(two_phases([]), {"source": twice}, str(tmp_path / "r"))
    nulls = graph.run(two_phases([])[1:], {"source": table(spark, [(None, "a", None), (2, None, 1)])}, str(tmp_path / "n"))[0]["double"]
    assert sorted(map(str, nulls.collect())) == ["Row(k=2, w=2)", "Row(k=None, w=None)"]


def chat(log):
    """Rewrites and answers by rule; counts its calls in a file; some rewrites fail, some say nothing new."""

    def model(prompt):
        with open(log, "a") as f:
            f.write("call\n")
        question = re.findall(r"Question: (.*)", prompt)[-1]
        if prompt.startswith("Rewrite"):
            if "three" in question:
                raise Refused("no")
            raw = question if "two" in question else f"{question} green stone"
        else:
            raw = "red stone" if "red" in prompt else "nothing"
        return {"raw": raw, "input_tokens": len(prompt), "output_tokens": len(raw), "prompt_tps": 200.0}

    return model


STABLE = ["cluster_id", "variant_id", "action", "answer", "em", "f1", "fallback", "error", "retrieval_latency", "rerank_latency", "retrievals", "ce_passes", "llm_calls", "input_tokens", "output_tokens"]


@pytest.fixture(scope="module")
def corpus(spark):
    words = "red green blue stone river hill one two three four house".split()
    passages = [(f"d{i}", f"T{i}", " ".join(words[(i * j) % 11] for j in range(1, 9))) for i in range(40)] + [("dn", None, None)]
    instances = [(1, 0, "what is one red", ["red stone"]), (1, 1, "what is two red", ["red stone"]), (2, 0, "what is three hill", ["x"]), (2, 1, "what is one red", ["nothing"]), (3, 0, "what is four river", ["nothing"])]
    vectors = [(f"d{i}", [1.0 if i % 3 == c else 0.1 * (i % 5) for c in range(3)]) for i in range(40)]
    return (
        spark.createDataFrame(instances, "cluster_id int, variant_id int, question string, answers array<string>"),
        spark.createDataFrame(passages, "doc_id string, title string, text string"),
        spark.createDataFrame(vectors, "doc_id string, embedding array<double>"),
    )


def models(log):
    encode = lambda q: F.array((F.length(q) % 3 / 3.0), (F.length(q) % 5 / 5.0), F.lit(0.5))
    cross = lambda q, t: F.size(F.array_intersect(F.split(q, " "), F.split(F.coalesce(t, F.lit("")), " "))).cast("double")
    return Models(chat(log), encode, cross, rerank_seconds=0.01, retrieval_seconds=0.5)


def stable(df):
    return sorted(map(str, df.select(*STABLE).collect()))


def test_outcomes_in_one_call_and_after_each_break(spark, corpus, tmp_path):
    quick, log = Policy(first_wait=0.01), str(tmp_path / "log")
    tables, report = outcome_table(*corpus, models(log), str(tmp_path / "whole"), policy=quick)
    whole, calls = tables["outcomes"], open(log).read().count("call")
    assert [d.phase for d in report] == ["retrieval", "rewrites", "second_retrieval", "selection", "answers", "outcomes"]
    want, got = stable(whole), {(r.cluster_id, r.variant_id, r.action): r for r in whole.collect()}
    assert len(got) == 15
    assert got[1, 0, "A2"].fallback is False and got[1, 0, "A2"].retrievals == 2 and got[1, 0, "A2"].llm_calls == 2
    assert got[1, 1, "A2"].fallback and got[2, 0, "A2"].fallback and got[2, 0, "A2"].asked_latency >= 0
    assert got[1, 0, "A1"].em == 1.0 and got[2, 1, "A1"].em == 0.0
    assert got[1, 0, "A1"].latency_total == pytest.approx(0.5 + 0.01 * got[1, 0, "A1"].ce_passes + got[1, 0, "A1"].generation_latency)
    assert {r.action: (r.n, r.fallbacks) for r in fallback_report(whole).collect()} == {"A0": (5, 0), "A1": (5, 0), "A2": (5, 2)}
    # a run that ends after any phase and is called again gives the same table and asks nothing twice
    root, log = str(tmp_path / "broken"), str(tmp_path / "log2")
    for d in report[:-1]:
        outcome_table(*corpus, models(log), root, policy=quick, until=d.phase)
    tables, again = outcome_table(*corpus, models(log), root, policy=quick)
    assert [d.worked for d in again] == [0, 0, 0, 0, 0, 15] and stable(tables["outcomes"]) == want
    assert open(log).read().count("call") == calls
    # one more question: what depends on it alone is worked on
    more = corpus[0].unionByName(spark.createDataFrame([(4, 0, "what is blue house", ["x"])], corpus[0].schema))
    tables, again = outcome_table(more, *corpus[1:], models(log), root, policy=quick)
    assert [d.worked for d in again] == [1, 1, 1, 1, 3, 3] and tables["outcomes"].count() == 18


def test_escalation_in_one_call(spark, corpus, tmp_path):
    """A follow-up after reading brings new passages in; one that fails or repeats the question falls back."""

    def model(prompt):
        question = re.findall(r"Question: (.*)", prompt)[-1]
        if prompt.startswith("Below are a question"):
            if "three" in question:
                raise Refused("no")
            return {"raw": question.upper() if "two" in question else f"{question} blue river", "input_tokens": 1, "output_tokens": 1, "prompt_tps": 200.0}
        return {"raw": "Reasoning: it says so.\nAnswer: red stone", "input_tokens": 10, "output_tokens": 2, "prompt_tps": 200.0}

    own = models(str(tmp_path / "log"))
    own = Models(model, own.encode, own.cross, own.rerank_seconds, own.retrieval_seconds)
    made = lambda *a, **k: escalation_phases(*a, **k, reason=True)
    tables, report = outcome_table(*corpus, own, str(tmp_path / "r"), policy=Policy(first_wait=0.01), made=made)
    assert [d.phase for d in report] == ["retrieval", "first", "followups", "second_retrieval", "selection", "answers", "outcomes"]
    got = {(r.cluster_id, r.variant_id, r.action): r for r in tables["outcomes"].collect()}
    assert len(got) == 10 and {k[2] for k in got} == {"A1", "A2"}
    assert got[1, 1, "A2"].fallback and got[2, 0, "A2"].fallback and not got[1, 0, "A2"].fallback
    assert got[1, 0, "A2"].ce_passes > got[1, 0, "A1"].ce_passes and got[1, 0, "A2"].retrievals == 2
    assert got[1, 0, "A1"].answer == "red stone" and got[1, 0, "A1"].em == 1.0
    chosen = {(r.question, r.action): r for r in tables["selection"].collect()}
    a1, a2 = chosen["what is one red", "A1"], chosen["what is one red", "A2"]
    assert a2.doc_ids[:3] == a1.doc_ids[:3] and a2.n_new == len(set(a2.doc_ids) - set(a1.doc_ids)) and len(a2.doc_ids) == 5
    assert chosen["what is two red", "A2"].doc_ids == chosen["what is two red", "A1"].doc_ids
    _, again = outcome_table(*corpus, own, str(tmp_path / "r"), policy=Policy(first_wait=0.01), made=made)
    assert [d.worked for d in again] == [0] * 7
