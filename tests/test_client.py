"""The model's client: retries, failures as rows, no call twice."""

import http.server
import json
import os
import subprocess
import sys
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.plans import client

QUICK = client.Policy(at_once=3, attempts=4, first_wait=0.01)


def flaky(log, never=()):
    """Fails at every third call of a prompt, counted from a number of its own in a file that all workers share; some prompts always."""

    def model(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        n = sum(line == prompt + "\n" for line in open(log)) + len(prompt) + ord(prompt[-1])
        if prompt in never:
            raise client.Refused("no")
        if n % 3 == 0:
            raise ConnectionError("busy")
        return {"reply": prompt.upper()}

    return model


def test_every_prompt_gets_its_reply_once(spark, tmp_path):
    model = flaky(str(tmp_path / "log"), ["p7"])
    rows = spark.createDataFrame([(i, f"p{i % 20}") for i in range(50)] + [(99, None)], "k int, prompt string")
    got = client.ask(rows, "prompt", model, "reply string", str(tmp_path / "j"), QUICK, buckets=3, run="a").collect()
    assert len(got) == 51
    for r in got:
        if r.prompt is None:
            assert r.reply is None and r.attempts is None and not r.reused
        elif r.prompt == "p7":
            assert r.reply is None and r.error == "Refused: no" and r.attempts == 1
        else:
            assert r.reply == r.prompt.upper() and r.error is None and r.reused
    calls = Counter((tmp_path / "log").read_text().split())
    assert calls["p7"] == 1 and sum(calls.values()) < 20 * 2
    # the journal has all replies: another run asks for what failed alone
    again = client.ask(rows, "prompt", model, "reply string", str(tmp_path / "j"), QUICK, buckets=3, run="b")
    assert {(r.k, r.reply) for r in again.collect()} == {(r.k, r.reply) for r in got}
    new = Counter((tmp_path / "log").read_text().split()) - calls
    assert set(new) == {"p7"}


def test_what_always_fails_is_a_row(spark, tmp_path):
    def broken(prompt):
        raise TimeoutError("gone")

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")
    got = client.ask(rows, "prompt", broken, "reply string, n long", str(tmp_path / "j"), QUICK, buckets=2, run="a")
    got = spark.createDataFrame(got.collect(), got.schema)
    assert {(r.k, r.reply, r.n, r.error, r.attempts) for r in got.collect()} == {(1, None, None, "TimeoutError: gone", 4), (2, None, None, "TimeoutError: gone", 4)}
    assert [tuple(r) for r in client.failures(got).collect()] == [("TimeoutError", 2)]
    assert client.ask(rows.limit(0), "prompt", broken, "reply string", str(tmp_path / "k"), QUICK).count() == 0


RETRIED = """
import os, sys
from pyspark.sql import SparkSession
from waymark.plans import client
log, journal = sys.argv[1:]

def model(prompt):
    with open(log, "a") as f:
        f.write(prompt + "\\n")
    if prompt == "p5" and not os.path.exists(log + ".died"):
        open(log + ".died", "w").close()
        os._exit(1)  # the worker dies in the middle of its task, and Spark runs the task again
    return {"reply": prompt.upper()}

spark = SparkSession.builder.master("local[1,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
rows = spark.createDataFrame([(f"p{i}",) for i in range(12)], "prompt string")
got = client.ask(rows, "prompt", model, "reply string", journal, client.Policy(at_once=1), run="a").collect()
print("GOT", sorted((r.prompt, r.reply) for r in got) == sorted((f"p{i}", f"P{i}") for i in range(12)))
"""


def test_a_retried_task_repeats_no_call_that_was_answered(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root}
    said = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path / "log"), str(tmp_path / "j")], env=env, capture_output=True, text=True, timeout=240)
    assert "GOT True" in said.stdout, said.stderr[-2000:]
    calls = Counter((tmp_path / "log").read_text().split())
    assert calls.pop("p5") == 2 and set(calls.values()) == {1} and os.path.exists(tmp_path / "log.died")


@pytest.fixture
def server():
    count = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][0]["content"]
            count.append(text)
            code = 400 if text == "bad" else 503 if len(count) % 3 == 0 else 200
            body = json.dumps({"choices": [{"message": {"content": f"{text}/{asked['seed']}/{asked['cache_prompt']}"}}], "usage": {"prompt_tokens": len(text), "completion_tokens": 2}, "timings": {"prompt_per_second": 150.5}}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"")

        def log_message(self, *a):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_chat_over_http(spark, server, tmp_path):
    rows = spark.createDataFrame([("one",), ("two",), ("three",), ("bad",)], "prompt string")
    chat = client.HttpChat(server, seed=7, timeout=20)
    got = {r.prompt: r for r in client.ask(rows, "prompt", chat, client.HttpChat.SCHEMA, str(tmp_path / "j"), QUICK, buckets=2, run="a").collect()}
    assert got["bad"].error == "Refused: HTTP 400" and got["bad"].attempts == 1
    for p in ("one", "two", "three"):
        assert (got[p].raw, got[p].input_tokens, got[p].output_tokens, got[p].prompt_tps) == (f"{p}/7/False", len(p), 2, 150.5)


def test_nothing_is_journaled_for_rows_alone(spark, tmp_path):
    """Rows keep their columns, and those of one prompt share a reply."""
    rows = spark.range(6).select("id", F.concat(F.lit("q"), F.col("id") % 2).alias("prompt"))
    got = client.ask(rows, "prompt", lambda p: {"n": len(p)}, "n long", str(tmp_path / "j"), QUICK, buckets=2)
    assert got.columns == ["id", "prompt", "n", "error", "attempts", "seconds", "reused"] and got.count() == 6
    files = sum(len(f) for _, _, f in os.walk(tmp_path / "j"))
    assert files == 2
