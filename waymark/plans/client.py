"""Asking a model from within a job: bounded concurrency, retries with back-off, and failures as rows.

Each distinct prompt is asked once.  Replies are written to a journal in a shared folder as they come, so a task that Spark
runs again, or a run that is taken up later, asks only what has no reply yet.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Columns that every reply has besides the model's own.
FACTS = T.StructType().add("error", T.StringType()).add("attempts", T.IntegerType()).add("seconds", T.DoubleType())


class Refused(Exception):
    """A reply that asking again won't change."""


@dataclass(frozen=True)
class HttpChat:
    """One completion of a server with an OpenAI-style /v1/chat/completions: text, tokens and the prompt's speed."""

    url: str
    temperature: float = 0.0
    seed: int = 42
    max_tokens: int = 256
    timeout: float = 600.0
    extra: dict = field(default_factory=lambda: {"cache_prompt": False})

    SCHEMA = "raw string, input_tokens long, output_tokens long, prompt_tps double"

    def __call__(self, prompt: str) -> dict:
        asked = {"messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "seed": self.seed, "max_tokens": self.max_tokens, **self.extra}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/v1/chat/completions", json.dumps(asked).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                said = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in (408, 409, 425, 429) or e.code >= 500:
                raise
            raise Refused(f"HTTP {e.code}") from e
        usage, timings = said.get("usage") or {}, said.get("timings") or {}
        return {"raw": said["choices"][0]["message"]["content"], "input_tokens": usage.get("prompt_tokens"), "output_tokens": usage.get("completion_tokens"), "prompt_tps": timings.get("prompt_per_second")}


@dataclass(frozen=True)
class Policy:
    """How a partition asks: calls at once, attempts of a prompt, the first wait (doubled after each attempt, up to the longest), and replies
    that are written to the journal together (1: none is ever asked for twice, more: fewer files)."""

    at_once: int = 4
    attempts: int = 4
    first_wait: float = 0.5
    longest_wait: float = 30.0
    flush: int = 1


def _attempt(model: Callable[[str], dict], prompt: str, policy: Policy) -> dict:
    """The model's reply and its facts; the error of the last attempt where all failed.  seconds are those of the attempt that counts."""
    for n in range(1, policy.attempts + 1):
        began = time.monotonic()
        try:
            return {**model(prompt), "error": None, "attempts": n, "seconds": time.monotonic() - began}
        except Exception as e:
            error = {"error": f"{type(e).__name__}: {e}", "attempts": n, "seconds": time.monotonic() - began}
            if isinstance(e, Refused) or n == policy.attempts:
                return error
            time.sleep(min(policy.longest_wait, policy.first_wait * 2 ** (n - 1)))
    raise ValueError("a prompt needs an attempt")


class _Journal:
    """Replies of a bucket of prompts: files of JSON lines, each written whole and then given its name."""

    def __init__(self, uri: str, bucket: int, run: str) -> None:
        self.store, root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        self.folder, self.run = f"{root}/{bucket}", run

    def known(self) -> dict[str, dict]:
        """Replies of any run, and failures of this one."""
        out = {}
        for f in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if f.path.endswith(".jsonl"):
                with self.store.open_input_stream(f.path) as s:
                    for line in s.read().decode().splitlines():
                        row = json.loads(line)
                        if row["reply"].get("error") is None or row["run"] == self.run:
                            out.setdefault(row["key"], row["reply"])
        return out

    def add(self, rows: list[tuple[str, dict]]) -> None:
        self.store.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with self.store.open_output_stream(path) as s:
            s.write("".join(json.dumps({"key": k, "run": self.run, "reply": r}) + "\n" for k, r in rows).encode())
        self.store.move(path, f"{path}.jsonl")


def _asker(model: Callable[[str], dict], schema: pa.Schema, policy: Policy, journal: str, run: str):
    names = schema.names[1:]

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, str, str]]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "prompt_key", "prompt")), strict=True)

        def made(found: list[tuple[str, dict]]) -> pa.RecordBatch:
            columns = [[k for k, _ in found], *([r.get(c) for _, r in found] for c in names)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        journals: dict[int, tuple[_Journal, dict[str, dict]]] = {}
        fresh: dict[int, list[tuple[str, dict]]] = {}
        ready: list[tuple[str, dict]] = []

        def collect(done) -> None:
            for future in done:
                bucket, key = running.pop(future)
                reply = future.result()
                ready.append((key, reply))
                own = fresh.setdefault(bucket, [])
                own.append((key, reply))
                if len(own) >= policy.flush:
                    journals[bucket][0].add(own)
                    fresh[bucket] = []

        running: dict = {}
        with ThreadPoolExecutor(policy.at_once) as pool:
            for bucket, key, prompt in rows():
                if bucket not in journals:
                    j = _Journal(journal, bucket, run)
                    journals[bucket] = j, j.known()
                known = journals[bucket][1].get(key)
                if known is not None:
                    ready.append((key, known))
                else:
                    if len(running) >= policy.at_once:
                        collect(wait(running, return_when=FIRST_COMPLETED).done)
                    running[pool.submit(_attempt, model, prompt, policy)] = bucket, key
                if len(ready) >= 256:
                    yield made(ready)
                    ready = []
            while running:
                collect(wait(running, return_when=FIRST_COMPLETED).done)
        for bucket, own in fresh.items():
            if own:
                journals[bucket][0].add(own)
        if ready:
            yield made(ready)

    return replies


def ask(rows: DataFrame, prompt: str, model: Callable[[str], dict], schema: str | T.StructType, journal: str, policy: Policy = Policy(), buckets: int | None = None, run: str | None = None) -> DataFrame:
    """rows with the model's reply to each one's prompt (columns of schema), error, attempts and seconds, and whether the reply is
    another row's too (reused).

    model is one call; an exception is tried again with longer waits (Refused: not), and what fails to the end is a row with its
    error and nulls.  Null prompts are not asked.  A prompt's reply stands in journal (a folder all share) from the moment it is there,
    under one of buckets; the number must stay the same for a journal.  Failures count for one run only (run: its name, one of its own by default);
    a later run asks again."""
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([T.StructField("prompt_key", T.StringType()), *own.fields, *FACTS.fields])
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("prompt_key", F.sha2(F.col(prompt).cast("binary"), 256))
    counts = keyed.filter(F.col(prompt).isNotNull()).groupBy("prompt_key").agg(F.first(prompt).alias("prompt"), F.count("*").alias("n"))
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64("prompt_key"), F.lit(n)).cast("int")).repartition(n, "bucket")
    got = dealt.select("bucket", "prompt_key", "prompt").mapInArrow(_asker(model, to_arrow_schema(full), policy, journal, run or uuid.uuid4().hex), full)
    shared = counts.select("prompt_key", (F.col("n") > 1).alias("reused"))
    return keyed.join(got, "prompt_key", "left").join(shared, "prompt_key", "left").drop("prompt_key").withColumn("reused", F.coalesce("reused", F.lit(False)))


def failures(asked: DataFrame) -> DataFrame:
    """(error, n): how often each kind of failure stands in a table of replies."""
    return asked.filter(F.col("error").isNotNull()).groupBy(F.regexp_extract("error", r"^(\w+)", 1).alias("error")).agg(F.count("*").alias("n"))
