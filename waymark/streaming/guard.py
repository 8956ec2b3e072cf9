"""Slow runs in a log of calls, in batch and as a stream; outcomes that arrive in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark import config as C


def guard(calls: DataFrame, rate: str = "rate", seq: str = "seq", by: str = "worker", slowest: float = C.SLOW_RATE, run: int = C.SLOW_RUN) -> DataFrame:
    """calls with slow, run_length (slow calls in a row up to here) and accepted: a call counts unless it belongs to, or
    comes after, a worker's first run of that many slow calls."""
    w = Window.partitionBy(by).orderBy(seq)
    slow = F.col(rate) < slowest
    t = calls.withColumn("slow", slow).withColumn("_fast", F.sum((~slow).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(by, "_fast").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("run_length", F.sum(F.col("slow").cast("int")).over(own))
    t = t.withColumn("_stop", F.min(F.when(F.col("run_length") >= run, F.col(seq))).over(Window.partitionBy(by)))
    last = F.max(F.when(~F.col("slow") & (F.col(seq) < F.col("_stop")), F.col(seq))).over(Window.partitionBy(by))
    kept = F.col("_stop").isNull() | (F.col(seq) <= F.coalesce(last, F.lit(-1)))
    return t.withColumn("accepted", kept).drop("_fast", "_stop")


def guard_stream(calls: DataFrame, by: str = "worker", slowest: float = C.SLOW_RATE, run: int = C.SLOW_RUN) -> DataFrame:
    """The same as a stream of (worker, seq, rate), in the order in which calls arrive: a slow call is held back until a
    fast one follows, and after the run nothing of the worker is let through."""
    schema = "worker string, seq long, rate double"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, stopped = state.get if state.exists else ([], False)
        held, out = [tuple(x) for x in held], []
        for frame in frames:
            for seq, rate in frame.sort_values("seq")[["seq", "rate"]].itertuples(index=False):
                if stopped:
                    break
                held.append((int(seq), float(rate)))
                if rate >= slowest:
                    out += held
                    held = []
                elif len(held) >= run:
                    stopped, held = True, []
        state.update(([list(map(float, x)) for x in held], stopped))
        yield pd.DataFrame({"worker": [key[0]] * len(out), "seq": pd.Series([int(x[0]) for x in out], dtype="int64"), "rate": pd.Series([x[1] for x in out], dtype="float64")})

    named = calls.select(F.col(by).cast("string").alias("worker"), F.col("seq").cast("long"), F.col("rate").cast("double"))
    return named.groupBy("worker").applyInPandasWithState(step, schema, "held array<array<double>>, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Outcome rows as they arrive, each key once: a batch that comes again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
