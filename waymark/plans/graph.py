"""Phases as a graph over committed tables: each phase works on exactly the keys whose inputs changed.

A phase's rows stand in parts below its folder.  A part holds the rows and the keys that a run has worked on, each with a digest of the
inputs it saw; it counts once the manifest names it, which is written last.  What a phase shows to those after it
are the rows of the keys as their inputs are now.  A run that breaks off, wherever it does, leaves whole parts or none, and the
next run does what is missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Phase:
    """name; keys, the columns that name a row of inputs; needs, the phases and sources it reads; inputs, which makes one row for each key
    of them; work, which makes the phase's rows (any number for a key, with the key's columns) of some of those inputs and may read the
    needed tables for what the inputs refer to.

    What decides a key's rows must stand in its inputs: a digest of them tells whether they changed.  version: another one does
    all keys again."""

    name: str
    keys: Sequence[str]
    needs: Sequence[str]
    inputs: Callable[[Tables], DataFrame]
    work: Callable[[DataFrame, Tables], DataFrame]
    version: str = "1"


def ordered(phases: Iterable[Phase], sources: Iterable[str]) -> list[Phase]:
    """Phases, each after those it needs.  An unknown need, a name that comes twice or a cycle is an error."""
    left, known, out = list(phases), set(sources), []
    names = [p.name for p in left]
    if len(set(names)) < len(names) or known & set(names):
        raise ValueError("a name comes twice")
    if missing := {n for p in left for n in p.needs} - known - set(names):
        raise ValueError(f"nothing makes {sorted(missing)}")
    while left:
        ready = [p for p in left if set(p.needs) <= known]
        if not ready:
            raise ValueError(f"phases need one another: {sorted(p.name for p in left)}")
        out += ready
        known |= {p.name for p in ready}
        left = [p for p in left if p.name not in known]
    return out


def digest(columns: Sequence[str]) -> Column:
    """A digest of a row's columns, nulls told from what is missing."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def _parts(spark: SparkSession, root: str) -> list[str]:
    try:
        return sorted(r["part"] for r in spark.read.schema("part string").parquet(f"{root}/manifest").collect())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def _read(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    parts = _parts(spark, root)
    return spark.read.parquet(*[f"{root}/{p}/{kind}" for p in parts]) if parts else None


@dataclass(frozen=True)
class Done:
    """What a run did in a phase: its keys, and how many of them it worked on."""

    phase: str
    keys: int
    worked: int


def run_phase(phase: Phase, tables: Tables, root: str) -> tuple[DataFrame, Done]:
    """The phase's rows as its inputs are now, after work on the keys that have none yet."""
    here = f"{root.rstrip('/')}/{phase.name}"
    inputs = phase.inputs(tables)
    spark = inputs.sparkSession
    marked = inputs.withColumn("_key", digest(phase.keys)).withColumn("_input", F.sha2(F.concat(F.lit(f"{phase.version}:"), digest(inputs.columns)), 256))
    # what was worked on is read again as rows, keys and manifest need it, so it is written first
    now = f"{here}/inputs-{uuid.uuid4().hex}"
    marked.write.parquet(now)
    marked = spark.read.schema(marked.schema).parquet(now)
    n, keys = marked.count(), marked.select("_key").distinct().count()
    if keys < n:
        raise ValueError(f"{phase.name}: {n} rows of inputs for {keys} keys")
    done = _read(spark, here, "keys")
    rest = marked if done is None else marked.join(done, ["_key", "_input"], "left_anti")
    worked = rest.count() if done is not None else n
    if worked or done is None:
        part = uuid.uuid4().hex
        made = phase.work(rest.drop("_key", "_input"), tables)
        if lost := [k for k in phase.keys if k not in made.columns]:
            raise ValueError(f"{phase.name}: its rows lack {lost}")
        made = made.withColumn("_key", digest(phase.keys)).join(rest.select("_key", "_input"), "_key")
        made.write.parquet(f"{here}/{part}/rows")
        rest.select("_key", "_input").write.parquet(f"{here}/{part}/keys")
        spark.createDataFrame([(part,)], "part string").coalesce(1).write.mode("append").parquet(f"{here}/manifest")
    rows = _read(spark, here, "rows").join(marked.select("_key", "_input"), ["_key", "_input"], "left_semi")
    return rows.drop("_key", "_input"), Done(phase.name, n, worked)


def run(phases: Iterable[Phase], sources: Tables, root: str, until: str | None = None) -> tuple[dict[str, DataFrame], list[Done]]:
    """All phases' tables (or those up to and with one), and what each has done."""
    tables, report = dict(sources), []
    for phase in ordered(phases, sources):
        tables[phase.name], done = run_phase(phase, {n: tables[n] for n in phase.needs}, root)
        report.append(done)
        if phase.name == until:
            break
    return {k: v for k, v in tables.items() if k not in sources}, report
