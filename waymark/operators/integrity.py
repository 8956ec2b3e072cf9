"""Audits of tables: declared invariants, and digests that do not depend on the order of rows, all in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_code(columns: Sequence[str | Column]) -> Column:
    """60 bits of the MD5 of a row's columns as strings (null: a sign of its own), a number that other engines compute, too."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def table_digest(columns: Sequence[str | Column]) -> list[Column]:
    """Aggregates n, digest_sum (as a string) and digest_xor: equal for equal bags of rows.  The sum tells repeated rows, which cancel out in the
    exclusive or."""
    code = row_code(columns)
    return [F.count("*").alias("n"), F.sum(code.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor(code).alias("digest_xor")]


def audit(df: DataFrame, invariants: Mapping[str, Column], key: Column, digest: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, invariant, n, violations, example, digest_sum, digest_xor): how many rows break each rule (null breaks it), the least key of those,
    and the digest of all rows.  One aggregation, whatever the number of rules."""
    broken = {name: ~F.coalesce(rule, F.lit(False)) for name, rule in invariants.items()}
    each = [F.struct(F.lit(name).alias("invariant"), F.count_if(bad).alias("violations"), F.min(F.when(bad, key.cast("string"))).alias("example")) for name, bad in broken.items()]
    one = df.groupBy(*by).agg(*table_digest(digest), F.array(*each).alias("rules"))
    return one.select(*by, F.explode("rules").alias("r"), "n", "digest_sum", "digest_xor").select(*by, "r.invariant", "n", "r.violations", "r.example", "digest_sum", "digest_xor")


def complete(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """(keys, n, missing, twice, unknown): for each instance, how many of its rows there are, and which of the wanted values of a column have none, more
    than one, or are none of them."""
    have = F.collect_list(column)
    wanted = F.array(*[F.lit(v) for v in values])
    t = df.groupBy(*keys).agg(F.count("*").alias("n"), have.alias("have"))
    twice = F.filter(wanted, lambda v: F.size(F.filter("have", lambda h: h == v)) > 1)
    return t.select(*keys, "n", F.array_join(F.array_except(wanted, "have"), ",").alias("missing"), F.array_join(twice, ",").alias("twice"), F.array_join(F.sort_array(F.array_except(F.col("have"), wanted)), ",").alias("unknown"))


def recomputed(stored: DataFrame, again: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, rows, lost, extra, differing, example): where a table and its recomputation disagree.  Numbers may differ by tolerance; null
    equals null; lost rows are in stored only, extra ones in again only."""
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    a = stored.select(*keys, F.struct(*columns).alias("_a"))
    b = again.select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, list(keys), "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        kind = stored.schema[c].dataType.typeName()
        same = F.coalesce(F.abs(x - y) <= tolerance, x.eqNullSafe(y)) if kind in ("double", "float") else x.eqNullSafe(y)
        return F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~same

    each = [F.struct(F.lit(c).alias("column"), F.count_if(differs(c)).alias("differing"), F.min(F.when(differs(c), key)).alias("example")) for c in columns]
    one = both.agg(F.count("*").alias("rows"), F.count_if(F.col("_b").isNull()).alias("lost"), F.count_if(F.col("_a").isNull()).alias("extra"), F.array(*each).alias("e"))
    return one.select("rows", "lost", "extra", F.explode("e").alias("e")).select("e.column", "rows", "lost", "extra", "e.differing", "e.example")
