"""Checks that the eager world does with exceptions: small jobs of their own, or rules within a column that fail the job that reads it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    twice = df.groupBy(*keys).count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"{what}: {tuple(twice[0])[:-1]} comes more than once")
    return df


def require_all(wanted: DataFrame, there: DataFrame, keys: Sequence[str], what: str) -> None:
    """Every key of wanted is in there."""
    lost = wanted.join(there.select(*keys), list(keys), "left_anti").head(1)
    if lost:
        raise KeyError(f"{what}: nothing for {lost[0].asDict()}")


def require(df: DataFrame, rule: Column, what: str) -> DataFrame:
    """No row breaks the rule; null breaks it."""
    bad = df.filter(~F.coalesce(rule, F.lit(False))).head(1)
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")
    return df


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def demanded(value: Column, rule: Column, what: str, keys: Sequence[str]) -> Column:
    """value where the rule holds; else the job that computes it fails, naming the row's keys.  It costs no pass of its own, and what
    nothing reads is not checked."""
    names = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    return F.when(F.coalesce(rule, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), names)))


def matched(table: DataFrame, values: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """table with the columns of its rows' values, by key.  A row without values, or with more than one row of them, fails the job that
    reads a column of them.  Keys are counted in the grouping that the join needs anyway."""
    own = [c for c in values.columns if c not in keys]
    one = values.groupBy(*keys).agg(F.count("*").alias("_values"), *[F.first(c).alias(c) for c in own])
    t = table.join(one, list(keys), "left")
    once = lambda c: demanded(demanded(F.col(c), F.col("_values") == 1, f"{what}: more than one row for", keys), F.col("_values").isNotNull(), f"{what}: nothing for", keys)
    return t.select(*table.columns, *[once(c).alias(c) for c in own])
