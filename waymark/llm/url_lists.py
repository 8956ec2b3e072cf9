"""URL lists in time: which captures were listed when they were fetched.

Built from DataFrame functions only.  Dated entries that add or remove a pattern become
validity intervals, and each capture meets the interval that holds its fetch date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of an epoch: captures and intervals meet within one.
EPOCH = 32
#: Parts of each (pattern, epoch): intervals are copied to all, captures dealt over them, as one host may have a third of them.
SALT = 8


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def patterns_of(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def validity(entries: DataFrame) -> DataFrame:
    """entries: list, pattern, action (add or remove), dated.  The intervals (list, pattern, since, until) in
    which a pattern is listed; until is the first day it no longer is, null if it still is.

    Of several entries of one day a removal holds.  An add of what is listed, and a removal of what isn't,
    change nothing.  Entries with a null in any column but list are left out.  One list's entries of one
    pattern, one a day at most, are in order within a task."""
    day = entries.filter("pattern is not null and dated is not null and action in ('add', 'remove')").groupBy("list", F.lower("pattern").alias("pattern"), "dated").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("dated")
    turns = day.withColumn("was", F.lag("action", 1, "remove").over(w)).filter("action <> was")
    return turns.withColumn("until", F.lead("dated").over(w)).filter("action = 'add'").select("list", "pattern", F.col("dated").alias("since"), "until")


def listed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """Per distinct capture (id, url, fetch date): blocked, lists (names, sorted, comma-joined; empty without any) and
    since (the latest start of an interval that holds it).

    A list holds a host if its latest entry, on or before the fetch date, for the host or a domain above
    it adds it.  Captures without a host or a date are not listed; an empty list or table gives what it should."""
    c = captures.select(F.col(id_col).alias("c_id"), F.col(url_col).alias("c_url"), F.col(at_col).cast("date").alias("c_at"))
    day = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date"))
    epoch = lambda x: F.floor(day(x) / EPOCH).cast("int")
    salt = F.pmod(F.xxhash64("c_id", "c_url", "c_at"), F.lit(SALT)).cast("int")
    keyed = c.select("*", F.explode(patterns_of(host_of(F.col("c_url")))).alias("pattern")).filter("c_at is not null").select("*", epoch(F.col("c_at")).alias("epoch"), salt.alias("salt"))
    last = captures.agg(F.max(F.col(at_col).cast("date"))).head()[0]  # one date
    end = F.coalesce(F.date_sub("until", 1), F.greatest(F.col("since"), F.lit(last).cast("date")))
    spans = validity(entries).select("*", F.explode(F.sequence(epoch(F.col("since")), epoch(end))).alias("epoch")).select("*", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("salt"))
    hits = keyed.join(spans, ["pattern", "epoch", "salt"]).filter("since <= c_at and (until is null or c_at < until)").select("c_id", "c_url", "c_at", "list", "since")
    none = c.select("*", F.lit(None).cast("string").alias("list"), F.lit(None).cast("date").alias("since"))
    found = hits.withColumn("list", F.col("list").cast("string")).unionByName(none).groupBy("c_id", "c_url", "c_at").agg(F.collect_set("list").alias("lists"), F.max("since").alias("since"))
    return found.select(F.col("c_id").alias(id_col), F.col("c_url").alias(url_col), F.col("c_at").alias(at_col), F.col("since").isNotNull().alias("blocked"), F.array_join(F.array_sort("lists"), ",").alias("lists"), "since")
