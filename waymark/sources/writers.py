"""Writers, and tables that phases add to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.guards import require_unique


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def passages_cache(df: DataFrame, path: str, group_bytes: int = 16 << 20) -> None:
    """Passages in the order of their ids, in files and row groups that ranges of ids prune."""
    df.select("id", "title", "text").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.block.size", str(group_bytes)).parquet(path)


def vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_corpus(df: DataFrame, path: str) -> None:
    """Tab-separated gzip files with doubled quotes; an id that comes twice is an error."""
    require_unique(df, ["id"], "passages")
    df.select("id", "text", "title").write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', compression="gzip")


def audit_sheet(df: DataFrame, path: str) -> None:
    """A sheet to fill in, with a byte-order mark before the first name so that spreadsheets read it as UTF-8; one that is there
    already is left alone (an error)."""
    blank = ["same_meaning", "answer_still_correct", "notes"]
    sheet = df.select("*", *[F.lit("").alias(c) for c in blank if c not in df.columns])
    marked = sheet.toDF("\ufeff" + sheet.columns[0], *sheet.columns[1:])
    marked.coalesce(1).write.mode("errorifexists").csv(path, header=True, escape='"')


def report(df: DataFrame, path: str) -> None:
    """A report of a few rows, one JSON object a row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def todo(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")
