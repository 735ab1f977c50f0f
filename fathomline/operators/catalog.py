"""The ledger of files: sync with the file tree, staleness, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.texts import sha256


def tag_set(meta: Column) -> Column:
    """Tags as a sorted set without leading dashes; null is the empty set, so equal sets are equal arrays."""
    tags = F.coalesce(meta, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(t, "^--", ""))))


def entries(files: DataFrame) -> DataFrame:
    """(filepath, hash, meta) of files (filepath, content, meta): a file listed under several roots has the union of their
    tags and one row. Grouped by path and hash, tags only; contents aren't shuffled."""
    rows = files.select("filepath", sha256(F.col("content").cast("binary")).alias("hash"), tag_set(F.col("meta")).alias("meta"))
    return rows.groupBy("filepath", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("meta")))).alias("meta"))


def stale(ledger: DataFrame, now: DataFrame) -> DataFrame:
    """Entries of `now` (filepath, hash, meta) that the ledger lacks or holds with another hash."""
    old = ledger.select("filepath", F.col("hash").alias("old"))
    return now.join(old, "filepath", "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash"))).drop("old")


def gone(ledger: DataFrame, now: DataFrame) -> DataFrame:
    return ledger.join(now.select("filepath"), "filepath", "left_anti")


def refresh_meta(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows with the ledger's tags where it has the file, else with their own."""
    new = ledger.select("filepath", F.col("meta").alias("_meta"))
    out = rows.join(new, "filepath", "left").withColumn("meta", F.coalesce("_meta", "meta"))
    return out.select(*rows.columns)


def merge_ledger(ledger: DataFrame, now: DataFrame) -> DataFrame:
    """now's entries, and the ledger's of files that now doesn't have: an upsert by path."""
    return now.select("filepath", "hash", "meta").unionByName(gone(ledger, now).select("filepath", "hash", "meta"))


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the row with the largest order; a map in which later entries replace earlier ones."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))
