"""Postings of metadata keys, and accept lists made from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posting_rows(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(name, kind, str, bin, key_id): one row for each indexed entry of each row.

    This flat form is the stored one: a value that a third of all rows share
    is many rows, not one list.
    """
    wanted = sorted(keys)
    return rows.select("key_id", F.explode("value").alias("name", "v")).where(F.col("name").isin(wanted)).select("name", "v.kind",
        "v.str", "v.bin", "key_id")


def posting_counts(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(name, kind, str, bin, n): how long each posting list is; combined before it is shuffled."""
    return posting_rows(rows, keys).groupBy("name", "kind", "str", "bin").agg(F.count("*").alias("n"))


def accept(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose key_id is in an accept list."""
    return rows.join(ids.select("key_id"), "key_id", "left_semi")
