"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_content(df: DataFrame, key: str, text: str, context: list[str] | None = None) -> DataFrame:
    """(sha256, context, first_key, n, keys_merged): rows with the same bytes (in the same context) as one, the smallest key first.
    A hash with a third of all rows is one row per task after combining."""
    ctx = context or []
    h = df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha256"), *ctx, F.col(key).alias("k"))
    return h.groupBy("sha256", *ctx).agg(F.min("k").alias("first_key"), F.count("*").alias("n"), F.max("k").alias("last_key"))


def merged_values(df: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values per group in sorted order."""
    return df.where(F.col(value).isNotNull()).select(by, value).distinct().groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("values"), F.count("*").alias("n_values"))
