"""Deduplication of turns that are logged again and again as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_max(usage: DataFrame, key: str = "dedup_key", value: str = "output", order: tuple[str, ...] = ("file_path", "line_no"), keys: tuple[str, ...] = ()) -> DataFrame:
    """One row of each key: the one with the largest value, of equals the first in order.

    Rows without a key all stay; each gets a key of its own from ``order``, so they
    spread over all tasks. The maximum pre-aggregates, so a key with very many rows
    sends one row from each task.
    """
    own = F.concat_ws("#", F.lit(""), *[F.col(c).cast("string") for c in order])
    group = usage.withColumn("_key", F.coalesce(F.concat(F.lit("k"), F.col(key)), own))
    first = F.min_by(F.struct(*usage.columns), F.struct(-F.col(value), *[F.col(c) for c in order]))
    return group.groupBy(*keys, "_key").agg(first.alias("_row")).select("_row.*")
