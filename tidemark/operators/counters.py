"""Sessions that log cumulative counters: forward fill, deltas and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def forward_fill(rows: DataFrame, column: str, session: list[str], order: list[str]) -> DataFrame:
    """``column`` with nulls replaced by the latest earlier value in the session."""
    before = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(before))


def counter_delta(rows: DataFrame, counters: list[str], session: list[str], order: list[str]) -> DataFrame:
    """Each counter's growth since the session's previous row, 0 where it fell; the first row counts from 0."""
    window = Window.partitionBy(*session).orderBy(*order)
    grown = {c: F.greatest(F.lit(0).cast("long"), F.col(c) - F.lag(c, 1, 0).over(window)) for c in counters}
    return rows.withColumns(grown)


def normalised(rows: DataFrame) -> DataFrame:
    """Deltas of input (cached input included), cached and output to the four canonical counters."""
    zero = F.lit(0).cast("long")
    return rows.withColumns({"input": F.greatest(zero, F.col("input") - F.col("cached")), "cache_read": F.col("cached"), "cache_creation": zero}).drop("cached")
