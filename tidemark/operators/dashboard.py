"""Headline day, recent average, trend and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import formats
from tidemark.functions.timeutil import Now

AVERAGE_DAYS = 7


def headline(days: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """Today's row, or else that of the last day (which may be in the future), with is_today."""
    keys = keys or []
    today = F.col("day") == now.day
    best = days.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in days.columns if c not in keys]), F.struct(today, "day")).alias("h"))
    return best.where("h is not null").select(*keys, "h.*").withColumn("is_today", F.col("day") == now.day)


def recent_average(days: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """(keys, avg_tokens): whole-number mean over the last 7 days with data but the headline day; no row if there are none."""
    keys = keys or []
    window = Window.partitionBy(*keys)
    shown = F.max_by("day", F.struct(F.col("day") == now.day, F.col("day"))).over(window)
    prior = days.select(*keys, "day", "total_tokens").withColumn("_shown", shown).where(F.col("day") != F.col("_shown"))
    last = prior.withColumn("_rank", F.row_number().over(window.orderBy(F.desc("day")))).where(F.col("_rank") <= AVERAGE_DAYS)
    return last.groupBy(*keys).agg(F.expr("sum(total_tokens) div count(*)").alias("avg_tokens")).where("avg_tokens is not null")


def dashboard(days: DataFrame, forecast: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """One row a key: headline, average, projection, trend and texts. ``forecast`` is curve.projection's.

    Without keys each side has one row; it is then joined on a constant.
    """
    keys = keys or []
    by = keys or ["_all"]

    def one(frame: DataFrame) -> DataFrame:
        return frame if keys else frame.withColumn("_all", F.lit(0))

    rows = one(headline(days, now, keys)).join(one(recent_average(days, now, keys)), by, "left").join(one(forecast.select(*keys, "projected_total")), by, "left")
    projected, average, tokens = F.col("projected_total"), F.col("avg_tokens"), F.col("total_tokens")
    trend = F.when(F.col("is_today") & projected.isNotNull() & (average > 0), F.when(projected >= average, "▲").otherwise("▼"))
    cost = F.col("total_cost") * projected / F.when(tokens > 0, tokens)
    against = F.coalesce(F.concat(F.lit("   vs 7d "), formats.change(projected, average)), F.lit(""))
    line = F.concat(F.lit("Projected ~"), formats.tokens_short(projected), F.lit(" · ~"), formats.cost(cost), against)
    subtitle = F.when(~F.col("is_today"), F.concat(F.lit("Showing "), F.col("day"))).when(projected.isNull() | (tokens <= 0), "Projected — warming up").otherwise(line)
    head = F.concat(formats.tokens_short(tokens), F.lit(" · "), formats.cost(F.col("total_cost")))
    return rows.withColumns({"trend": trend, "projected_cost": F.when(F.col("is_today"), cost), "headline": head, "subtitle": subtitle}).drop("_all")
