"""Reports as plain text columns, and their writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formats import clock
from tidemark.functions.models import total
from tidemark.functions.timeutil import Now
from tidemark.operators.rollup import TOKENS, rebucket, with_total


def daily_report(days: DataFrame) -> DataFrame:
    """day, the four counters, total and cost with six decimals.

    The cost is first rounded to nine, as the last bits of a sum depend on its order.
    """
    return days.select("day", *TOKENS, "total_tokens", F.format_string("%.6f", F.round("total_cost", 9)).alias("cost"))


def intraday_report(minutes: DataFrame, now: Now) -> DataFrame:
    """(label, tokens): today's five-minute buckets that have tokens, as HH:MM, and TOTAL."""
    sums = rebucket(minutes.where(F.col("day") == now.day)).select("bucket", total().alias("tokens")).where("tokens > 0")
    rows = with_total(sums, "bucket", "tokens")
    return rows.select(F.coalesce(clock(F.col("bucket")), F.lit("TOTAL")).alias("label"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def curve_report(forecast: DataFrame, minutes: DataFrame) -> DataFrame:
    """(prior_days, today_tokens, typical_total, projection): prior days are all but one of the days with data."""
    days = minutes.agg((F.count_distinct("day") - 1).alias("prior_days"))
    return forecast.drop("prior_days").withColumn("_all", F.lit(0)).join(days.withColumn("_all", F.lit(0)), "_all").select(
        "prior_days", "today_tokens", F.coalesce("typical_total", F.lit(0).cast("long")).alias("typical_total"), F.coalesce(F.col("projected_total").cast("string"), F.lit("n/a")).alias("projection")
    )


def write_tsv(report: DataFrame, path: str, order: list[str]) -> None:
    """Sorted by ``order`` as tab-separated text; reports have a row a day or bucket, so one file is enough."""
    report.orderBy(*order).coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)
