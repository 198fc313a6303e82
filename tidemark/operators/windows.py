"""Windows over days and minutes: recent days, sliding minutes, five-minute points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timeutil import Now, day_before
from tidemark.operators.rollup import rebucket
from tidemark.schema import COUNTERS


def spine(frame: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Rows ``i`` from 0 to n - 1, for each of the frame's keys if there are any."""
    if not keys:
        return frame.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    if n <= 0:
        return frame.select(*keys).limit(0).withColumn("i", F.lit(0))
    return frame.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def on_spine(points: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Spine points with the counters that fall on them, 0 where none do."""
    return points.join(values, by, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTERS})


def recent_days(minutes: DataFrame, now: Now, count: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of the latest count + 1 days with data that aren't after today.

    Ranks are over distinct days, so without keys one task sorts no more than
    there are days.
    """
    keys = keys or []
    days = minutes.where(F.col("day") <= now.day).select(*keys, "day").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    kept = days.withColumn("_rank", rank).where(F.col("_rank") <= count + 1).drop("_rank")
    return minutes.join(kept, [*keys, "day"], "left_semi")


def last_minutes(minutes: DataFrame, now: Now, count: int, keys: list[str] | None = None) -> DataFrame:
    """Exactly ``count`` rows, oldest first by i, for the minutes up to now; yesterday's tail comes before today's head.

    x is minutes from now, 0 for the newest. Missing minutes are 0.
    """
    keys = keys or []
    at = F.col("i") + (now.minute - count + 1)
    today = F.lit(now.day)
    points = spine(minutes, count, keys).withColumns({"day": F.when(at >= 0, today).otherwise(day_before(today)), "minute": F.when(at >= 0, at).otherwise(at + 1440), "x": (F.col("i") - (count - 1)).cast("double")})
    near = minutes.where(F.col("day").between(day_before(today), today))
    return on_spine(points, near, [*keys, "day", "minute"])


def rate_points(minutes: DataFrame, now: Now, keys: list[str] | None = None, size: int = 5) -> DataFrame:
    """Today's buckets up to now: id the first minute, x in hours, at now for the bucket that isn't over.

    The last bucket is summed whole, with minutes after now if there are any.
    """
    keys = keys or []
    cap = min(max(now.minute, 0), 1439)
    start = F.col("i") * size
    points = spine(minutes, cap // size + 1, keys).select(*keys, start.alias("bucket"))
    at = F.when(F.col("bucket") + size > cap, F.lit(cap)).otherwise(F.col("bucket"))
    sums = rebucket(minutes.where(F.col("day") == now.day), size, keys).drop("day")
    return on_spine(points, sums, [*keys, "bucket"]).select(*keys, F.col("bucket").alias("id"), (at / 60.0).alias("x"), *COUNTERS)


def last_days(days: DataFrame, count: int, keys: list[str] | None = None) -> DataFrame:
    """The latest ``count`` days of each key."""
    keys = keys or []
    if not keys:
        return days.orderBy(F.desc("day")).limit(count)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    return days.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def sparse_labels(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every k-th day, k a quarter of their number but 1 at least, so that about four labels stand under the bars."""
    keys = keys or []
    window = Window.partitionBy(*keys)
    place, n = F.row_number().over(window.orderBy("day")), F.count("*").over(window)
    rows = days.withColumns({"_place": place, "_step": F.greatest(F.lit(1).cast("long"), F.floor(n / 4))})
    return rows.where((F.col("_place") - 1) % F.col("_step") == 0).drop("_place", "_step")
