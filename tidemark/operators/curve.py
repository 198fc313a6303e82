"""The intraday curve: today, a typical day, and the projection to the end of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.models import total
from tidemark.functions.timeutil import Now

STEP = 5
LEAST_SHARE = 0.05  # of a typical day that must have passed before there is a projection


def sample_of(minute: Column, now: int) -> Column:
    """The smallest sample point at or after a minute; samples are every fifth minute, now, and 1439."""
    up = (STEP * F.ceil(minute / float(STEP))).cast("int")
    return F.when((minute <= now) & ((up > now) | (minute > 1435)), now).when(minute > 1435, 1439).otherwise(up)


def samples(now: int) -> list[int]:
    return sorted({*range(0, 1440, STEP), now, 1439})


def cumulative(minutes: DataFrame, now: Now, keys: list[str]) -> DataFrame:
    """(keys, day, id, cum, day_total): running tokens at each sample point of each day up to today.

    Minutes are first summed up to their sample point, so the prefix sum runs over
    under 300 rows a day instead of 1440.
    """
    rows = minutes.where(F.col("day") <= now.day).select(*keys, "day", sample_of(F.col("minute"), now.minute).alias("id"), total().alias("tokens"))
    sums = rows.groupBy(*keys, "day", "id").agg(F.sum("tokens").alias("tokens"))
    days = sums.groupBy(*keys, "day").agg(F.sum("tokens").alias("day_total"))
    points = days.withColumn("id", F.explode(F.array(*[F.lit(s) for s in samples(now.minute)])))
    before = Window.partitionBy(*keys, "day").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    on = points.join(sums, [*keys, "day", "id"], "left")
    return on.withColumn("cum", F.sum(F.coalesce("tokens", F.lit(0).cast("long"))).over(before)).drop("tokens")


def in_order(value: Column) -> Column:
    """A mean over days that adds them in their order, so that it has the same last bit every time."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("day", value.cast("double").alias("v")))), lambda s: s["v"])
    return F.aggregate(listed, F.lit(0.0), lambda a, v: a + v) / F.count("*")


def typical(cum: DataFrame, now: Now, keys: list[str]) -> DataFrame:
    """(keys, id, typical_cum, share, prior_days): means over earlier days with tokens, each day counting alike."""
    prior = cum.where((F.col("day") < now.day) & (F.col("day_total") > 0))
    return prior.groupBy(*keys, "id").agg(in_order(F.col("cum")).alias("typical_cum"), in_order(F.col("cum") / F.col("day_total")).alias("share"), F.count("*").cast("int").alias("prior_days"))


def curve_parts(minutes: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, cum, typical_cum, share, prior_days, now_cum, projected): all that the series are made of."""
    keys = keys or []
    cum = cumulative(minutes, now, keys)
    today = cum.where(F.col("day") == now.day).select(*keys, "id", "cum")
    if keys:
        base = minutes.select(*keys).distinct().withColumn("id", F.explode(F.array(*[F.lit(s) for s in samples(now.minute)])))
    else:
        base = minutes.sparkSession.createDataFrame([(s,) for s in samples(now.minute)], "id int")
    joined = base.join(typical(cum, now, keys), [*keys, "id"], "left").join(today, [*keys, "id"], "left").withColumn("cum", F.coalesce("cum", F.lit(0).cast("long")))
    at_now = F.col("id") == now.minute
    group = Window.partitionBy(*keys)  # of under 300 rows each
    rows = joined.withColumns({"now_cum": F.max(F.when(at_now, F.col("cum"))).over(group), "_share": F.max(F.when(at_now, F.col("share"))).over(group)})
    ready = (F.col("_share") >= LEAST_SHARE) & (F.col("now_cum") > 0)
    return rows.withColumn("projected", F.when(ready, F.col("now_cum") / F.when(F.col("_share") > 0, F.col("_share")))).drop("_share")


def curve(minutes: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """(keys, series, id, hour, tokens) of the series today, typical and predicted; numbers are cut to whole tokens.

    Lines end exactly: today at now, the others at id 1440 (hour 24) with the whole
    day's figure. The predicted line begins at now. A sample point gives its rows of
    all series at once, so the joins and windows before are run once.
    """
    keys = keys or []
    parts = curve_parts(minutes, now, keys)
    step, m = F.col("id") % STEP == 0, now.minute
    whole, last = F.col("id") <= 1435, F.col("id") == 1439
    share = F.col("projected") * F.col("share")

    def point(series: str, where: Column, tokens: Column, id_: Column | None = None) -> Column:
        id_ = F.col("id") if id_ is None else id_
        return F.when(where, F.struct(F.lit(series).alias("series"), id_.cast("int").alias("id"), (id_ / 60.0).alias("hour"), tokens.cast("long").alias("tokens")))

    some, forecast = F.col("typical_cum").isNotNull(), F.col("projected").isNotNull()
    made = [
        point("today", (F.col("id") <= m) & (step | (F.col("id") == m)), F.col("cum")),
        point("typical", some & step & whole, F.col("typical_cum")),
        point("typical", some & last, F.col("typical_cum"), F.lit(1440)),
        point("predicted", forecast & step & whole & (F.col("id") >= m), share),
        point("predicted", forecast & last, F.col("projected"), F.lit(1440)),
    ]
    if m % STEP:
        made.append(point("predicted", forecast & (F.col("id") == m), F.col("now_cum")))
    return parts.select(*keys, F.inline(F.array_compact(F.array(*made))))


def projection(minutes: DataFrame, now: Now, keys: list[str] | None = None) -> DataFrame:
    """(keys, now_minute, today_tokens, typical_total, prior_days, projected_total): one row a key.

    The same figures as the curve's, from two sums a day and no sample points.
    """
    keys = keys or []
    rows = minutes.select(*keys, "day", "minute", total().alias("tokens"))
    zero, past = F.lit(0).cast("long"), F.col("day") < now.day
    days = rows.groupBy(*keys, "day").agg(F.sum(F.when(F.col("minute") <= now.minute, F.col("tokens")).otherwise(zero)).alias("cum"), F.sum("tokens").alias("day_total"))
    typical_day = past & (F.col("day_total") > 0)
    n = F.count(F.when(typical_day, 1))

    def mean(value: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(typical_day, F.struct("day", value.cast("double").alias("v")))))
        return F.aggregate(F.transform(listed, lambda s: s["v"]), F.lit(0.0), lambda a, v: a + v) / F.when(n > 0, n)

    today = F.coalesce(F.max(F.when(F.col("day") == now.day, F.col("cum"))), zero)
    one = days.groupBy(*keys).agg(today.alias("today_tokens"), mean(F.col("day_total")).alias("typical"), mean(F.col("cum") / F.when(F.col("day_total") > 0, F.col("day_total"))).alias("share"), n.cast("int").alias("prior_days"))
    ready = (F.col("share") >= LEAST_SHARE) & (F.col("today_tokens") > 0)
    return one.select(
        *keys,
        F.lit(now.minute).alias("now_minute"),
        "today_tokens",
        F.col("typical").cast("long").alias("typical_total"),
        "prior_days",
        F.when(ready, F.col("today_tokens") / F.when(F.col("share") > 0, F.col("share"))).cast("long").alias("projected_total"),
    )
