"""Sums of minutes over a stage by dates, deduplicated, and kept up to date by the dates that change.

best/ has each date's best row of every key. A key that has rows on several dates
counts on the one with the best of them; what it has on the others is in losers/,
and is left out of sums/. A refresh works out best/ anew for the dates that the
stage has rewritten since the last one, then the losers of those dates' keys, and
the sums of the dates where either changed. Of other dates it reads the columns of
keys, to find keys that it shares with them, and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import keep_max
from tidemark.operators.rollup import with_local_time
from tidemark.schema import COUNTERS
from tidemark.sources import days
from tidemark.sources.lines import literal
from tidemark.sources.stage import runs_of

ORDER = ("file_path", "block", "line_no")
BEST = "dedup_key string, file_path string, block long, line_no long, epoch long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", date string"
SUMS = "minute_no long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", records long, date string"
LOSERS = "dedup_key string, date string"
NAMES = [c.split()[0] for c in BEST.split(", ")]


def last_losers(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(dedup_key, date) of best rows that another date's row beats, and the stage's run that they are of."""
    if runs := runs_of(spark, folder):
        return spark.read.schema(LOSERS).parquet(literal(f"{folder}/{runs[-1]}")), runs[-1]
    return spark.createDataFrame([], LOSERS), 0


def refresh(spark: SparkSession, stage: str) -> list[str]:
    """Bring the sums up to the stage's newest run; the dates whose sums were worked out anew come back.

    All steps may be repeated: a refresh that breaks off before it has written its
    losers is done again as a whole.
    """
    base = f"{days.home(stage)}/minutes"
    _, newest = days.last_manifest(spark, stage)
    old_losers, done = last_losers(spark, f"{base}/losers")
    dates = days.dates_since(spark, stage, done)
    if not dates or newest == done:
        return []
    records = days.partitions(spark, f"{days.home(stage)}/records", BEST).where(days.on_dates(dates))
    best = days.partitions(spark, f"{base}/best", BEST)
    keys = best.where(days.on_dates(dates)).select("dedup_key").union(records.select("dedup_key")).where("dedup_key is not null").distinct()
    keys.write.mode("overwrite").parquet(f"{base}/keys/{newest}")  # read twice, and before best changes
    keys = spark.read.schema("dedup_key string").parquet(literal(f"{base}/keys/{newest}"))
    days.overwritten(keep_max(records.select(*NAMES), order=ORDER, keys=("date",)), f"{base}/best", dates)

    best = days.partitions(spark, f"{base}/best", BEST)
    shared = best.select("dedup_key", "date", "output", *ORDER).join(keys, "dedup_key", "left_semi")
    rank = F.struct(-F.col("output"), *ORDER)
    first = shared.groupBy("dedup_key").agg(F.min_by("date", rank).alias("won"), F.collect_set("date").alias("dates")).where(F.size("dates") > 1)
    lost = first.select("dedup_key", F.explode("dates").alias("date"), "won").where("date <> won").drop("won")
    lost.write.mode("overwrite").parquet(f"{base}/lost/{newest}")
    lost = spark.read.schema(LOSERS).parquet(literal(f"{base}/lost/{newest}"))
    before = old_losers.join(keys, "dedup_key", "left_semi")
    moved = lost.exceptAll(before).union(before.exceptAll(lost)).select("date").distinct()
    changed = sorted({r.date for r in moved.collect()} | set(dates))

    losers = old_losers.join(keys, "dedup_key", "left_anti").unionByName(lost)
    counted = best.where(days.on_dates(changed)).join(losers.where(days.on_dates(changed)), ["dedup_key", "date"], "left_anti")
    sums = counted.groupBy("date", F.expr("epoch div 60").alias("minute_no")).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("records"))
    days.overwritten(sums, f"{base}/sums", changed)
    losers.write.mode("overwrite").parquet(f"{base}/losers/{newest}")
    return changed


def minutes(spark: SparkSession, stage: str, tz: str = "UTC") -> DataFrame:
    """The four counters and the number of records of each local day and minute, in any zone of whole minutes."""
    sums = days.partitions(spark, f"{days.home(stage)}/minutes/sums", SUMS)
    return with_local_time(sums.withColumn("epoch", F.col("minute_no") * 60), tz).groupBy("day", "minute").agg(*[F.sum(c).alias(c) for c in [*COUNTERS, "records"]])
