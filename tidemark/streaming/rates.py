"""Token rates over a stream of usage records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import COUNTERS


def stream_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """New files' lines as a stream, without line numbers, which Spark can't give to a stream.

    A file is read once, so logs must arrive as finished segments; growing files
    need sources.stage.
    """
    rows = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.lit(None).cast("long").alias("line_no"), "value").where(F.length("value") > 0)


def refreshing(stream: DataFrame, save: Callable[[DataFrame, int], None], progress: str, mode: str = "complete", every: str = "60 seconds") -> StreamingQuery:
    """A running query that hands ``save`` the result ``every`` so often, until it is stopped.

    In complete mode that is the whole result, in update mode the rows that have
    changed, which ``changes_sink`` keeps. ``progress`` is a shared folder of its own; a
    query that is started again with it goes on where it was. ``save`` may see a batch
    twice, after a failure.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", progress).trigger(processingTime=every).start()


def changes_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``refreshing`` in update mode: each batch's rows in a folder of its number, so a tick writes what has changed and no more."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch_no", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{folder}/{epoch}")

    return save


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of ``changes_sink`` the last of each key. Merging them by itself, and writing that, keeps the folders few."""
    values = [c for c in rows.columns if c not in (*keys, "epoch_no")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch_no").alias("_last")).select(*keys, "_last.*")


def with_watermark(usage: DataFrame, late: str) -> DataFrame:
    return usage.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", late)


def tumbling(usage: DataFrame, width: str = "5 minutes", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """The four counters of each window.

    In append mode a window is given out once, ``late`` after its end, and rows that
    come for it afterwards are dropped. In complete mode late rows always count.
    """
    window = F.window("ts", width)
    return with_watermark(usage, late).groupBy(*(keys or []), window).agg(*[F.sum(c).alias(c) for c in COUNTERS]).select(*(keys or []), F.col("window.start").alias("start"), *COUNTERS)


def sliding(usage: DataFrame, width: str = "60 minutes", step: str = "1 minute", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """As tumbling, for windows that begin every ``step``."""
    window = F.window("ts", width, step)
    return with_watermark(usage, late).groupBy(*(keys or []), window).agg(*[F.sum(c).alias(c) for c in COUNTERS]).select(*(keys or []), F.col("window.start").alias("start"), *COUNTERS)


def paned(usage: DataFrame, width: str = "60 minutes", step: str = "1 minute", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """As sliding in append mode, from panes: each row is summed once into its pane of ``step``, and only panes are copied into the windows they lie in.

    ``width`` is a multiple of ``step``. A window comes once, when the watermark has
    passed its panes and itself; rows that come for it afterwards are dropped.
    """
    keys = keys or []
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    panes = with_watermark(usage, late).groupBy(*keys, F.window("ts", step)).agg(*sums)
    windows = panes.groupBy(*keys, F.window(F.window_time("window"), width, step)).agg(*sums)
    return windows.select(*keys, F.col("window.start").alias("start"), *COUNTERS)
