"""Keep-max deduplication of a stream, for duplicates that come at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import keep_max
from tidemark.sources.lines import existing, literal
from tidemark.sources.stage import runs_of


def best_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """The best row of every key over all batches so far; None before the first."""
    runs = runs_of(spark, folder) if existing(spark, [folder]) else []
    if not runs:
        return None
    return keep_max(spark.read.parquet(*[literal(f"{folder}/{run}") for run in runs]))


def keep_max_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the best rows of each batch, in a folder of the batch's number.

    A batch writes no more than itself, however long the stream has run, and late
    rows always count, as ``best_rows`` merges the batches when it reads. A batch
    that is repeated after a failure overwrites its own folder. ``compact`` keeps
    the number of folders small. dropDuplicatesWithinWatermark would keep the first
    row, not the largest.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        numbered = batch.withColumn("line_no", F.coalesce("line_no", F.monotonically_increasing_id()))  # a file comes in one batch only
        keep_max(numbered).write.mode("overwrite").parquet(f"{folder}/{epoch}")

    return merge


def compact(spark: SparkSession, folder: str) -> int:
    """Merge all batches but the last into the last but one's folder; the number of folders dropped.

    The last batch stays as it is, as a stream that starts again may repeat it.
    Run it while nobody reads and no batch is written. The merged rows are first
    written beside the batches, then moved: one that breaks off loses nothing, as
    merging a row twice gives the same best row.
    """
    runs = runs_of(spark, folder)
    if len(runs) < 3:
        return 0
    old, home = runs[:-1], f"{folder}-merged"
    keep_max(spark.read.parquet(*[literal(f"{folder}/{run}") for run in old])).write.mode("overwrite").parquet(home)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path(folder).getFileSystem(conf)
    for part in files.listStatus(path(home)):
        if part.getPath().getName().startswith("part-"):
            files.rename(part.getPath(), path(f"{folder}/{old[-1]}/merged-{part.getPath().getName()}"))
    for run in old[:-1]:
        files.delete(path(f"{folder}/{run}"), True)
    files.delete(path(home), True)
    return len(old) - 1
