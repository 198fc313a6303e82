"""Incremental scans: only files that are new or changed are parsed again.

A stage is a folder with records/ and manifest/, below a format version. A run
appends the records of the files that it parsed, marked with its number, and then
a manifest of all present files, each with the run that holds its records. The
newest manifest is the stage's content: records of a changed or vanished file, or
of a run that broke off before its manifest, have no manifest row and aren't read;
``compact`` drops them from the folder. Files are named by Spark's own name for
them, in which spaces and other signs are escaped as in a URL, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import MANIFEST
from tidemark.sources.lines import LINE, existing, from_paths, literal

VERSION = 1


def listing(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(path, mtime in whole seconds, size, location) of matching files below the roots; contents aren't read.

    path is the file's escaped name, as records have it, location the plain one to read it by.
    """
    found = existing(spark, roots)
    if not found:
        return spark.createDataFrame([], "path string, mtime long, size long, location string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load([literal(p) for p in found])
    return files.select(F.col("_metadata.file_path").alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("path").alias("location"))


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, mtime, size, run, state) with state new, changed, unchanged or removed; mtime and size as they are now."""
    old = manifest.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), "run")
    both = files.join(old, "path", "full_outer")
    same = (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size"))
    state = F.when(F.col("_mtime").isNull(), "new").when(F.col("mtime").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.withColumn("state", state).drop("_mtime", "_size")


def runs_of(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete runs below a folder of a stage, in order."""
    if not existing(spark, [folder]):
        return []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{literal(folder)}/*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName()) for s in path.getFileSystem(conf).globStatus(path))


def last_manifest(spark: SparkSession, stage: str) -> tuple[DataFrame, int]:
    """The newest complete manifest and its number; an empty one and 0 for a new stage."""
    folder = f"{stage}/v{VERSION}/manifest"
    if runs := runs_of(spark, folder):
        return spark.read.schema(MANIFEST).parquet(literal(f"{folder}/{runs[-1]}")), runs[-1]
    return spark.createDataFrame([], MANIFEST), 0


def refresh(spark: SparkSession, stage: str, roots: list[str], parse: Callable[[DataFrame], DataFrame], pattern: str = "*.jsonl") -> DataFrame:
    """Bring a stage up to date; the counts of files by state come back as (state, files).

    ``parse`` maps lines to records with a file_path. The list of changed paths
    goes through the driver, as a scan's file list always does.
    """
    manifest, last = last_manifest(spark, stage)
    run = last + 1
    base = f"{stage}/v{VERSION}"
    states = diff(listing(spark, roots, pattern), manifest)
    changed = [r.location for r in states.where(F.col("state").isin("new", "changed")).select("location").collect()]
    if changed or not last:  # a new stage has records, if none, to keep their columns
        records = parse(from_paths(spark, changed) if changed else spark.createDataFrame([], LINE))
        records.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{base}/records/{run}")
    kept = states.where("state <> 'removed'").withColumn("run", F.when(F.col("state") == "unchanged", F.col("run")).otherwise(F.lit(run).cast("long")))
    counts = states.groupBy("state").agg(F.count("*").alias("files")).collect()
    kept.select("path", "mtime", "size", "run").write.mode("overwrite").parquet(f"{base}/manifest/{run}")
    return spark.createDataFrame([(r.state, r.files) for r in counts], "state string, files long")


def load(spark: SparkSession, stage: str) -> DataFrame:
    """The records of all present files; none, but with their columns, where no file is present.

    A stage that was never refreshed has no columns but file_path.
    """
    base = f"{stage}/v{VERSION}"
    manifest, _ = last_manifest(spark, stage)
    named = [r.run for r in manifest.select("run").distinct().collect()]  # a row for each refresh that changed something
    written = runs_of(spark, f"{base}/records")
    present = [run for run in written if run in set(named)] or written[-1:]
    if not present:
        return spark.createDataFrame([], "file_path string")
    records = spark.read.parquet(*[literal(f"{base}/records/{run}") for run in present])
    return records.join(manifest.select(F.col("path").alias("file_path"), "run"), ["file_path", "run"], "left_semi").drop("run")


def compact(spark: SparkSession, stage: str) -> int:
    """Write the present files' records as one run, then drop all older runs; the number of runs dropped.

    Readers of an older state fail from then on, so this is for a time without
    readers. A compaction that breaks off before its manifest changes nothing, one
    that breaks off after it leaves older runs for the next.
    """
    base = f"{stage}/v{VERSION}"
    manifest, last = last_manifest(spark, stage)
    if not last:
        return 0
    run = last + 1
    load(spark, stage).withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{base}/records/{run}")
    manifest.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{base}/manifest/{run}")
    jvm, conf, dropped = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for kind in ("manifest", "records"):
        for old in (r for r in runs_of(spark, f"{base}/{kind}") if r < run):
            path = jvm.org.apache.hadoop.fs.Path(f"{base}/{kind}/{old}")
            dropped += bool(path.getFileSystem(conf).delete(path, True)) and kind == "records"
    return dropped
