"""Lines of append-only logs, with their order in the file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "file_path string, block long, line_no long, value string"


def literal(path: str) -> str:
    """A path whose signs of patterns stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """Distinct roots that are there; any file system that Spark knows. Needs a classic session, not Spark Connect."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = ((r, jvm.org.apache.hadoop.fs.Path(r)) for r in dict.fromkeys(r.rstrip("/") for r in roots))
    return [r for r, p in paths if p.getFileSystem(conf).exists(p)]


def read_lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file_path, block, line_no, value) of all lines of matching files below the roots, at any depth.

    Lines end at \\n only; empty lines are dropped, a last line without an end is
    kept, and lines may be long. Roots that aren't there give nothing, files that
    vanish meanwhile neither. Files stay splittable: block and line_no together
    order a file's lines, while line_no alone only orders those of one block.
    Spark itself passes over files whose names begin with _ or a dot.
    """
    found = existing(spark, roots)
    if not found:
        return spark.createDataFrame([], LINE)
    return from_paths(spark, found, pattern)


def from_paths(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text([literal(p) for p in paths])
    lines = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), "value")
    return lines.where(F.length("value") > 0)


def scan_totals(lines: DataFrame) -> DataFrame:
    """Number of lines and their bytes."""
    return lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
