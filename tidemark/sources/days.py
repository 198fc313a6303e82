"""A stage of records by UTC date: a refresh rewrites only the dates that its changed files touch.

Below a format version, records/ has a partition for each date, manifest/ a
numbered list of files with the dates that each has records of, and affected/ the
dates that each refresh rewrites, which is written before it does. Readers name a
range of dates and read those partitions only. A refresh that breaks off leaves
its number in affected/ without a manifest; the next one rewrites those dates too,
so that no rows of half a refresh stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeutil import day_key
from tidemark.sources.lines import LINE, existing, from_paths, literal
from tidemark.sources.stage import diff, listing, runs_of

VERSION = 1
MANIFEST = "path string, mtime long, size long, dates array<string>"


def home(stage: str) -> str:
    return f"{stage}/days-v{VERSION}"


def last_manifest(spark: SparkSession, stage: str) -> tuple[DataFrame, int]:
    """The newest manifest and its number; an empty one and 0 for a new stage."""
    folder = f"{home(stage)}/manifest"
    if runs := runs_of(spark, folder):
        return spark.read.schema(MANIFEST).parquet(literal(f"{folder}/{runs[-1]}")), runs[-1]
    return spark.createDataFrame([], MANIFEST), 0


def dates_since(spark: SparkSession, stage: str, run: int) -> list[str]:
    """Dates that refreshes after a run's have rewritten, or begun to. One value a date comes to the driver."""
    folder = f"{home(stage)}/affected"
    later = [literal(f"{folder}/{r}") for r in runs_of(spark, folder) if r > run]
    return sorted(r.date for r in spark.read.schema("date string").parquet(*later).distinct().collect()) if later else []


def on_dates(dates: list[str]) -> Column:
    return F.col("date").isin(dates)


def overwritten(rows: DataFrame, folder: str, dates: list[str]) -> None:
    """Let the partitions of ``dates`` hold ``rows``, and leave all others alone.

    ``rows`` may come from these partitions: they are replaced when all is written.
    Large dates are dealt to several tasks. Dates without rows lose their folder.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def there() -> dict[str, set[str]]:
        """Names of the files of each of the dates, which are of the job that wrote them."""
        homes = ((date, path(f"{folder}/date={date}")) for date in dates)
        return {date: {f.getPath().getName() for f in files.listStatus(home)} for date, home in homes if files.exists(home)}

    before = there()
    rows.hint("rebalance", "date").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    for date, names in there().items():
        if names == before.get(date):
            files.delete(path(f"{folder}/date={date}"), True)


def partitions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a table by date; none where it has no partitions yet."""
    if not existing(spark, [folder]):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(literal(folder))


def refresh(spark: SparkSession, stage: str, roots: list[str], parse: Callable[[DataFrame], DataFrame], pattern: str = "*.jsonl") -> list[str]:
    """Bring a stage up to date; the dates that were rewritten come back.

    ``parse`` maps lines to records with a file_path and an epoch that isn't null.
    Only new and changed files are parsed. The lists of changed paths and of dates
    go through the driver.
    """
    manifest, last = last_manifest(spark, stage)
    run, base = last + 1, home(stage)
    old = manifest.select("path", "dates")
    states = diff(listing(spark, roots, pattern), manifest.withColumn("run", F.lit(0).cast("long"))).join(old, "path", "left")
    states.write.mode("overwrite").parquet(f"{base}/states/{run}")
    states = spark.read.schema(states.schema).parquet(literal(f"{base}/states/{run}"))
    changed = [r.location for r in states.where(F.col("state").isin("new", "changed")).select("location").collect()]
    fresh = dated(parse(from_paths(spark, changed) if changed else spark.createDataFrame([], LINE)))
    fresh.write.mode("overwrite").parquet(f"{base}/fresh/{run}")
    fresh = spark.read.schema(fresh.schema).parquet(literal(f"{base}/fresh/{run}"))
    gone = states.where(F.col("state").isin("changed", "removed"))
    touched = fresh.select("date").union(gone.select(F.explode("dates"))).distinct()
    dates = sorted({r.date for r in touched.collect()} | set(dates_since(spark, stage, last)))
    if dates:
        spark.createDataFrame([(d,) for d in dates], "date string").coalesce(1).write.mode("overwrite").parquet(f"{base}/affected/{run}")
        ddl = schema_of(fresh)
        before = partitions(spark, f"{base}/records", ddl).where(on_dates(dates))
        # All files that aren't as the manifest has them go, also those that a broken-off refresh has brought in.
        kept = before.join(states.where("state = 'unchanged'").select(F.col("path").alias("file_path")), "file_path", "left_semi")
        overwritten(kept.select(*fresh.columns).unionByName(fresh), f"{base}/records", dates)
    found = fresh.groupBy(F.col("file_path").alias("path")).agg(F.sort_array(F.collect_set("date")).alias("found"))
    now = states.where("state <> 'removed'").join(found, "path", "left")
    some = F.coalesce(F.when(F.col("state") == "unchanged", F.col("dates")).otherwise(F.col("found")), F.array().cast("array<string>"))
    now.select("path", "mtime", "size", some.alias("dates")).write.mode("overwrite").parquet(f"{base}/manifest/{run}")
    return dates


def dated(records: DataFrame) -> DataFrame:
    return records.withColumn("date", day_key(F.col("epoch")))


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def load(spark: SparkSession, stage: str, parse: Callable[[DataFrame], DataFrame], first: str | None = None, last: str | None = None) -> DataFrame:
    """The records of all present files with their UTC date, of dates from ``first`` to ``last`` where given.

    ``parse`` tells the columns, so that an empty stage has them too. For days of another zone
    ask for a date more on both sides.
    """
    rows = partitions(spark, f"{home(stage)}/records", schema_of(dated(parse(spark.createDataFrame([], LINE)))))
    bounds = [F.col("date") >= first] * (first is not None) + [F.col("date") <= last] * (last is not None)
    return rows.where(reduce(lambda a, b: a & b, bounds)) if bounds else rows
