"""Measurements of log reading: parse throughput, a refresh after one file in a hundred has grown, shuffle per input. Prints one JSON line.

python measure.py [MB]: that many MB of turn logs, a file a day, of which one line in ten is about usage.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.sources import days, logs, rollups
from tidemark.sources.lines import read_lines

FILES = 100
LINE_BYTES = 600


def logs_of(spark: SparkSession, folder: str, mb: int, some: str) -> None:
    """Files day=0 to day=99 below a folder; ``some`` is a condition on day and line."""
    lines = spark.range(mb * 1_000_000 // LINE_BYTES).select((F.col("id") % FILES).alias("day"), F.expr(f"id div {FILES}").alias("line")).where(some)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + F.col("day") * 86_400 + F.col("line") % 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    usage = F.struct((F.col("line") % 1000).alias("input_tokens"), (F.col("line") % 77).alias("output_tokens"))
    turn = F.struct(stamp.alias("timestamp"), F.lit("r").alias("requestId"), F.struct(F.concat_ws("-", "day", F.expr("line div 30")).alias("id"), F.lit("claude-opus-4-8").alias("model"), usage.alias("usage")).alias("message"), F.repeat(F.lit("x"), 400).alias("pad"))
    other = F.struct(stamp.alias("timestamp"), F.lit("user").alias("type"), F.repeat(F.lit("y"), 560).alias("content"))
    value = F.when(F.col("line") % 10 == 0, F.to_json(turn)).otherwise(F.to_json(other))
    lines.select("day", "line", value.alias("value")).repartition(FILES, "day").sortWithinPartitions("day", "line").select("day", "value").write.mode("append").partitionBy("day").text(folder)


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 2)


def main() -> None:
    mb = int(sys.argv[1]) if len(sys.argv) > 1 else 300
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    home = tempfile.mkdtemp(prefix="spark-measure-")
    root, stage = f"{home}/logs", f"file:{home}/stage"
    logs_of(spark, root, mb, "day < 99 or line % 20 < 10")
    lines = read_lines(spark, [root], "*.txt")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(lines)
    out = {"mb": mb, "files": FILES, "lines": lines.count()}
    out["read_s"] = seconds(lambda: noop(lines))
    out["parse_s"] = seconds(lambda: noop(logs.turn_records(lines)))
    out["parse_s"] = min(out["parse_s"], seconds(lambda: noop(logs.turn_records(lines))))
    about = F.col("value").contains(logs.NEEDLE)
    out["decode_s"] = seconds(lambda: noop(logs.decoded(lines.where(about), logs.TURN)))
    out["decode_without_prefilter_s"] = seconds(lambda: noop(logs.decoded(lines, logs.TURN)))
    out["parse_mb_s"] = round(mb / out["parse_s"])
    out["full_refresh_s"] = seconds(lambda: (days.refresh(spark, stage, [root], logs.turn_records, "*.txt"), rollups.refresh(spark, stage)))
    out["records"] = days.load(spark, stage, logs.turn_records).count()
    logs_of(spark, root, mb, "day = 99 and line % 20 >= 10")  # a day's second file
    touched = []
    out["refresh_1_percent_s"] = seconds(lambda: (touched.extend(days.refresh(spark, stage, [root], logs.turn_records, "*.txt")), rollups.refresh(spark, stage)))
    out["records_rewritten"] = days.load(spark, stage, logs.turn_records).where(days.on_dates(touched)).count()
    out["nothing_new_s"] = seconds(lambda: (days.refresh(spark, stage, [root], logs.turn_records, "*.txt"), rollups.refresh(spark, stage)))
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
