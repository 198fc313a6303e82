"""Two log formats to canonical usage records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.models import dedup_key, fast_tier
from tidemark.functions.timeutil import instant
from tidemark.operators.dedup import keep_max
from tidemark.operators.segments import session_records
from tidemark.sources.lines import read_lines
from tidemark.sources.shared import scratch

NEEDLE = "input_tokens"  # in every line that matters, so that others aren't parsed

# The fields of the two formats that are used.
TURN = (
    "timestamp string, requestId string, message struct<id string, model string, usage struct<input_tokens long, output_tokens long, "
    "cache_creation_input_tokens long, cache_read_input_tokens long, speed string>>, _corrupt string"
)
EVENT = (
    "type string, timestamp string, payload struct<type string, model string, info struct<total_token_usage struct<"
    "input_tokens long, cached_input_tokens long, output_tokens long>>>, _corrupt string"
)

RECORD = ["tenant", "provider", "file_path", "block", "line_no", "epoch", "model", "input", "output", "cache_creation", "cache_read", "dedup_key"]


def decoded(lines: DataFrame, schema: str) -> DataFrame:
    """Lines as ``j``; a line that isn't JSON, or has a used field of another type, is dropped. Unknown fields are ignored."""
    # From a generator, as conditions on its column aren't pushed below it, where each would parse the line again.
    parsed = lines.select("*", F.explode(F.array(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}))).alias("j"))
    return parsed.where(F.col("j").isNotNull() & F.col("j._corrupt").isNull()).drop("value")


def kept_turns() -> Column:
    """What a decoded line of turns must have: the two counts and an instant."""
    usage = F.col("j.message.usage")
    return usage["input_tokens"].isNotNull() & usage["output_tokens"].isNotNull() & F.col("epoch").isNotNull()


def turn_columns(tenant: str | None) -> list[Column]:
    """RECORD from a decoded line ``j`` and its epoch."""
    usage, zero = F.col("j.message.usage"), F.lit(0).cast("long")
    return [
        F.lit(tenant).cast("string").alias("tenant"),
        F.lit("claude-native").alias("provider"),
        F.col("file_path"),
        F.col("block"),
        F.col("line_no"),
        F.col("epoch"),
        fast_tier(F.col("j.message.model"), usage["speed"]).alias("model"),
        usage["input_tokens"].alias("input"),
        usage["output_tokens"].alias("output"),
        F.coalesce(usage["cache_creation_input_tokens"], zero).alias("cache_creation"),
        F.coalesce(usage["cache_read_input_tokens"], zero).alias("cache_read"),
        dedup_key(F.col("j.message.id"), F.col("j.requestId")).alias("dedup_key"),
    ]


def turn_records(lines: DataFrame, tenant: str | None = None) -> DataFrame:
    """Records of logs with a usage in each turn, repeats included."""
    rows = decoded(lines.where(F.col("value").contains(NEEDLE)), TURN).withColumn("epoch", instant(F.col("j.timestamp")))
    return rows.where(kept_turns()).select(*turn_columns(tenant))


#: What may become of a line: a record; another line, that isn't about usage; or one of the reasons to drop it.
FATES = ["record", "other", "not json", "wrong type", "no usage", "no instant"]


class Judged(NamedTuple):
    """Records, dropped lines (file_path, block, line_no, reason, value), and the number of lines by fate, of all lines, and of their bytes."""

    records: DataFrame
    dropped: DataFrame
    metrics: dict[str, int]


def judged_turns(lines: DataFrame, tenant: str | None = None) -> Judged:
    """As turn_records, with what becomes of every line, from one reading.

    Records and dropped lines are written side by side to the shared folder, other
    lines are only counted. A line isn't json if it can't be parsed as such, is of
    a wrong type if a used field is, and else lacks usage or an instant.
    """
    spark = lines.sparkSession
    about, usage = F.col("value").contains(NEEDLE), F.col("j.message.usage")
    parsed = lines.withColumn("j", F.when(about, F.from_json("value", TURN, {"columnNameOfCorruptRecord": "_corrupt"}))).withColumn("epoch", instant(F.col("j.timestamp")))
    bad = F.col("j").isNull() | F.col("j._corrupt").isNotNull()
    fate = (
        F.when(~about, "other")
        .when(bad & F.try_parse_json("value").isNull(), "not json")
        .when(bad, "wrong type")
        .when(usage["input_tokens"].isNull() | usage["output_tokens"].isNull() | usage.isNull(), "no usage")
        .when(F.col("epoch").isNull(), "no instant")
        .otherwise("record")
    )
    seen = Observation()
    size = F.coalesce(F.sum(F.octet_length("value")), F.lit(0))
    counts = [F.count(F.when(F.col("fate") == f, 1)).alias(f) for f in FATES]
    rows = parsed.withColumn("fate", fate).observe(seen, F.count("*").alias("lines"), size.alias("bytes"), *counts).where("fate <> 'other'")
    value = F.when(F.col("fate") != "record", F.col("value")).alias("value")
    folder = scratch(spark, "judged")
    rows.select(*turn_columns(tenant), value, "fate").write.partitionBy("fate").parquet(folder)
    schema = StructType([*turn_records(lines).schema.fields, StructField("value", StringType()), StructField("fate", StringType())])
    read = spark.read.schema(schema).parquet(folder)
    dropped = read.where("fate <> 'record'").select("file_path", "block", "line_no", F.col("fate").alias("reason"), "value")
    return Judged(read.where("fate = 'record'").select(*RECORD), dropped, seen.get)


def counter_records(lines: DataFrame, tenant: str | None = None) -> DataFrame:
    """Records of logs with cumulative counters: deltas within a file, models from the context lines before.

    The model is carried before token events are chosen, deltas are taken among
    them only. Only a few numbers of each line are shuffled, by file and block, so
    that a huge file's blocks go to many tasks.
    """
    rows = decoded(lines.where(F.col("value").contains(NEEDLE) | F.col("value").contains("turn_context")), EVENT)
    counts, zero = F.col("j.payload.info.total_token_usage"), F.lit(0).cast("long")
    context = F.when(F.col("j.type") == "turn_context", F.col("j.payload.model"))
    narrow = rows.select(
        "file_path",
        "block",
        "line_no",
        context.alias("model"),
        ((F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count")).alias("is_count"),
        instant(F.col("j.timestamp")).alias("epoch"),
        counts["input_tokens"].alias("input"),
        F.when(counts.isNotNull(), F.coalesce(counts["cached_input_tokens"], zero)).alias("cached"),
        counts["output_tokens"].alias("output"),
    )
    event = F.col("is_count") & F.col("epoch").isNotNull() & F.col("input").isNotNull() & F.col("output").isNotNull()
    records = session_records(narrow, "model", F.coalesce(event, F.lit(False)), ["file_path"], "block", ["line_no"])
    return records.withColumns({"tenant": F.lit(tenant).cast("string"), "provider": F.lit("codex"), "dedup_key": F.lit(None).cast("string")}).select(*RECORD)


def turns(spark: SparkSession, bases: list[str], tenant: str | None = None) -> DataFrame:
    """Deduplicated records of ``<base>/projects/**/*.jsonl``."""
    records = turn_records(read_lines(spark, [f"{b.rstrip('/')}/projects" for b in bases]), tenant)
    return keep_max(records, order=("file_path", "block", "line_no"))


def counters(spark: SparkSession, bases: list[str], tenant: str | None = None) -> DataFrame:
    """Records of ``<base>/sessions/**/rollout-*.jsonl``."""
    return counter_records(read_lines(spark, [f"{b.rstrip('/')}/sessions" for b in bases], "rollout-*.jsonl"), tenant)
