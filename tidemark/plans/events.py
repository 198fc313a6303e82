"""The driver's tables as usage data: events as records, orders as costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeutil import Now

NOW = Now("2024-01-30", 870)

# The model that an event of a type counts as.
MODELS = {"purchase": "claude-opus-4-8", "view": "claude-sonnet-4-6-20260101", "click": "claude-opus-4-7-fast", "signup": "gpt-5.5"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical usage records with day and minute; a user is a tenant and a session."""
    events = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    model = F.lit("<synthetic>")
    for event, name in MODELS.items():
        model = F.when(kind == event, name).otherwise(model)
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        F.when(kind == "signup", "codex").otherwise("claude-native").alias("provider"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("file_path"),
        F.col("event_id").alias("line_no"),
        F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")).alias("epoch"),
        model.alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("input"),
        F.floor(F.col("value") * 10).cast("long").alias("output"),
        k.alias("cache_creation"),
        (k * 10).alias("cache_read"),
        F.when(kind != "error", F.concat(F.col("user_id").cast("string"), F.lit(":"), kind)).alias("dedup_key"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
    )


# The same in SQL, as a common table expression.
USAGE_SQL = """usage as (select event_id, user_id, event_type,
  case when event_type = 'signup' then 'codex' else 'claude-native' end as provider, ts,
  case event_type when 'purchase' then 'claude-opus-4-8' when 'view' then 'claude-sonnet-4-6-20260101'
    when 'click' then 'claude-opus-4-7-fast' when 'signup' then 'gpt-5.5' else '<synthetic>' end as model,
  cast(floor(value * 100) as bigint) as input, cast(floor(value * 10) as bigint) as output,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as cache_creation,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 10 as cache_read,
  case when event_type <> 'error' then user_id || ':' || event_type end as dedup_key,
  strftime(ts, '%Y-%m-%d') as day, cast(extract(hour from ts) * 60 + extract(minute from ts) as int) as minute
  from events)"""
