"""Price tables, fuzzy model matching, and the cost of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.models import FAST, record_cost
from tidemark.schema import COUNTERS, PRICES

FAST_FACTOR = 6.0

# USD per token of input, output, cache creation and cache reads.
BUNDLED = [
    ("claude-fable-5", 0.00001, 0.00005, 0.0000125, 0.000001),
    ("claude-opus-4-8", 0.000005, 0.000025, 0.00000625, 0.0000005),
    ("claude-opus-4-7", 0.000005, 0.000025, 0.00000625, 0.0000005),
    ("claude-sonnet-4-6", 0.000003, 0.000015, 0.00000375, 0.0000003),
    ("claude-haiku-4-5-20251001", 0.000001, 0.000005, 0.00000125, 0.0000001),
    ("gpt-5.5", 0.000005, 0.00003, 0.0, 0.0000005),
]


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUNDLED, PRICES)


def layered(*tables: DataFrame) -> DataFrame:
    """Price tables laid over each other, later ones on top; a model's row is replaced as a whole."""
    ranked = None
    for i, prices in enumerate(tables):
        part = prices.select("model", *COUNTERS).withColumn("_rank", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("model").agg(F.max_by(F.struct(*COUNTERS), F.struct("_rank", *COUNTERS)).alias("p"))
    return best.select("model", "p.*")


def resolved(models: DataFrame, prices: DataFrame) -> DataFrame:
    """A price row for each distinct model of ``models(model)``; models without one are absent.

    In this order: the id itself; the id less one or more -fast, at 6 times the
    price for each; the longest priced id that begins the id, with as many -fast
    taken off as leave a match. Candidates are prefixes of the few distinct ids,
    so the match is a plain hash join.
    """
    ids = models.select("model").where("model is not null").distinct()
    fast = (F.length(F.regexp_extract("model", f"((?:{FAST})*)\\z", 1)) / len(FAST)).cast("int")
    stripped = ids.withColumn("fasts", fast).withColumn("off", F.explode(F.sequence(F.lit(0), F.col("fasts"))))
    stripped = stripped.withColumn("base", F.expr(f"left(model, length(model) - {len(FAST)} * off)")).where("base <> ''")
    starts = stripped.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("base")))).withColumn("priced", F.expr("left(base, n)"))
    found = starts.join(prices.withColumnRenamed("model", "priced"), "priced")
    prefix = F.col("n") < F.length("base")
    order = F.struct(prefix.cast("int"), F.when(prefix, F.col("fasts") - F.col("off")).otherwise(F.col("off")), -F.col("n"))
    factor = F.pow(F.lit(FAST_FACTOR), F.col("off"))
    best = found.groupBy("model").agg(F.min_by(F.struct(*[(F.col(c) * factor).alias(c) for c in COUNTERS]), order).alias("p"))
    return best.select("model", "p.*")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with its cost in USD; 0 where the model is null or has no price.

    The joined side has one row for each distinct model; Spark broadcasts it if it
    is small and else shuffles.
    """
    rows = resolved(usage, prices).select("model", *[F.col(c).alias(f"price_{c}") for c in COUNTERS])
    joined = usage.join(rows, "model", "left").withColumn("cost", F.coalesce(record_cost(), F.lit(0.0)))
    return joined.select(*usage.columns, "cost")
