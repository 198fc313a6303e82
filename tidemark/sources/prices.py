"""Price documents to price tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import COUNTERS

# Field names of the two formats, in the order of the counters.
FLAT = ["input_cost_per_token", "output_cost_per_token", "cache_creation_input_token_cost", "cache_read_input_token_cost"]
NESTED = ["input", "output", "cache_write", "cache_read"]
NESTED_PROVIDERS = ["anthropic", "openai"]


def document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("doc"))


def numbers(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def flat_prices(docs: DataFrame) -> DataFrame:
    """``docs(doc)`` of {model: {input_cost_per_token, ...}}, USD per token.

    Entries that aren't objects, or have no number as their input price, are left
    out; other prices that are missing are 0.
    """
    entries = docs.select(F.explode(F.from_json("doc", "map<string,string>")).alias("model", "value"))
    rows = entries.select("model", F.from_json("value", numbers(FLAT)).alias("p"))
    return rows.where(F.col(f"p.{FLAT[0]}").isNotNull()).select("model", *[F.coalesce(f"p.{n}", F.lit(0.0)).alias(c) for c, n in zip(COUNTERS, FLAT, strict=True)])


def nested_prices(docs: DataFrame, providers: list[str] = NESTED_PROVIDERS) -> DataFrame:
    """``docs(doc)`` of {provider: {models: {id: {cost: {input, ...}}}}}, USD per million tokens, of some providers only."""
    top = docs.select(F.explode(F.from_json("doc", "map<string,struct<models:map<string,string>>>")).alias("provider", "p"))
    models = top.where(F.col("provider").isin(providers)).select(F.explode("p.models").alias("model", "value"))
    cost = F.from_json("value", f"cost struct<{reduce(lambda a, b: f'{a}, {b}', [f'{n}: double' for n in NESTED])}>")
    rows = models.select("model", cost["cost"].alias("p")).where("p.input is not null")
    return rows.select("model", *[(F.coalesce(f"p.{n}", F.lit(0.0)) / 1e6).alias(c) for c, n in zip(COUNTERS, NESTED, strict=True)])
