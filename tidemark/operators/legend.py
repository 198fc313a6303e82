"""Model legends, bands and dense by-model points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.models import short_name, vendor_class
from tidemark.operators.pricing import resolved

# Bands in stacking order, with their counters.
BANDS = [("Cache read", "cache_read"), ("Cache write", "cache_creation"), ("Input", "input"), ("Output", "output")]

# Order of vendors in legends.
VENDOR_ORDER = {"claude": 0, "gpt": 1, "other": 2}


def legend(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct models with vendor, input price, brightness and place; dearer ones are brighter, unpriced ones last.

    Ranks are over distinct models, of which a vendor has few.
    """
    named = models.select("model").where("model is not null").distinct()
    rows = named.join(resolved(named, prices).select("model", F.col("input").alias("price")), "model", "left")
    rows = rows.withColumns({"price": F.coalesce("price", F.lit(0.0)), "vendor": vendor_class(F.col("model")), "short_name": short_name(F.col("model"))})
    group = Window.partitionBy("vendor")
    rows = rows.withColumns({"rank": F.row_number().over(group.orderBy(F.desc("price"), F.desc("model"))), "_n": F.count("*").over(group)})
    bright = F.when(F.col("_n") <= 1, 0.82).otherwise(F.lit(0.92) - F.lit(0.46) * ((F.col("rank") - 1) / F.when(F.col("_n") > 1, F.col("_n") - 1)))
    order = F.when(F.col("vendor") == "claude", VENDOR_ORDER["claude"]).when(F.col("vendor") == "gpt", VENDOR_ORDER["gpt"]).otherwise(VENDOR_ORDER["other"])
    return rows.withColumns({"brightness": bright, "vendor_order": order}).drop("_n")


def bands(points: DataFrame, ids: list[str]) -> DataFrame:
    """Counters as rows: (ids, band, band_order, tokens)."""
    made = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(i).alias("band_order"), F.col(c).alias("tokens")) for i, (name, c) in enumerate(BANDS)])
    return points.select(*ids, F.inline(made))


def dense_by_model(values: DataFrame, point: str, keys: list[str] | None = None) -> DataFrame:
    """``values(keys, point, model, tokens)`` with a row for every point and model of a key, 0 where there was none."""
    keys = keys or []
    models = values.groupBy(*keys).agg(F.collect_set("model").alias("_models"))  # a key has a few dozen models
    every = values.select(*keys, point).distinct()
    every = every.join(models, keys) if keys else every.join(F.broadcast(models))  # without keys one row
    points = every.select(*keys, point, F.explode("_models").alias("model"))
    return points.join(values, [*keys, point, "model"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))


def axis_bound(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The right end of the rate axis in hours: a little beyond the last point, from 0.5 to 24, and 1 without points."""
    last = F.max("x")
    return points.groupBy(*(keys or [])).agg(F.when(last.isNull(), 1.0).otherwise(F.least(F.lit(24.0), F.greatest(F.lit(0.5), last + 0.04))).alias("bound"))
