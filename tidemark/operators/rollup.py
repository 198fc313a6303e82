"""Rollups of usage records by day and minute, and merges of rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.models import listed_model, total
from tidemark.functions.timeutil import day_key, minute_of_day
from tidemark.schema import COUNTERS

#: Maps of a slot that are merged at once.
MAP_FAN = 64
TOKENS = [f"{c}_tokens" for c in COUNTERS]


def with_local_time(usage: DataFrame, tz: str = "UTC") -> DataFrame:
    """Local day and minute of each record's epoch; another zone needs no other input."""
    return usage.withColumns({"day": day_key(F.col("epoch"), tz), "minute": minute_of_day(F.col("epoch"), tz)})


def daily(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tokens, cost and models of each day: ``usage`` has day, provider and cost."""
    rows = usage.withColumn("_model", listed_model(F.col("provider"), F.col("model")))
    return rows.groupBy(*(keys or []), "day").agg(
        *[F.sum(c).alias(t) for c, t in zip(COUNTERS, TOKENS, strict=True)],
        F.sum(total()).alias("total_tokens"),
        F.sum("cost").alias("total_cost"),
        F.sort_array(F.collect_set("_model")).alias("models"),
    )


def merge_daily(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a day from several providers' rows: sums, and the union of their models."""
    return days.groupBy(*(keys or []), "day").agg(
        *[F.sum(c).alias(c) for c in [*TOKENS, "total_tokens", "total_cost"]],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
    )


def counts(days: DataFrame) -> DataFrame:
    """Daily rows with the total worked out from the four counters, whatever was stored."""
    return days.withColumn("total_tokens", sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0])))


def minute_matrix(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The four counters of each day and minute that has records."""
    return usage.groupBy(*(keys or []), "day", "minute").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def minute_by_model(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All tokens of each day, minute and model; records without a model aren't in it."""
    return usage.where("model is not null").groupBy(*(keys or []), "day", "minute", "model").agg(F.sum(total()).alias("tokens"))


def merge_minutes(minutes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Slot by slot sums of several matrices' rows."""
    return minutes.groupBy(*(keys or []), "day", "minute").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def rebucket(minutes: DataFrame, size: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Minutes gathered into buckets named by their first minute."""
    bucket = (F.col("minute") - F.col("minute") % size).alias("bucket")
    return minutes.groupBy(*(keys or []), "day", bucket).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def totals(rows: DataFrame, levels: list[list[str]], values: list[str]) -> DataFrame:
    """Sums of ``values`` by each of several lists of columns, in one aggregation, with ``level``, the list's place.

    Columns that a level doesn't group by are null in its rows; a null that comes
    from the rows is told apart by the level. Columns are in order of first mention.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    ids = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level): place for place, level in enumerate(levels)}
    sums = rows.groupingSets([[F.col(c) for c in level] for level in levels], *columns).agg(*[F.sum(v).alias(v) for v in values], F.grouping_id().alias("_id"))
    level = F.lit(None).cast("int")
    for number, place in ids.items():
        level = F.when(F.col("_id") == number, place).otherwise(level)
    return sums.withColumn("level", level).drop("_id")


def with_total(rows: DataFrame, by: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """``value`` summed by ``by``, and a row with a null ``by`` for the whole, which without keys is there for no rows too."""
    if keys:
        return totals(rows, [[*keys, by], keys], [value]).select(*keys, by, value)
    kinds = {c: rows.schema[c].dataType for c in (by, value)}
    empty = rows.sparkSession.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()], F.lit(0).alias("_rows"))
    sums = totals(rows.select(by, value, F.lit(1).alias("_rows")).union(empty), [[by], []], [value, "_rows"])
    return sums.where("level = 1 or _rows > 0").select(by, value)


def models_map(minute_models: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A map from model to tokens for each day and minute, for presentation."""
    pairs = F.array_sort(F.collect_list(F.struct("model", "tokens")))
    return minute_models.groupBy(*(keys or []), "day", "minute").agg(F.map_from_entries(pairs).alias("by_model"))


def add_maps(a: Column, b: Column) -> Column:
    """Two maps from model to tokens, added up key by key; a null map adds nothing."""
    none = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("long")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def merge_maps(rows: DataFrame, by_model: str = "by_model", keys: list[str] | None = None, fan: int = MAP_FAN) -> DataFrame:
    """One map for each day and minute from maps of several rows, without taking them apart.

    Equal maps of a slot become one first. Then its maps are merged in groups of
    about ``fan``, dealt by their hash, and the groups' maps likewise until a slot has
    one group, so that a slot with very many maps isn't gathered in one step.
    """
    slot = [*(keys or []), "day", "minute"]
    none = F.create_map().cast("map<string,bigint>")
    merged = F.aggregate("maps", none, add_maps).alias("by_model")
    entries = F.array_sort(F.map_entries(F.coalesce(by_model, none))).alias("entries")
    alike = rows.select(*slot, entries).groupBy(*slot, "entries").agg(F.count("*").alias("n"))
    times = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], e["value"] * F.col("n"))))
    rows = alike.select(*slot, times.alias("by_model"))
    most = rows.groupBy(*slot).count().agg(F.max("count")).first()[0] or 0
    while most > fan:
        most = -(-most // fan)
        part = F.pmod(F.xxhash64(F.lit(most), F.array_sort(F.map_entries("by_model"))), F.lit(most)).alias("part")
        rows = rows.groupBy(*slot, part).agg(F.collect_list("by_model").alias("maps")).select(*slot, merged)
    return rows.groupBy(*slot).agg(F.collect_list("by_model").alias("maps")).select(*slot, merged)
