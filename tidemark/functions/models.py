"""Model ids, keys and costs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import COUNTERS

FAST = "-fast"
SYNTHETIC = "<synthetic>"


def total() -> Column:
    return reduce(lambda a, b: a + b, map(F.col, COUNTERS))


def fast_tier(model: Column, speed: Column) -> Column:
    """Turns at priority speed are a model of their own."""
    return F.when((speed == "fast") & model.isNotNull(), F.concat(model, F.lit(FAST))).otherwise(model)


def dedup_key(message_id: Column, request_id: Column) -> Column:
    """Null, so never a duplicate, where either part is missing."""
    return F.concat(message_id, F.lit(":"), request_id)


def hashed_key(key: Column) -> Column:
    """The first 12 bytes of SHA-256, in base 64."""
    return F.base64(F.substring(F.unhex(F.sha2(key, 256)), 1, 12))


def vendor_class(model: Column) -> Column:
    return F.when(model.startswith("claude"), "claude").when(model.startswith("gpt") | model.contains("codex"), "gpt").otherwise("other")


def short_name(model: Column) -> Column:
    """Without a leading claude- and a trailing date."""
    return F.regexp_replace(F.regexp_replace(model, "^claude-", ""), "-20[0-9]{6}\\z", "")


def listed_model(provider: Column, model: Column) -> Column:
    """The model as lists of models show it: turns that the tool made up itself aren't listed, though their tokens count."""
    return F.when(~((provider == "claude-native") & (model == SYNTHETIC)), model)


def record_cost() -> Column:
    """Counters times prices, in the order of the counters; columns price_* come from a price join."""
    return reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.col(f"price_{c}") for c in COUNTERS])
