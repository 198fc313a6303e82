"""Texts for people: token counts, costs, multiples, changes, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(pattern: str, value: Column, digits: int) -> Column:
    """printf with ties to even, as C does it; Spark's format_string alone rounds ties up."""
    return F.format_string(pattern, F.bround(value.cast("double"), digits))


def tokens_short(n: Column) -> Column:
    """312, 2k, 72.9M, 1.2B."""
    return (
        F.when(n >= 1_000_000_000, rounded("%.1fB", n / 1e9, 1))
        .when(n >= 1_000_000, rounded("%.1fM", n / 1e6, 1))
        .when(n >= 1_000, rounded("%.0fk", n / 1e3, 0))
        .otherwise(n.cast("string"))
    )


def cost(value: Column) -> Column:
    return F.format_string("$%.2f", value.cast("double"))


def multiple(value: Column) -> Column:
    """2.3× under ten, 12× from ten on."""
    return F.when(value >= 10, rounded("%.0f×", value, 0)).otherwise(rounded("%.1f×", value, 1))


def change(current: Column, base: Column) -> Column:
    """▲ 18% or ▼ 5%; null without a positive base."""
    percent = (current.cast("double") - base.cast("double")) / F.when(base > 0, base.cast("double")) * 100
    return F.when(base > 0, F.concat(F.when(percent >= 0, "▲ ").otherwise("▼ "), rounded("%.0f%%", F.abs(percent), 0)))


def month_day(day: Column) -> Column:
    """2026-06-04 as Jun 4; other texts unchanged."""
    return F.coalesce(F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "MMM d"), day)


def clock(minute: Column) -> Column:
    """HH:MM of a minute of the day; null for null."""
    return F.when(minute.isNotNull(), F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int")))


def joined(names: Column) -> Column:
    return F.array_join(names, ", ")
