"""Inputs and outputs: logs, price documents, incremental stages, reports.

PROVIDERS maps a provider's name to a function of (spark, base folders, tenant)
that gives canonical records. A provider whose folders aren't there has no
records; a job that fails does fail, as a gap in the data would else go unseen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import logs

PROVIDERS = {"claude-native": logs.turns, "codex": logs.counters}


def read_usage(spark: SparkSession, bases: dict[str, list[str]], tenant: str | None = None) -> DataFrame:
    """All providers' records: ``bases`` maps provider names to base folders."""
    out = None
    for name, folders in bases.items():
        part = PROVIDERS[name](spark, folders, tenant).select(*logs.RECORD)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no provider is named")
    return out
