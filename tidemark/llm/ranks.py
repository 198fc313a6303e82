"""Places in a total order, and whole groups of sorted rows, for tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank``, from 0, in the order of columns that together are unique.

    Rows are sorted by ranges and written, numbered within their partition; the
    partitions' sizes, one row each, give the offsets. No window over everything.
    ``rows`` is read twice, as range bounds are sampled, so it should be a written table.
    """
    spark = rows.sparkSession
    numbered = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    first, offsets = 0, []
    for number, n in sizes:
        offsets.append((number, first))
        first += n
    starts = spark.createDataFrame(offsets, "_part int, _first long")
    return numbered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_first") + place).drop("_part", "_first", "_at")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one group after the other, from batches that are sorted by ``keys``; one group is held at a time, beside a batch."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for k in keys:
            values = pdf[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new), len(pdf)]
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(pdf.iloc[a:b])
            if b < len(pdf):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held)
