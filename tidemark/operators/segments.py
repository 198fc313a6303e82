"""Forward fills, lags and running sums of sessions of any size.

A window over a session is one task. Here a session is cut into segments, ranges
of its order that together are the whole: blocks of a file, or line numbers
divided by some size. Windows run within segments, in many tasks. What a segment
takes over from those before it, its last values and sums, is worked out from one
row a segment and joined back, and the results are the same wherever the cuts are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.counters import normalised


def carried(rows: DataFrame, session: list[str], segment: str, order: list[str], last: dict[str, Column] | None = None, before: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with new columns, each over the rows of its session in order.

    ``last``: the latest value that isn't null up to the row itself; ``before``: up
    to the row before; ``sums``: the sum up to the row itself, in which nulls count
    as 0. Segments are in the same order as their rows. One shuffle by session and
    segment; the join has one row a segment.
    """
    last, before, sums = last or {}, before or {}, sums or {}
    keys = [*session, segment]
    within = Window.partitionBy(*keys).orderBy(*order)
    upto, above = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"_own_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in last.items()}
    own |= {f"_own_{n}": F.last(c, ignorenulls=True).over(above) for n, c in before.items()}
    own |= {f"_own_{n}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
    place = F.struct(*order)
    ends = {f"_end_{n}": F.max_by(c, F.when(c.isNotNull(), place)) for n, c in {**last, **before}.items()}
    ends |= {f"_end_{n}": F.sum(c) for n, c in sums.items()}
    summaries = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()])
    earlier = Window.partitionBy(*session).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carry = {f"_in_{n}": F.last(f"_end_{n}", ignorenulls=True).over(earlier) for n in (*last, *before)}
    carry |= {f"_in_{n}": F.sum(f"_end_{n}").over(earlier) for n in sums}
    taken = summaries.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c.alias(n) for n, c in carry.items()])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    joined = rows.withColumns(own).join(taken, same, "left")
    out = {n: F.coalesce(f"_own_{n}", f"_in_{n}") for n in (*last, *before)}
    out |= {n: F.col(f"_own_{n}") + F.coalesce(f"_in_{n}", F.lit(0)) for n in sums}
    return joined.withColumns(out).select(*[c for c in rows.columns if c not in out], *out)


def session_records(rows: DataFrame, model: str, is_event: Column, session: list[str], segment: str, order: list[str]) -> DataFrame:
    """The events among ``rows`` with their model and the four counters: as forward_fill, counter_delta and normalised, in one pass.

    The model is the latest of all rows up to the event; input, cached and output are growths
    since the event before, never below 0.
    """
    names = ["input", "cached", "output"]
    seen = F.when(is_event, F.struct(*names))
    filled = carried(rows.withColumn("_event", is_event), session, segment, order, {model: F.col(model)}, {"_seen": seen})
    zero = F.lit(0).cast("long")
    grown = {c: F.greatest(zero, F.col(c) - F.coalesce(F.col("_seen")[c], zero)) for c in names}
    return normalised(filled.where("_event").withColumns(grown).drop("_event", "_seen"))
