import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import counters, segments

SCHEMA = "session string, n long, segment long, model string, input long, cached long, output long, cost double"


def rows_of(cut, sessions=("a", "b", None), n=300):
    """Random rows, of which some have a model, some counters, some nothing; cut(i) is the segment of the i-th."""
    rng = random.Random(7)
    out = []
    for s in sessions:
        for i in range(n):
            kind = rng.random()
            model = f"m{i}" if kind < 0.05 else None
            counts = tuple(rng.randrange(100) for _ in range(3)) if kind > 0.5 else (None, None, None)
            out.append((s, i, cut(i), model, *counts, rng.choice([None, 0.5, 2.0])))
    rng.shuffle(out)
    return out


CUTS = {"one": lambda i: 0, "each row": lambda i: i, "uneven": lambda i: 0 if i < 3 else 1 if i < 200 else 5 + i // 90}


@pytest.mark.parametrize("cut", CUTS)
def test_equal_to_windows_wherever_the_cuts_are(spark, cut):
    rows = spark.createDataFrame(rows_of(CUTS[cut]), SCHEMA).withColumn("_own", F.lit("kept"))
    whole = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"total": F.coalesce(F.sum("cost").over(whole), F.lit(0)), "prev": F.last("input", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, -1)), "name": F.last("model", ignorenulls=True).over(whole)})
    got = segments.carried(rows, ["session"], "segment", ["n"], {"name": F.col("model")}, {"prev": F.col("input")}, {"total": F.col("cost")})
    assert got.columns == [*rows.columns, "name", "prev", "total"]
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

    event = F.col("input").isNotNull() & F.col("output").isNotNull()
    filled = counters.forward_fill(rows, "model", ["session"], ["n"])
    old = counters.normalised(counters.counter_delta(filled.where(event), ["input", "cached", "output"], ["session"], ["n"]))
    new = segments.session_records(rows, "model", event, ["session"], "segment", ["n"])
    assert set(new.columns) == set(old.columns)
    assert sorted(map(tuple, new.select(old.columns).collect()), key=str) == sorted(map(tuple, old.collect()), key=str)


def test_a_huge_session_runs_in_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("s").alias("session"), "id", F.expr("id div 1000").alias("segment"))
    got = segments.carried(rows, ["session"], "segment", ["id"], sums={"total": F.col("id")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 4 and max(t.n for t in tasks) < 100_000
    assert got.agg(F.max("total")).first()[0] == 199_999 * 100_000


def test_no_rows(spark):
    assert segments.carried(spark.createDataFrame([], SCHEMA), ["session"], "segment", ["n"], {"name": F.col("model")}, sums={"total": F.col("cost")}).collect() == []
