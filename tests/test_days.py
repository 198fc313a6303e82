import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollup
from tidemark.operators.dedup import keep_max
from tidemark.sources import days, logs, rollups
from tidemark.sources.lines import read_lines


def turn(key, day, output, minute=0):
    message = {"message": {"usage": {"input_tokens": 1, "output_tokens": output}}} if key is None else {"requestId": "r", "message": {"id": key, "usage": {"input_tokens": 1, "output_tokens": output}}}
    return json.dumps({"timestamp": f"2026-06-{day:02d}T10:{minute:02d}:00Z"} | message)


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(f"{x}\n" for x in lines))


def files_of(folder):
    """Part files of each date, with their times of writing."""
    return {d: sorted((f, os.stat(f"{folder}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in sorted(os.listdir(folder)) if d.startswith("date=")}


def from_scratch(spark, root, tz="UTC"):
    best = keep_max(logs.turn_records(read_lines(spark, [root])), order=("file_path", "block", "line_no"))
    rows = rollup.with_local_time(best, tz).groupBy("day", "minute").agg(*[F.sum(c) for c in ("input", "output", "cache_creation", "cache_read")], F.count("*"))
    return sorted(map(tuple, rows.collect()))


def test_refreshes_rewrite_their_dates_only(spark, tmp_path):
    root, stage = f"{tmp_path}/logs", f"file:{tmp_path}/stage"
    records, sums = f"{tmp_path}/stage/days-v1/records", f"{tmp_path}/stage/days-v1/minutes/sums"

    def step(*dates, sums_of=()):
        """After a refresh that rewrites these dates, and these sums: all is as if it had been read anew."""
        before = [files_of(x) if os.path.isdir(x) else {} for x in (records, sums)]
        assert days.refresh(spark, stage, [root], logs.turn_records) == [f"2026-06-{d:02d}" for d in dates]
        assert rollups.refresh(spark, stage) == [f"2026-06-{d:02d}" for d in sums_of]
        for old, folder, changed in zip(before, (records, sums), (dates, sums_of), strict=True):
            now = files_of(folder) if os.path.isdir(folder) else {}
            assert {x for x in {*old, *now} if old.get(x) != now.get(x)} <= {f"date=2026-06-{d:02d}" for d in changed}
        for tz in ("UTC", "Asia/Kolkata"):
            assert sorted(map(tuple, rollups.minutes(spark, stage, tz).collect())) == from_scratch(spark, root, tz)
        rows = days.load(spark, stage, logs.turn_records)
        assert rows.count() == logs.turn_records(read_lines(spark, [root])).count()
        assert rows.where(F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd") != F.col("date")).count() == 0

    step()
    write(f"{root}/a.jsonl", [turn("k", 1, 5), turn("k", 1, 7), turn("m", 2, 4), turn(None, 3, 1), turn(None, 3, 1)])
    write(f"{root}/b b.jsonl", [turn("k", 4, 7), turn("n", 4, 3), turn("k", 4, 2, 9)])
    write(f"{root}/empty.jsonl", ["nothing"])
    step(1, 2, 3, 4, sums_of=(1, 2, 3, 4))
    step()
    write(f"{root}/b b.jsonl", [turn("k", 4, 7), turn("n", 4, 3), turn("k", 4, 2, 9), turn("k", 4, 8)])  # k moves from the first to the fourth
    step(4, sums_of=(1, 4))
    write(f"{root}/c.jsonl", [turn("m", 5, 4), turn("n", 6, 1)])  # ties go to the first file, which has m already
    step(5, 6, sums_of=(5, 6))
    os.remove(f"{root}/a.jsonl")
    step(1, 2, 3, sums_of=(1, 2, 3, 5))
    os.remove(f"{root}/b b.jsonl")
    step(4, sums_of=(4, 6))
    write(f"{root}/c.jsonl", [])
    step(5, 6, sums_of=(5, 6))
    assert days.load(spark, stage, logs.turn_records).count() == 0


def test_a_refresh_that_broke_off(spark, tmp_path, monkeypatch):
    """Rows that it had brought in go again, though the file no longer has their dates."""
    root, stage = f"{tmp_path}/logs", f"file:{tmp_path}/stage"
    write(f"{root}/a.jsonl", [turn("k", 1, 5)])
    write(f"{root}/b.jsonl", [turn("l", 2, 5)])
    days.refresh(spark, stage, [root], logs.turn_records)
    write(f"{root}/b.jsonl", [turn("l", 2, 5), turn("x", 9, 99)])
    days.refresh(spark, stage, [root], logs.turn_records)
    shutil.rmtree(f"{tmp_path}/stage/days-v1/manifest/2")
    write(f"{root}/b.jsonl", [turn("l", 3, 5)])
    assert days.refresh(spark, stage, [root], logs.turn_records) == ["2026-06-02", "2026-06-03", "2026-06-09"]
    assert sorted(r.date for r in days.load(spark, stage, logs.turn_records).collect()) == ["2026-06-01", "2026-06-03"]
    rollups.refresh(spark, stage)
    assert sorted(map(tuple, rollups.minutes(spark, stage).collect())) == from_scratch(spark, root)


@pytest.mark.parametrize("bounds", [("2026-06-02", "2026-06-03"), ("2026-06-03", None), (None, "2026-06-01")])
def test_readers_prune_dates(spark, tmp_path, bounds):
    root, stage = f"{tmp_path}/logs", f"file:{tmp_path}/stage"
    write(f"{root}/a.jsonl", [turn(f"k{d}", d, d) for d in range(1, 6)])
    days.refresh(spark, stage, [root], logs.turn_records)
    rows = days.load(spark, stage, logs.turn_records, *bounds)
    assert {r.date for r in rows.collect()} == {d for d in (f"2026-06-0{i}" for i in range(1, 6)) if (bounds[0] or "") <= d <= (bounds[1] or "9")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
