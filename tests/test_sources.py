import json
import os
import shutil

import pytest

from tidemark.functions.timeutil import Now
from tidemark.operators import pricing, rollup
from tidemark.sources import PROVIDERS, logs, prices, read_usage, reports, stage
from tidemark.sources.lines import read_lines, scan_totals


def turn(i="m1", r="r1", ts="2026-06-03T01:02:03Z", model="claude-opus-4-8", extra=None, **usage):
    body = {"timestamp": ts, "message": {"id": i, "model": model, "usage": {"input_tokens": 10, "output_tokens": 5} | usage}, "other": [1]}
    return json.dumps(body | ({"requestId": r} if r else {}) | (extra or {}))


def count(total=None, ts="2026-06-03T01:00:00Z", kind="token_count", info=True):
    usage = dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), total, strict=False)) if total else None
    return json.dumps({"type": "event_msg", "timestamp": ts, "payload": {"type": kind, "info": {"total_token_usage": usage} if info else None}})


def context(model=None):
    return json.dumps({"type": "turn_context", "timestamp": "2026-06-03T01:00:00Z", "payload": {"model": model} if model else {}})


def write(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write("\n".join(lines) + end)


def test_turn_logs(spark, tmp_path):
    base = f"{tmp_path}/a"
    write(f"{base}/projects/p/x.jsonl", [turn(output_tokens=5, cache_creation_input_tokens=100, cache_read_input_tokens=1000), turn(output_tokens=42), turn(r=None, output_tokens=7), turn(r=None, output_tokens=7)])
    write(f"{base}/projects/p/z/r/y.jsonl", [turn(output_tokens=42, ts="2026-06-04T01:02:03Z"), turn("m2", model="claude-opus-4-7", speed="fast"), turn("m3", model="<synthetic>"), ""], end="")
    bad = [json.dumps({"type": "user"}), "", '{"timestamp": "2026-06-03T01:02:03Z", "message": {"usage": {"input_tok', turn("b1", input_tokens="1"), turn("b2", output_tokens=None), turn("b3", ts="2026-06-03"), turn("b4", ts="2026-06-03T01:02:03"), turn("b5", ts="T10:00:00Z"), turn("b6", input_tokens=1.5)]
    write(f"{base}/projects/z.jsonl", [*bad, turn("m4", ts="2026-06-03T01:02:03.456Z"), turn("m5", ts="2026-06-03T01:02:03+02:00", extra={"pad": "y" * 200_000})], end="")
    write(f"{base}/projects/no.txt", [turn("t")])
    rows = logs.turns(spark, [base, base, f"{tmp_path}/absent"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.dedup_key, []).append(r)
    assert set(by) == {"m1:r1", None, "m2:r1", "m3:r1", "m4:r1", "m5:r1"}
    assert len(by[None]) == 2
    (m1,) = by["m1:r1"]
    assert m1.output == 42 and m1.cache_creation == 0 and m1.epoch == 1780448523
    assert by["m2:r1"][0].model == "claude-opus-4-7-fast"
    assert by["m4:r1"][0].epoch == 1780448523 and by["m5:r1"][0].epoch == 1780441323


SESSION = [count((100, 40, 10)), context("gpt-5.5"), count((300, 140, 30)), count((300, 140, 30)), context(), count((50, 20, 5)), count((80, 60, 9), ts="2026-06-04T01:00:00Z"), count(info=False), count((9, 9, 9), kind="other"), count((999, 9))]


@pytest.mark.parametrize("split", ["128m", "150"])
def test_counter_logs(spark, tmp_path, split):
    for name in "ab":
        write(f"{tmp_path}/sessions/2026/rollout-{name}.jsonl", SESSION)
    write(f"{tmp_path}/sessions/other.jsonl", SESSION)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = logs.counters(spark, [str(tmp_path)], tenant="t").orderBy("file_path", "block", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(60, 40, 10, None), (100, 100, 20, "gpt-5.5"), (0, 0, 0, "gpt-5.5"), (0, 0, 0, "gpt-5.5"), (0, 40, 4, "gpt-5.5")]
    assert [(r.input, r.cache_read, r.output, r.model) for r in rows] == want * 2
    assert {r.tenant for r in rows} == {"t"}


def test_all_providers_to_a_report(spark, tmp_path):
    write(f"{tmp_path}/c/projects/x.jsonl", [turn(input_tokens=1000, output_tokens=100)])
    write(f"{tmp_path}/g/sessions/rollout-1.jsonl", SESSION)
    usage = rollup.with_local_time(read_usage(spark, {"claude-native": [f"{tmp_path}/c"], "codex": [f"{tmp_path}/g"]}))
    days = rollup.daily(pricing.priced(usage, pricing.bundled(spark)), ["provider"])
    merged = rollup.merge_daily(days)
    reports.write_tsv(reports.daily_report(merged), f"file://{tmp_path}/out", ["day"])
    text = "".join(open(f"{tmp_path}/out/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/out")) if f.startswith("part"))
    first = text.splitlines()[0].split("\t")
    assert first[:6] == ["2026-06-03", "1160", "130", "0", "140", "1430"] and len(text.splitlines()) == 2
    assert set(PROVIDERS) == {"claude-native", "codex"}


def test_lines(spark, tmp_path):
    write(f"{tmp_path}/r/a.jsonl", ["one", "", "two\rstill two", "x" * 100_000], end="")
    lines = read_lines(spark, [f"{tmp_path}/r"])
    assert [r.value for r in lines.orderBy("block", "line_no").collect()] == ["one", "two\rstill two", "x" * 100_000]
    totals = scan_totals(lines).first()
    assert totals.lines == 3 and totals.bytes == 3 + 13 + 100_000
    assert read_lines(spark, [f"{tmp_path}/none"]).count() == 0


def test_price_documents(spark):
    flat = {"a": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "b": {"input_cost_per_token": "1"}, "c": 5, "d": {"output_cost_per_token": 1}, "e": {"input_cost_per_token": 0.0}}
    docs = spark.createDataFrame([(json.dumps(flat),)], "doc string")
    rows = {r.model: r for r in prices.flat_prices(docs).collect()}
    assert set(rows) == {"a", "e"} and rows["a"].output == 2e-6 and rows["a"].cache_read == 0.0
    nested = {"anthropic": {"models": {"x": {"cost": {"input": 5, "output": 25, "cache_read": 0.5, "cache_write": 6.25}}, "y": {"cost": {"output": 1}}, "z": {}}}, "openai": {"models": {"g": {"cost": {"input": 1.25}}}}, "openrouter": {"models": {"o": {"cost": {"input": 1}}}}}
    rows = {r.model: r for r in prices.nested_prices(spark.createDataFrame([(json.dumps(nested),)], "doc string")).collect()}
    assert set(rows) == {"x", "g"}
    assert tuple(rows["x"])[1:] == (5 / 1e6, 25 / 1e6, 6.25 / 1e6, 0.5 / 1e6) and rows["g"].output == 0.0


def test_incremental_stage(spark, tmp_path):
    root, home = f"{tmp_path}/logs", f"{tmp_path}/stage"
    for n in "ab":
        write(f"{root}/{n}.jsonl", [turn(n)])

    def run():
        counts = {r.state: r.files for r in stage.refresh(spark, home, [root], logs.turn_records).collect()}
        return counts, sorted(r.dedup_key for r in stage.load(spark, home).collect())

    assert run() == ({"new": 2}, ["a:r1", "b:r1"])
    assert run() == ({"unchanged": 2}, ["a:r1", "b:r1"])
    write(f"{root}/b.jsonl", [turn("b"), turn("c")])
    assert run() == ({"unchanged": 1, "changed": 1}, ["a:r1", "b:r1", "c:r1"])
    os.remove(f"{root}/a.jsonl")
    assert run() == ({"unchanged": 1, "removed": 1}, ["b:r1", "c:r1"])
    shutil.rmtree(root)
    assert run()[1] == []


def test_incremental_stage_with_odd_names_and_compaction(spark, tmp_path):
    root, home = f"{tmp_path}/my proj [1]", f"{tmp_path}/a stage"
    stage.refresh(spark, home, [root], logs.turn_records)
    empty = stage.load(spark, home)
    assert empty.count() == 0 and {"file_path", "dedup_key", "output"} <= set(empty.columns)
    names = ["a b/x y", "100%/z", "c[d]/{e}", "f*g/ü+h", "plain/q?"]
    for i, n in enumerate(names):
        write(f"{root}/{n}.jsonl", [turn(f"t{i}")])

    def run():
        counts = {r.state: r.files for r in stage.refresh(spark, home, [root], logs.turn_records).collect()}
        return counts, sorted(r.dedup_key for r in stage.load(spark, home).collect())

    every = [f"t{i}:r1" for i in range(5)]
    assert run() == ({"new": 5}, every)
    write(f"{root}/{names[2]}.jsonl", [turn("t2"), turn("t9")])
    assert run() == ({"unchanged": 4, "changed": 1}, [*every, "t9:r1"])
    os.remove(f"{root}/{names[0]}.jsonl")
    assert run() == ({"unchanged": 4, "removed": 1}, [*every[1:], "t9:r1"])
    assert stage.compact(spark, home) == 3
    assert sorted(os.listdir(f"{home}/v1/records")) == sorted(os.listdir(f"{home}/v1/manifest")) and len(os.listdir(f"{home}/v1/records")) == 1
    assert sorted(r.dedup_key for r in stage.load(spark, home).collect()) == [*every[1:], "t9:r1"]
    assert run() == ({"unchanged": 4}, [*every[1:], "t9:r1"])
    assert stage.compact(spark, f"{tmp_path}/none") == 0 and stage.load(spark, f"{tmp_path}/none").columns == ["file_path"]


def test_now():
    from datetime import UTC, datetime

    assert Now.at(datetime(2026, 6, 7, 16, 30, tzinfo=UTC), "Asia/Singapore") == Now("2026-06-08", 30)
    assert Now.at(datetime(2026, 6, 7, 16, 30)).month == "2026-06"


def test_every_line_is_accounted_for(spark, tmp_path):
    """Fates, bytes and the dropped lines themselves; records as without the account; one reading of the files."""
    lines = [turn(), turn("m2"), "{" + turn()[1:-1], turn("b1", input_tokens="1"), turn("b2", output_tokens=None), turn("b3", ts="2026-06-03"), json.dumps({"type": "x"}), "input_tokens", '{"input_tokens": 1}', '[1, "input_tokens"]', "é"]
    write(f"{tmp_path}/logs/a.jsonl", lines)
    read = read_lines(spark, [f"{tmp_path}/logs"])
    found = logs.judged_turns(read)
    assert found.metrics == {"lines": 11, "bytes": sum(len(x.encode()) for x in lines), "record": 2, "other": 2, "not json": 2, "wrong type": 2, "no usage": 2, "no instant": 1}
    reasons = {r.value: r.reason for r in found.dropped.collect()}
    assert reasons == {lines[2]: "not json", lines[7]: "not json", lines[3]: "wrong type", lines[9]: "wrong type", lines[4]: "no usage", lines[8]: "no usage", lines[5]: "no instant"}
    assert sorted(map(tuple, found.records.collect()), key=str) == sorted(map(tuple, logs.turn_records(read).select(*logs.RECORD).collect()), key=str)
    none = logs.judged_turns(read_lines(spark, [f"{tmp_path}/absent"]))
    assert none.records.count() == none.dropped.count() == 0


def test_each_line_is_parsed_once(spark):
    lines = spark.range(9).selectExpr("'f' as file_path", "0L as block", "id as line_no", "concat('input_tokens', id) as value")
    for records, scans in ((logs.turn_records(lines), 1), (logs.counter_records(lines), None)):
        plan = records._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == (scans or plan.count("Range (0, 9")) > 0
