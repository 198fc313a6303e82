import json
import os
import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import counters, rollup
from tidemark.operators.dedup import keep_max
from tidemark.sources import logs
from tidemark.sources.growing import growing_lines
from tidemark.sources.lines import read_lines
from tidemark.streaming import dedup, deltas, rates, sessions
from tidemark.streaming.state import keyed_state

USAGE = "dedup_key string, output long, file_path string, line_no long"


def test_rates_over_files(spark, tmp_path):
    root = f"{tmp_path}/logs"
    os.makedirs(root)

    def turn(i, minute, n):
        return json.dumps({"timestamp": f"2026-06-03T01:{minute:02d}:00Z", "requestId": "r", "message": {"id": i, "usage": {"input_tokens": n, "output_tokens": 1}}})

    with open(f"{root}/a.jsonl", "w") as f:
        f.write("\n".join([turn("a", 1, 10), turn("b", 4, 5), turn("c", 7, 3)]))
    for name, make in (("tumbling", rates.tumbling), ("sliding", rates.sliding)):
        usage = logs.turn_records(rates.stream_lines(spark, root))
        query = make(usage).writeStream.format("memory").queryName(f"rates_{name}").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(120)
        rows = {r.start.minute: r.input for r in spark.table(f"rates_{name}").collect() if name == "tumbling"}
        if name == "tumbling":
            assert rows == {0: 15, 5: 3}
        else:
            assert spark.table("rates_sliding").agg(F.max("input")).first()[0] == 18


def test_changed_windows_of_each_tick(spark, few_partitions, tmp_path):
    """Update mode: a tick writes the windows that it changed; the last of each is the result, also when a batch comes twice."""
    root, out, schema = f"{tmp_path}/in", f"file://{tmp_path}/out", "epoch long, input long, output long, cache_creation long, cache_read long"
    for rows in ([(0, 1, 1, 1, 1), (400, 2, 0, 0, 0)], [(10, 5, 0, 0, 0)], [(900, 7, 0, 0, 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        stream = rates.tumbling(spark.readStream.schema(schema).parquet(root), late="1 hour")
        query = rates.refreshing(stream, rates.changes_sink(out), f"{tmp_path}/cp", mode="update", every="1 second")
        query.processAllAvailable()
        query.stop()
    every = spark.read.parquet(f"{out}/*")
    again = every.where("epoch_no = 1").drop("epoch_no")
    rates.changes_sink(out)(spark.createDataFrame(again.collect(), again.schema), 1)
    every = spark.read.parquet(f"{out}/*")
    assert every.where("input is not null").count() == 4
    assert sorted((r.start.minute, r.input) for r in rates.latest(every, ["start"]).collect()) == [(0, 6), (5, 2), (15, 7)]


def test_keep_max_sink(spark, tmp_path):
    folder = f"file://{tmp_path}/best"
    merge = dedup.keep_max_sink(folder)
    batches = [[("k", 5, "a", 1), (None, 7, "a", 2)], [("k", 9, "a", 3), ("j", 1, "a", 4)], [("k", 2, "a", 5)]]
    for epoch, rows in enumerate(batches):
        for _ in range(2 if epoch == 1 else 1):  # a batch that is repeated
            merge(spark.createDataFrame(rows, USAGE), epoch)
    assert dedup.best_rows(spark, f"{folder}-none") is None
    for dropped in (None, 1, 0):
        if dropped is not None:
            assert dedup.compact(spark, folder) == dropped
        best = dedup.best_rows(spark, folder)
        assert sorted(((r.dedup_key, r.output) for r in best.collect()), key=str) == [("j", 1), ("k", 9), (None, 7)]


def chained(rows):
    """(session, seq, model, input, cached, output) with each row due where its session's last one ended."""
    ends, out = {}, []
    for session, seq, *rest in rows:
        out.append((session, seq, ends.get(session, 0), seq + 1, *rest, seq))
        ends[session] = seq + 1
    return out


@pytest.fixture
def few_partitions(spark):
    """State stores and their Python workers are slow to start."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run_batches(spark, tmp_path, batches, schema, make):
    """The rows that ``make`` of a stream gives, batch by batch, with the number of rows in its state after each."""
    root, out, states = f"{tmp_path}/in", [], []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(root)
        got = []
        with keyed_state(spark):
            stream = make(spark.readStream.schema(schema).parquet(root))
            query = stream.writeStream.foreachBatch(lambda df, _, got=got: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            query.awaitTermination(180)
        out.append(got)
        states.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    return out, states


SESSIONS = chained([
    ("s", 1, None, 100, 40, 10), ("s", 2, "gpt-5.5", None, None, None), ("s", 3, None, 300, 140, 30), ("u", 1, None, 5, None, 1),
    ("s", 4, None, 50, 20, 5), ("s", 5, None, 80, 60, 9), ("s", 6, "gpt-6", 80, 60, None), ("s", 7, None, 90, 60, 10),
])
SESSION_DELTAS = [("s", 1, None, 60, 40, 10), ("s", 3, "gpt-5.5", 100, 100, 20), ("s", 4, "gpt-5.5", 0, 0, 0), ("s", 5, "gpt-5.5", 0, 40, 4), ("s", 7, "gpt-6", 10, 0, 1), ("u", 1, None, 5, 0, 1)]


def deltas_of(batches):
    return sorted(((r.session, r.seq, r.model, r.input, r.cache_read, r.output) for got in batches for r in got), key=str)


def test_session_rows_in_any_order_over_batches(spark, few_partitions, tmp_path):
    """Rows ahead of a gap wait; rows that come again, within a batch or later, count once."""
    s = SESSIONS
    batches = [[s[5], s[2]], [s[7], s[0], s[0], s[3]], [s[0], s[6]], [s[2], s[1], s[4]]]
    out, states = run_batches(spark, tmp_path, batches, sessions.EVENTS, sessions.counter_stream)
    assert [len(b) for b in out] == [0, 2, 0, 4]
    assert deltas_of(out) == SESSION_DELTAS
    assert states[2] > states[3]  # rows that waited are gone


def test_session_rows_shuffled_equal_the_window_form(spark, few_partitions, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{i % 7}", i, rng.choice([None, None, f"m{i}"]), *(rng.choice([(None, None, None), tuple(rng.randrange(1000) for _ in range(3))]))) for i in range(400)]
    events = chained(rows)
    batch = spark.createDataFrame(events, sessions.EVENTS)
    filled = counters.forward_fill(batch, "context_model", ["session"], ["seq"]).where("input is not null and output is not null")
    want = counters.normalised(counters.counter_delta(filled, ["input", "cached", "output"], ["session"], ["seq"]))
    mixed = rng.sample(events, len(events))
    out, _ = run_batches(spark, tmp_path, [mixed[i::3] for i in range(3)], sessions.EVENTS, sessions.counter_stream)
    assert deltas_of(out) == sorted(((r.session, r.seq, r.context_model, r.input, r.cache_read, r.output) for r in want.collect()), key=str)


def test_idle_sessions_expire(spark, few_partitions, tmp_path):
    """Rows that still wait are given out, and the state shrinks."""
    s = SESSIONS
    later = ("v", 1, 0, 2, None, 7, 0, 2, 500)
    out, states = run_batches(spark, tmp_path, [[s[0], s[2], s[4], s[3]], [later]], sessions.EVENTS, lambda events: sessions.counter_stream(events, idle=60))
    assert deltas_of(out[:1]) == [("s", 1, None, 60, 40, 10), ("u", 1, None, 5, 0, 1)]
    assert deltas_of(out[1:]) == sorted([("s", 3, None, 100, 100, 20), ("s", 4, None, 0, 0, 0), ("v", 1, None, 7, 0, 2)], key=str)
    assert states[1] < states[0]


def test_growing_counter_logs_equal_a_batch(spark, few_partitions, tmp_path):
    """Files that grow between runs give the records that a batch reads from them as they are in the end."""
    def count(n, **more):
        return {"type": "event_msg", "timestamp": "2026-06-03T01:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": n // 10}}}} | more

    context = {"type": "turn_context", "payload": {"model": "gpt-5.5"}}
    steps = [[count(100), {}, context], [count(300), count(50, timestamp="2026-06-03"), count(400, type="other")], [count(450), {"type": "turn_context", "payload": {}}, count(20)]]
    root, out = f"{tmp_path}/logs", f"{tmp_path}/out"
    for i, rows in enumerate(steps):
        for name in "ab" if i < 2 else "a":
            os.makedirs(root, exist_ok=True)
            with open(f"{root}/{name}.jsonl", "a") as f:
                f.write("".join(f"{json.dumps(r)}\n\n" if r else "not json input_tokens\n" for r in rows))
        with keyed_state(spark):
            stream = sessions.counter_stream(sessions.log_events(growing_lines(spark, [root])))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(180)
    got = sessions.records_of(spark.read.parquet(out), "t")
    want = logs.counter_records(read_lines(spark, [root]), "t")
    assert got.columns == want.columns
    plain = [c for c in want.columns if c not in ("block", "line_no")]
    assert sorted(map(tuple, got.select(plain).collect()), key=str) == sorted(map(tuple, want.select(plain).collect()), key=str)
    assert got.count() == 6


def test_signed_minutes_after_every_batch(spark, few_partitions, tmp_path):
    """Sums equal those of a batch over all rows so far: growing and repeated turns, a larger duplicate on an older day, ties, rows without a key."""
    day = 86_400
    batches = [
        [("k", "f", 1, 2 * day, "m", 1, 5, 0, 0), ("k", "f", 2, 2 * day, "m", 2, 7, 0, 0), (None, "f", 3, 2 * day, "m", 3, 1, 0, 0), ("j", "g", 1, 60, None, 4, 4, 1, 1)],
        [("k", "f", 9, 60, "n", 9, 9, 9, 9), ("j", "f", 8, 60, None, 5, 4, 0, 0), (None, "f", 4, 2 * day, "m", 3, 1, 0, 0)],
        [("k", "f", 1, 2 * day, "m", 1, 5, 0, 0), ("l", None, 1, 3 * day, "m", 1, 0, 0, 0)],
    ]
    schema = f"dedup_key string, {deltas.ROW}"
    folder = f"file://{tmp_path}/sums"
    add = deltas.minutes_sink(folder)
    assert deltas.minutes(spark, folder) is None
    out, _ = run_batches(spark, tmp_path, batches, schema, deltas.signed_best)
    assert [len(b) for b in out] == [3, 5, 1]
    seen = []
    for i, (rows, signed) in enumerate(zip(batches, out, strict=True)):
        seen += rows
        for _ in range(2 if i == 1 else 1):  # a batch that is repeated
            add(spark.createDataFrame(signed, deltas.SIGNED), i)
        best = rollup.with_local_time(keep_max(spark.createDataFrame(seen, schema)))
        want = rollup.minute_matrix(best).collect()
        for dropped in (None, *([1, 0] if i else [0])):
            if dropped is not None:
                assert deltas.compact(spark, folder) == dropped
            got = deltas.minutes(spark, folder).drop("records").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_keys_of_a_group_are_ranked_at_once():
    """A group's rows come in pieces, and its state has a row for each key; of equal outputs nulls come first, in a batch as over batches."""
    class Map(dict):
        getValue = dict.get
        updateValue = dict.__setitem__

    def row(key, output, file, line):
        return {"dedup_key": key, "file_path": file, "line_no": line, "epoch": 2**60 + 1, "model": None, "input": 1, "output": output, "cache_creation": 0, "cache_read": 0, "_group": 5}

    best = deltas.BestRows()
    best.best = Map()

    def batch(*pieces):
        frames = list(best.handleInputRows((5,), iter([pd.DataFrame(p) for p in pieces]), None))
        return sorted((r.dedup_key, r.output, r.file_path or "-", r.line_no if r.line_no is not None else -1, r.sign, r.epoch) for f in frames for r in f.itertuples())

    e = 2**60 + 1
    assert batch([row("k", 5, "f", 2), row("j", 1, "f", 1)], [row("k", 5, None, 3), row("k", 4, "a", 1)]) == [("j", 1, "f", 1, 1, e), ("k", 5, "-", 3, 1, e)]
    assert batch([row("k", 5, "f", 1), row("j", 1, "f", None)]) == [("j", 1, "f", -1, 1, e), ("j", 1, "f", 1, -1, e)]
    assert batch([row("k", 5, None, 3)]) == []


def test_session_counters_keep_whole_numbers():
    """Large counters beside nulls, rows that wait in the state included."""
    class State:
        def __init__(self, value=None):
            self.value = value

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    big = 2**60 + 1
    counters = sessions.SessionCounters()
    counters.seen, counters.ahead = State(), State()

    def batch(*rows):
        frames = list(counters.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=sessions.COLUMNS, dtype=object)]), None))
        return [(int(r.seq), r.model, int(r.input), int(r.output), int(r.cache_read)) for f in frames for r in f.itertuples()]

    assert batch((2, 2, 3, None, big, 0, big, None), (1, 1, 2, "m", None, None, None, 7)) == []
    assert [r[0] for r in counters.ahead.value] == [1, 2] and counters.ahead.value[1][4] == big
    assert batch((0, 0, 1, None, 5, 2, 1, 3), (0, 0, 1, None, 5, 2, 1, 3)) == [(0, None, 3, 1, 2), (2, "m", big - 5, big - 1, 0)]
    assert counters.seen.value == (3, "m", big, 0, big) and not counters.ahead.exists()
