import io
import os

import pytest

from tidemark.plans import round_trips
from tidemark.sources import logs
from tidemark.sources.growing import OPENING, GrowingReader, growing_lines, last_line_end, lines_from, opened
from tidemark.sources.lines import read_lines


def plain(data, start=0):
    out, at = [], start
    for line in data[start:].split(b"\n")[:-1]:
        out.append((at, at + len(line) + 1, line))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("piece", [1, 3, 7, 50, 10_000])
def test_pieces_of_a_range_give_each_line_once(piece):
    data = b"one\n\n\ntwo three\n" + b"x" * 40 + b"\nlast\n"
    for start in (0, 4, 6):
        got = []
        for at in range(start, len(data), piece):
            got += lines_from(io.BytesIO(data), at, min(at + piece, len(data)), len(data), at == start)
        assert got == plain(data, start)


def test_line_ends_and_offsets(tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.growing.CHUNK", 4)
    path = f"{tmp_path}/a.jsonl"
    with open(path, "wb") as f:
        f.write(b"abc\n" + b"y" * 30)
    files, _ = opened(str(tmp_path))
    assert last_line_end(files, path, 34, 0) == 4 and last_line_end(files, path, 34, 4) == 4 and last_line_end(files, path, 3, 0) == 0
    reader = GrowingReader([f"file:{tmp_path}", f"{tmp_path}/absent"], "*.jsonl", 10)
    assert list(reader.latestOffset().values()) == [4]
    with open(path, "ab") as f:
        f.write(b"\nz\n")
    [(key, end)] = reader.latestOffset().items()
    assert end == 37 and [(p.start, p.end, p.at_line) for p in reader.partitions({key: 4}, {key: end})] == [(4, 14, True), (14, 24, False), (24, 34, False), (34, 37, False)]
    assert reader.partitions({key: end}, {key: end}) == []
    assert [(p.start, p.end) for p in reader.partitions({key: 99}, {key: 5})] == [(0, 5)]  # shorter than before
    os.remove(path)
    assert reader.latestOffset() == {}


def append(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write(text)


def test_appended_lines_come_once(spark, tmp_path):
    """Growing, new and vanishing files, half lines, odd names and bytes; each run goes on from the checkpoint."""
    root, out = f"{tmp_path}/logs", f"{tmp_path}/out"

    def run():
        stream = growing_lines(spark, [root, f"{root}/", f"{tmp_path}/none"], piece=64)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.parquet(out)

    append(f"{root}/a/one two.jsonl", "first\n\nsecond, which is longer than a piece of a file is allowed to be here\nhal")
    append(f"{root}/b.jsonl", "é\n")
    append(f"{root}/b.txt", "other\n")
    append(f"{root}/_c.jsonl", "hidden\n")
    assert run().count() == 4
    assert run().count() == 4
    append(f"{root}/a/one two.jsonl", "f\r\nthird\n")
    append(f"{root}/d.jsonl", "new\n")
    os.remove(f"{root}/b.jsonl")
    rows = run()
    got = sorted((r.file_path.rsplit("/", 1)[1], r.value) for r in rows.collect())
    assert got == sorted([("one%20two.jsonl", x) for x in ("first", "", "second, which is longer than a piece of a file is allowed to be here", "half\r", "third")] + [("b.jsonl", "é"), ("d.jsonl", "new")])
    whole = {(r.file_path, r.value) for r in read_lines(spark, [root]).collect()}
    assert whole == {(r.file_path, r.value) for r in rows.where("value <> '' and file_path not like '%b.jsonl'").collect()}
    chain = sorted((r.line_no, r.next_no) for r in rows.where("file_path like '%one%'").collect())
    assert chain[0][0] == 0 and all(a[1] == b[0] for a, b in zip(chain, chain[1:], strict=False))
    assert logs.turn_records(rows).count() == 0


@pytest.mark.parametrize("tasks", [1, 4])
def test_small_files_share_tasks(tmp_path, tasks):
    """Tasks follow bytes, not files, and each line comes once with its file's name."""
    for i in range(300):
        append(f"{tmp_path}/{i}.jsonl", f"{i}\nx{i}\nhalf")
    reader = GrowingReader([str(tmp_path)], "*.jsonl", 64 << 20, tasks)
    parts = reader.partitions({}, reader.latestOffset())
    assert tasks <= len(parts) <= 2 * max(tasks, 300 * OPENING // (64 << 20) + 1)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = [(f"file:{tmp_path}/{i}.jsonl", at, v) for i in range(300) for at, v in ((0, f"{i}"), (len(f"{i}\n"), f"x{i}"))]
    assert sorted((r["file_path"], r["line_no"], r["value"]) for r in rows) == sorted(want)


def test_sessions_grow_by_steps_of_their_lines(spark, tmp_path):
    """Files of many sessions are written by executors: each begins like its predecessor, and no other file stays."""
    lines = spark.range(1000).selectExpr("id % 70 as session", "id as event_id", "concat('é', id) as value", "cast(id div 400 + 1 as int) as step")
    for step in (1, 2, 3):
        round_trips.grown(lines, f"file:{tmp_path}/home", step)
        files = {f"session={s}.jsonl": "".join(f"é{i}\n" for i in range(s, min(1000, 400 * step), 70)) for s in range(70)}
        assert {f: open(f"{tmp_path}/home/{f}", encoding="utf-8", newline="").read() for f in os.listdir(f"{tmp_path}/home")} == files
