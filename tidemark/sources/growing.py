"""Growing log files as a stream: appended lines are read once, from where the last batch ended.

Spark's own file stream reads a path once. This source's offset says how many
bytes of each file were read, always up to the end of a line, so a stream that
starts again from its checkpoint goes on there and repeats nothing. The driver
lists files and looks for the last line end of those that changed; executors read
the new ranges, large ones in pieces, small ones together.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "file_path string, line_no long, next_no long, value string"
#: Bytes of a file that one task reads.
PIECE = 64 << 20
CHUNK = 1 << 20
TAIL = 4 << 10  # bytes that are looked at first for a line end
OPENING = 256 << 10  # bytes that opening a file counts as
LOOKING = 16  # threads that look for line ends
SAFE = "/=:,@&+$!*'();~-._"  # signs of a path that aren't escaped in its name


def opened(root: str):
    """The file system of a root and the path within it."""
    from pyarrow import fs

    if root.startswith("file:/") and not root.startswith("file://"):  # Hadoop's way to write it
        root = root.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def uri(root: str, path: str) -> str:
    """A file's name as Spark's own sources give it."""
    scheme = root.split(":/")[0] if ":/" in root else "file"
    return f"{scheme}:{'' if scheme == 'file' else '//'}{quote(path, safe=SAFE)}"


def last_line_end(files, path: str, size: int, least: int) -> int:
    """The offset after the last line end before ``size``; ``least`` if there is none after it. Reads backwards in growing chunks."""
    with files.open_input_file(path) as f:
        end, chunk = size, TAIL
        while end > least:
            start, chunk = max(least, end - min(chunk, CHUNK)), 2 * chunk
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return least


class Piece(InputPartition):
    """Lines of a file that begin in [start, end), of a range up to ``whole``, which is a line end; at_line tells that one begins at start."""

    def __init__(self, root: str, path: str, start: int, end: int, whole: int, at_line: bool):
        self.root, self.path, self.start, self.end, self.whole, self.at_line = root, path, start, end, whole, at_line


class Pieces(InputPartition):
    """Pieces of several files that one task reads."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def together(pieces: list[Piece], share: int) -> list[InputPartition]:
    """Pieces in their order, as many to a task as make up ``share`` bytes; one that is alone stays as it is."""
    bins: list[list[Piece]] = []
    room = 0
    for piece in pieces:
        cost = piece.end - piece.start + OPENING
        if cost > room:
            bins.append([])
            room = share
        bins[-1].append(piece)
        room -= cost
    return [b[0] if len(b) == 1 else Pieces(b) for b in bins]


def lines_from(stream, start: int, end: int, whole: int, at_line: bool) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset of the next line, line) of lines that begin in [start, end); a piece in a file's middle begins after its first line end.

    A line that lies across pieces belongs to the one it begins in.
    """
    at = start if at_line else start - 1  # the byte before tells whether a line begins here
    stream.seek(at)
    held, skipping = b"", not at_line
    while at < end or held:
        chunk = stream.read(min(CHUNK, whole - at - len(held)))
        if not chunk:
            return
        held, begin = held + chunk, 0
        while (cut := held.find(b"\n", begin)) >= 0:
            line, begin, first = held[begin:cut], cut + 1, at
            at += len(line) + 1
            if not skipping:
                yield first, at, line
            skipping = False
            if at >= end:
                return
        held = held[begin:]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, roots: list[str], pattern: str, piece: int, tasks: int = 1):
        self.roots, self.pattern, self.piece, self.tasks = roots, pattern, piece, tasks
        self.seen: dict[str, tuple[int, int, int]] = {}  # of files that were looked at: size, mtime, last line end

    def initialOffset(self) -> dict:
        return {}

    def listed(self) -> Iterator[tuple[str, object, object]]:
        from pyarrow import fs

        for root in self.roots:
            files, base = opened(root)
            for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
                if info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, self.pattern) and not info.base_name.startswith(("_", ".")):
                    yield root, files, info

    def latestOffset(self) -> dict:
        """Bytes of whole lines of each file, by root and path."""

        def looked(item) -> tuple[str, int]:
            root, files, info = item
            key = json.dumps([root, info.path])
            old = self.seen.get(key)
            mark = (info.size, info.mtime_ns or 0)
            if old is None or old[:2] != mark:
                least = old[2] if old and old[0] <= info.size else 0
                self.seen[key] = (*mark, last_line_end(files, info.path, info.size, least))
            return key, self.seen[key][2]

        with ThreadPoolExecutor(LOOKING) as pool:
            ends = dict(pool.map(looked, self.listed()))
        self.seen = {k: v for k, v in self.seen.items() if k in ends}
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """At least ``tasks``, where there is as much to read, of no more than ``piece`` bytes each: their number follows bytes, not files alone."""
        out: list[Piece] = []
        for key, whole in end.items():
            root, path = json.loads(key)
            first = start.get(key, 0)
            if first > whole:  # the file was written anew, shorter
                first = 0
            out += [Piece(root, path, at, min(at + self.piece, whole), whole, at == first) for at in range(first, whole, self.piece)]
        total = sum(p.end - p.start + OPENING for p in out)
        return together(out, min(self.piece, -(-total // self.tasks)))

    def read(self, partition: InputPartition):
        import pyarrow as pa

        systems: dict[str, object] = {}
        rows: list[tuple[str, int, int, str]] = []
        held = 0

        def batch():
            names, at, after, values = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(at, pa.int64()), pa.array(after, pa.int64()), pa.array(values)], ["file_path", "line_no", "next_no", "value"])

        for piece in partition.pieces if isinstance(partition, Pieces) else [partition]:
            if piece.root not in systems:
                systems[piece.root] = opened(piece.root)[0]
            name = uri(piece.root, piece.path)
            with systems[piece.root].open_input_file(piece.path) as stream:
                for at, after, line in lines_from(stream, piece.start, piece.end, piece.whole, piece.at_line):
                    rows.append((name, at, after, line.decode("utf-8", "replace")))
                    held += len(line)
                    if len(rows) >= 10_000 or held >= 8 * CHUNK:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class GrowingLines(DataSource):
    """Options: roots (a JSON list), pattern, piece (bytes of a task), tasks (how many there should be at least)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(json.loads(self.options["roots"]), self.options.get("pattern", "*.jsonl"), int(self.options.get("piece", PIECE)), int(self.options.get("tasks", 1)))


def growing_lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl", piece: int = PIECE) -> DataFrame:
    """(file_path, block, line_no, next_no, value) of all lines of matching files below the roots, as a stream.

    line_no is the line's byte offset, next_no that of the next line, so a file's
    rows form a chain, whatever order they come in; empty lines are rows too, and
    parsers of logs pass over them. A last line without an end waits until it has
    one. A file that became shorter counts as new; one that was replaced by a longer
    one can't be told from one that grew. Roots and files may come and go. The
    checkpoint has one number for each file. File systems are those that pyarrow
    opens; names that begin with _ or a dot are passed over.
    """
    spark.dataSource.register(GrowingLines)
    distinct = list(dict.fromkeys(r.rstrip("/") for r in roots))
    rows = spark.readStream.format(NAME).option("roots", json.dumps(distinct)).option("pattern", pattern).option("piece", piece).option("tasks", 2 * spark.sparkContext.defaultParallelism).load()
    return rows.select("file_path", F.lit(0).cast("long").alias("block"), "line_no", "next_no", "value")
