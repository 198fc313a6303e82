"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces of at most the largest length. Pieces are dealt by hash,
sorted longest first and packed in blocks of BLOCK pieces. A piece goes to the
open bin with the least room that holds it; if there is none, a bin is opened.
Which length to open is decided jointly, bin by bin: each permitted length is filled
in thought with the largest of the pieces still to come that fit, downsized to that,
and the length with the least cost per unit of content is opened. A block so has bins
of several lengths. It is also packed with each one length throughout (a larger one
where a piece needs it), every bin is downsized to the least length that holds its
contents, and the packing with the least total cost stays. A length's cost is its
room plus OVERHEAD, what a sequence costs whatever it holds.

A block's size doesn't depend on the data's, so more data means more blocks; each
leaves a few part-filled bins, well under one in a hundred.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

LENGTHS = (1024, 2048, 4096, 8192, 16384)  # permitted, in code points
OVERHEAD = 64
BLOCK = 16384  # pieces that are packed together
AHEAD = 64  # pieces that a length is filled with in thought, at most

PACKED = "doc_id long, piece int, start long, length long, bin string, bin_length long, bin_offset long"


def cost(length: int, overhead: int = OVERHEAD) -> int:
    return length + overhead


def outlook(sizes: list[int], at: int, length: int, lengths: list[int], overhead: int) -> float:
    """Cost per unit of content of a bin opened with piece ``at``, were it filled with later pieces; sizes are negative and ascend."""
    room, held = length + sizes[at], -sizes[at]
    for _ in range(AHEAD):
        at = bisect.bisect_left(sizes, -room, at + 1)  # the largest later piece that fits
        if at == len(sizes) or not sizes[at]:
            break
        room, held = room + sizes[at], held - sizes[at]
    return cost(lengths[bisect.bisect_left(lengths, held)], overhead) / max(1, held)


def opening(policy: int | None, sizes: list[int], at: int, lengths: list[int], overhead: int) -> int:
    """The length to open for piece ``at``: the policy's or the next that holds it; without one that with the best outlook, of equals the longest."""
    able = lengths[bisect.bisect_left(lengths, max(policy or 0, -sizes[at])) :]
    return able[0] if policy is not None else min(able, key=lambda n: (outlook(sizes, at, n, lengths, overhead), -n))


def best_fit(pieces: list[int], lengths: list[int], policy: int | None, overhead: int) -> tuple[list[int], list[int]]:
    """The bin of each piece (given longest first) and the length each bin is opened with."""
    rooms: list[int] = []  # rooms of open bins, sorted, without repeats
    bins_by_room: dict[int, list[int]] = {}
    sizes = [-p for p in pieces]
    opened, where = [], []
    for number, piece in enumerate(pieces):
        at = bisect.bisect_left(rooms, piece)
        if at < len(rooms):
            room = rooms[at]
            bin_ = bins_by_room[room].pop()
            if not bins_by_room[room]:
                del bins_by_room[room], rooms[at]
        else:
            bin_ = len(opened)
            room = opening(policy, sizes, number, lengths, overhead)
            opened.append(room)
        where.append(bin_)
        left = room - piece
        if left > 0:
            if left not in bins_by_room:
                bins_by_room[left] = []
                bisect.insort(rooms, left)
            bins_by_room[left].append(bin_)
    return where, opened


def pack_block(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece (given longest first) and each bin's final length."""
    lengths, best = sorted(lengths), None
    for policy in (None, *reversed(lengths)):
        where, opened = best_fit(pieces, lengths, policy, overhead)
        filled = np.bincount(where, pieces, len(opened)).astype(np.int64) if pieces else np.zeros(0, np.int64)
        final = np.array(lengths)[np.searchsorted(lengths, filled)] if pieces else filled
        total = int(final.sum()) + overhead * len(final)
        if best is None or total < best[0]:
            best = total, np.array(where, np.int64), final
    return best[1], best[2]


def pieces_of(docs: DataFrame, length: Column, largest: int) -> DataFrame:
    """(salt, doc_id, piece, start, length), salt a hash of the whole row: documents of length 0 or null have one empty piece, long ones several."""
    n = F.coalesce(length.cast("long"), F.lit(0).cast("long"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(n / largest) - 1)
    salt = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    cut = docs.select("doc_id", n.alias("_n"), salt.alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_i"))
    return cut.select("salt", "doc_id", F.col("_i").cast("int").alias("piece"), (F.col("_i") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("_n") - F.col("_i") * largest).alias("length"))


def pack(docs: DataFrame, length: Column | None = None, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, block: int = BLOCK) -> DataFrame:
    """A row for each piece of each row of ``docs``: its document, place in it, bin, the bin's length and the offset there.

    ``length`` is a document's length, code points of ``text`` by default. Pieces
    of one document follow each other in ``start`` and cover it. Documents of no
    length keep a row with an empty piece. Rows that repeat a doc_id are packed
    each; an empty table gives no rows; other columns are ignored. Ties of length go
    by doc_id and piece. Only ids and lengths are shuffled.
    """
    length = F.length("text") if length is None else length
    pieces = pieces_of(docs, length, max(lengths))
    dealt = pieces.repartition(F.xxhash64("doc_id", "piece", "salt"))  # rows that share an id, or have none, differ in the rest
    spread = dealt.sortWithinPartitions(F.xxhash64("doc_id", "piece"), "length", "doc_id", "piece").drop("salt")

    def run(batches):
        from pyspark import TaskContext

        held, rows, number = [], 0, 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            while rows >= block:
                every = pd.concat(held)
                held, rows = [every.iloc[block:]], rows - block
                yield packed(every.iloc[:block], number, TaskContext.get().partitionId())
                number += 1
        if rows:
            yield packed(pd.concat(held), number, TaskContext.get().partitionId())

    def packed(part, number, task):
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        where, final = pack_block(part["length"].tolist(), lengths, overhead)
        order = np.argsort(where, kind="stable")
        sizes = part["length"].to_numpy()[order]
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.diff(where[order], prepend=-1))
        offset = np.empty(len(part), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(part))))
        return part.assign(bin=[f"{task}-{number}-{b}" for b in where], bin_length=final[where], bin_offset=offset)

    return spread.mapInPandas(run, PACKED)


def op2_packing(spark, sf_dir):
    """Every document's pieces in bins of the permitted lengths."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
