"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector less a common centre is divided by its length, rotated at random and
reduced to the signs of its components, d bits. With o the rotated unit residual,
s its signs / sqrt(d) and q a rotated query residual, <s, q> / <s, o> estimates
<o, q> without bias, and misses by no more than

    |q| sqrt((1 - <s, o>^2) / <s, o>^2) * BOUND / sqrt(d - 1)

but with a probability that falls as exp(-BOUND^2 / 2). Packed signs, <s, o>, the
residual's length and its product with the centre are the index row of a vector.
A query's components are rounded to PLANES bits, and <s, q> comes from the bits that
the code has in common with each of the planes; what the rounding can add to the
error is added to the bound.

A query meets the rows in cells. In a cell the best estimates are scored exactly;
the k-th of those scores is a threshold, and all rows whose estimate plus bound
reaches it are scored exactly too. Cells' best are merged by a window.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged, table

NEAREST = 5
BOUND = 2.5
SEED = 20240607
SAMPLE = 4096  # vectors that the centre is the mean of, at most
CELL_ROWS = 65536  # vectors that a task holds at once, at most about
LEAST_CELLS, LEAST_ROWS = 24, 1024  # cells for small inputs, and rows that make another cell worthwhile
FIRST = 32  # best estimates that are scored to find a threshold
PLANES = 8  # bits that a query's components are rounded to


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, zeros added."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def codes(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, residual lengths, <s, o> and <unit vector, centre> of each row."""
    own = units(vectors)
    rest = own - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ turn / np.where(length > 0, length, 1)[:, None]
    match = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return words_of(turned >= 0), length, np.where(length > 0, match, 1.0), own @ centre


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows that can take part, exact repeats once.

    Without a part are null vectors, ids or components, components that aren't
    finite, zero vectors, and vectors of another length than most have (of equally
    frequent lengths the longest counts). Floats stay floats; other numbers count
    as doubles.
    """
    v = F.col("vector")
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    cast = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = cast.where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    sizes = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    return good.where(F.size("vector") == d).distinct()


class Index(NamedTuple):
    rows: DataFrame
    centre: np.ndarray


def build_index(vectors: DataFrame, copies: int, seed: int = SEED) -> Index:
    """The index of ``vectors(vec_id, vector)``, all of one length: a row for each, and the centre.

    Of exact copies of a vector the ``copies`` smallest ids are kept, which is as
    many as a search for copies - 1 neighbours can return; the limit is applied
    before the shuffle, so a vector with very many copies is no hot key.
    """
    key = F.xxhash64("vector")
    rank = F.row_number().over(Window.partitionBy(key, "vector").orderBy("vec_id"))
    kept = vectors.withColumn("copy", rank).where(F.col("copy") <= copies).select("vec_id", "vector")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    kind = vectors.schema["vector"].dataType.simpleString()
    schema = f"vec_id long, vector {kind}, code binary, length double, match double, centre double"
    if not sample:
        return Index(kept.sparkSession.createDataFrame([], schema), np.zeros(0))
    centre = units(np.array([r.vector for r in sample], dtype=np.float64)).mean(axis=0)
    d = len(centre)

    def run(batches):
        turn = rotation(d, seed)
        for pdf in batches:
            if len(pdf):
                code, length, match, product = codes(np.stack(pdf["vector"].to_numpy()).astype(np.float64), centre, turn)
                yield pdf.assign(code=[c.tobytes() for c in code], length=length, match=match, centre=product)

    return Index(staged(kept.mapInPandas(run, schema), "index"), centre)


class Cell:
    """Index rows of one cell, ready for queries: codes as words, vectors as they came."""

    def __init__(self, rows: pd.DataFrame, centre: np.ndarray, turn: np.ndarray, bound: float):
        d = len(centre)
        self.ids = rows["vec_id"].to_numpy(dtype=np.int64)
        self.vectors = np.stack(rows["vector"].to_numpy())
        self.words = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1).T.copy()
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int32)
        self.length, match, self.product = (rows[c].to_numpy(dtype=np.float64) for c in ("length", "match", "centre"))
        self.scale = self.length / match
        self.slack = self.length * np.sqrt(np.maximum(0.0, 1 - match**2)) / match * bound / np.sqrt(max(1, d - 1))
        self.centre, self.turn = centre, turn

    def estimate(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of a unit query with all rows, and how far they may be off."""
        d = len(self.centre)
        rest = query - self.centre
        turned = rest @ self.turn
        low = turned.min()
        step = max((turned.max() - low) / (2**PLANES - 1), 1e-300)
        level = np.rint((turned - low) / step).astype(np.uint8)
        planes = words_of((level[None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None]) & 1)
        common = np.zeros(len(self.ids), np.int32)
        for bit, plane in enumerate(planes):
            for word, mask in zip(self.words, plane, strict=True):
                common += np.bitwise_count(word & mask).astype(np.int32) << bit
        rounded = low * d + step * float(level.sum())
        product = (2 * (low * self.ones + step * common) - rounded) / np.sqrt(d)
        size = np.sqrt((rest * rest).sum())
        off = self.slack * size + np.abs(self.scale) * (step / 2 * np.sqrt(d))
        return self.scale * product + self.product + (query @ self.centre - self.centre @ self.centre), off

    def nearest(self, queries: np.ndarray, k: int):
        """(row, position, score) of each query's k best rows here, of equal scores the smaller ids."""
        own = units(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        first = min(FIRST, len(self.ids))
        for i in range(len(queries)):
            e, off = self.estimate(own[i])
            at = np.argpartition(-e, first - 1)[:first]
            score = self.exact(at, queries[i], norms[i])
            if len(self.ids) > first:
                threshold = np.sort(score)[-min(k, first)]
                hopeful = e + off >= threshold - 1e-9
                hopeful[at] = False
                more = np.flatnonzero(hopeful)
                at, score = np.append(at, more), np.append(score, self.exact(more, queries[i], norms[i]))
            best = np.lexsort((self.ids[at], -score))[:k]
            yield i, self.ids[at[best]], score[best]

    def exact(self, at: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        rows = self.vectors[at].astype(np.float64)
        return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * norm)


def search(index: Index, queries: DataFrame, k: int, bound: float = BOUND, seed: int = SEED) -> DataFrame:
    """(query, vec_id, score): the k best index rows of each of ``queries(query, vector)``, itself not excluded."""
    n, centre = index.rows.count(), index.centre
    cells = max(1, -(-n // CELL_ROWS), min(LEAST_CELLS, -(-n // LEAST_ROWS)))
    none = F.lit(None)
    rows = index.rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), "vec_id", "vector", "code", "length", "match", "centre")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), F.col("query").alias("vec_id"), "vector", none.cast("binary").alias("code"), *[none.cast("double").alias(c) for c in ("length", "match", "centre")])
    met = rows.unionByName(asked).repartition(cells, "cell").sortWithinPartitions("cell", "kind")

    def run(batches):
        turn = rotation(len(centre), seed)
        now, held, cell = None, [], None
        for pdf in batches:
            for (number, kind), part in pdf.groupby(["cell", "kind"], sort=True):
                if number != now:
                    now, held, cell = number, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if cell is None and held:
                    cell, held = Cell(pd.concat(held), centre, turn, bound), []
                if cell:
                    names = part["vec_id"].to_numpy()
                    found = [(np.full(len(ids), names[j]), ids, score) for j, ids, score in cell.nearest(np.stack(part["vector"].to_numpy()).astype(np.float64), k)]
                    yield pd.DataFrame(dict(zip(("query", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    found = met.mapInPandas(run, "query long, vec_id long, score double")
    return best_of(found, ["query"], k).select("query", "vec_id", "score")


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key with their rank; an id that repeats counts once, by its best row."""
    once = found.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, is_query, k: int = NEAREST, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row that ``is_query`` selects.

    Score is the cosine in double precision of the vectors as they came. Rows with
    a null id, an unusable vector, or one of another length than most, take no part
    (see usable). Of equal scores the smaller vec_id is nearer. Queries with equal
    vectors are searched once, and rows that repeat an id count once. A query without any other usable row has no result; an empty
    table gives no rows; columns but vec_id and embedding are ignored.
    """
    vectors = staged(usable(rows), "vectors")
    index = build_index(vectors, k + 1)
    asked = vectors.where(is_query).withColumn("key", F.xxhash64("vector"))
    leaders = asked.groupBy("key", "vector").agg(F.min("vec_id").alias("query"))
    leaders = staged(leaders, "queries")
    found = staged(search(index, leaders.select("query", "vector"), k + 1, bound), "found")
    members = asked.join(leaders, ["key", "vector"]).select(F.col("vec_id").alias("query_id"), "query")
    each = members.join(found, "query").where("vec_id <> query_id").select("query_id", "query", "vec_id", "score")
    return best_of(each, ["query_id", "query"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_onebit_search(spark, sf_dir):
    """The 5 nearest rows of every row whose vec_id is divisible by 50."""
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
