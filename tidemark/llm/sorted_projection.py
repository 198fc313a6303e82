"""Near-duplicate vectors by sorted projection passes.

In each pass a vector's key is the concatenated signs of random projections. All
vectors are sorted by their keys, and each is compared with the WINDOW vectors
before it; the pairs at or above the cosine are verified on the spot and become
the edges of a graph, whose components are the unions across passes. A window is
bounded, so in a group of many near copies it sees few of a vector's links. Links
are therefore counted afterwards, within components and in full: small components
as one product, large ones in tiles ordered by the angle to the component's
centre, where the triangle inequality settles most pairs of tiles without a look
at their vectors, and the rest are compared tile by tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table
from tidemark.llm.graph import components
from tidemark.llm.ranks import ranked, whole_groups

LINK = 0.95
WINDOW = 256
#: The chance that a pair just at the cosine is in no window of any pass; passes follow from it and the number of vectors.
MISS = 1e-4
#: Signs of a key.
BITS = 62
#: Vectors that are compared in one task at once, beside a window of those before.
BLOCK = 2048
#: Components of more vectors are compared in tiles of so many.
TILE = 1024
#: Radians by which a sum of angles must be clear of the limit to settle a pair of tiles; far above rounding.
CLEAR = 1e-7
SEED = 1101

EDGES = "a long, b long"
COUNTS = "node long, links long"


def passes_for(n: int, cosine: float = LINK, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes so that a pair at the cosine is missed by all with a chance of ``miss`` at most, keys being spread evenly.

    Two vectors share a sign with a chance of 1 - angle / pi. They are surely within
    a window when they share the first signs that leave half a window of vectors.
    """
    signs = math.log2(max(1.0, 2 * n / window))
    found = (1 - math.acos(cosine) / math.pi) ** signs
    return 1 if found > 1 - miss else math.ceil(math.log(miss) / math.log(1 - found))


def packed(rows: DataFrame, vector: str) -> tuple[DataFrame, str]:
    """(vec_id, v) with each usable vector as bytes of the numpy type that is named, others null.

    Not usable are vectors that are null, empty or zero, or have a component that is
    null or not finite, or whose length overflows a double.
    """
    single = rows.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    cast = rows.select(F.col("vec_id").cast("long").cast("string").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            arrays = (None if x is None else np.asarray(x, kind) for x in pdf["vector"])
            yield pd.DataFrame({"id": pdf["id"], "v": [None if x is None or not 0 < np.linalg.norm(x.astype(np.float64)) < np.inf else x.tobytes() for x in arrays]})

    usable = cast.select("id", F.when(F.coalesce(finite, F.lit(False)), v).alias("vector"))
    return usable.mapInPandas(run, "id string, v binary").select(F.col("id").cast("long").alias("vec_id"), "v"), kind


def units(vectors: pd.Series, kind: str) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    out = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def pass_keys(nodes: DataFrame, kind: str, passes: int, seed: int = SEED) -> DataFrame:
    """(dim, pass, key, node): each vector's key in each pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for pdf in batches:
            for size, some in pdf.groupby(pdf["v"].str.len()):
                dim = size // np.dtype(kind).itemsize
                if dim not in turns:
                    turns = {dim: np.random.default_rng([seed, dim]).standard_normal((passes, dim, BITS))}
                for i in range(0, len(some), BLOCK):
                    part = some.iloc[i : i + BLOCK]
                    own = units(part["v"], kind)
                    for number, turn in enumerate(turns[dim]):
                        yield pd.DataFrame({"dim": np.int32(dim), "pass": np.int32(number), "key": (own @ turn > 0) @ weights, "node": part["node"].to_numpy()})

    return nodes.select("node", "v").mapInPandas(run, "dim int, pass int, key long, node long")


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that pairs (a, b) of n positions connect each position with."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def window_pairs(own: np.ndarray, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (later, earlier) at most ``window`` apart whose cosine is reached."""
    later, earlier = [], []
    for i in range(0, len(own), window):
        low = max(0, i - window)
        row, col = np.nonzero(own[i : i + window] @ own[low : i + window].T >= cosine)
        row, col = row + i, col + low
        near = (col < row) & (row - col <= window)
        later.append(row[near])
        earlier.append(col[near])
    return np.concatenate(later), np.concatenate(earlier)


def window_edges(nodes: DataFrame, kind: str, passes: int, cosine: float = LINK, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b): of all verified pairs in the passes' windows, a spanning forest for each block."""
    keys = staged(pass_keys(nodes, kind, passes), "keys")
    places = ranked(keys, ["dim", "pass", "key", "node"], "sorted")
    at = F.expr(f"rank div {block}")
    again = F.when(F.col("rank") % block >= block - window, F.array(at, at + 1)).otherwise(F.array(at))  # a block's end stands before the next one
    dealt = places.select("dim", "rank", "node", again.alias("blocks")).join(nodes.select("node", "v"), "node").select("dim", "rank", "node", "v", F.explode("blocks").alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["block"]):
            for _, some in pdf.groupby("dim"):
                label = united(len(some), *window_pairs(units(some["v"], kind), window, cosine))
                number = some["node"].to_numpy()
                linked = label != np.arange(len(label))
                yield pd.DataFrame({"a": number[linked], "b": number[label[linked]]})

    return dealt.repartition("block").sortWithinPartitions("block", "rank").mapInPandas(run, EDGES)


def small_counts(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """COUNTS within components of ``members(root, node, weight, v)`` that fit one product."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["root"]):
            own = units(pdf["v"], kind)
            yield pd.DataFrame({"node": pdf["node"].to_numpy(), "links": (own @ own.T >= cosine) @ pdf["weight"].to_numpy()})

    return members.repartition("root").sortWithinPartitions("root").mapInPandas(run, COUNTS)


def centres(members: DataFrame, kind: str) -> DataFrame:
    """(root, centre): the sum of the unit vectors of each component; sums come from batches, not from rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for root, some in pdf.groupby("root"):
                yield pd.DataFrame({"root": [root], "part": [units(some["v"], kind).sum(axis=0)]})

    parts = members.select("root", "v").mapInPandas(run, "root long, part array<double>").select("root", F.posexplode("part").alias("at", "x"))
    sums = parts.groupBy("root", "at").agg(F.sum("x").alias("x"))
    return sums.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre"))  # as many as dimensions


def angles(members: DataFrame, kind: str) -> DataFrame:
    """``members`` with the angle of each vector to its component's centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            angle = np.zeros(len(pdf))
            for _, rows in pdf.groupby("root").indices.items():
                centre = np.asarray(pdf["centre"].iloc[rows[0]])
                size = np.linalg.norm(centre)
                if size > 0:
                    angle[rows] = np.arccos(np.clip(units(pdf["v"].iloc[rows], kind) @ centre / size, -1, 1))
            yield pdf.drop(columns="centre").assign(angle=angle)

    placed = members.join(centres(members, kind), "root")
    return placed.select("root", "node", "weight", "v", "centre").mapInPandas(run, "root long, node long, weight long, v binary, angle double")


def tile_plan(tiles: DataFrame, cosine: float) -> DataFrame:
    """``tiles(root, tile, weight, low, high)`` of ascending angles to (root, i, j, sure).

    Rows with a null j: all vectors of tile i are linked with vectors that weigh
    ``sure`` altogether, as the angles to the centre add up to less than the limit.
    Others: tiles i <= j must be compared. Tiles whose angles differ by more than the
    limit have no link.
    """
    limit = math.acos(cosine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["root"]):
            tile, low, high = (pdf[c].to_numpy() for c in ("tile", "low", "high"))
            weight = np.concatenate([[0], np.cumsum(pdf["weight"].to_numpy())])
            root = pdf["root"].iloc[0]
            sure = np.searchsorted(high, limit - CLEAR - high, side="right")  # tiles before are linked
            reach = np.searchsorted(low, high + limit + CLEAR, side="right")  # tiles from there on aren't
            yield pd.DataFrame({"root": root, "i": tile, "j": -1, "sure": weight[sure]})
            for at in range(len(tile)):
                some = tile[max(at, sure[at]) : reach[at]]
                if len(some):
                    yield pd.DataFrame({"root": root, "i": tile[at], "j": some, "sure": 0})

    sorted_tiles = tiles.repartition("root").sortWithinPartitions("root", "tile")
    return sorted_tiles.mapInPandas(run, "root long, i long, j long, sure long").withColumn("j", F.when(F.col("j") >= 0, F.col("j")))


def large_counts(members: DataFrame, kind: str, cosine: float, size: int) -> DataFrame:
    """COUNTS within components of any size."""
    turned = staged(angles(members, kind), "angles")
    places = staged(ranked(turned, ["root", "angle", "node"], "shells").withColumn("tile", F.expr(f"rank div {size}")), "tiles")
    tiles = places.groupBy("root", "tile").agg(F.sum("weight").alias("weight"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    plan = staged(tile_plan(tiles, cosine), "plan")
    sure = places.join(plan.where("j is null").select("root", F.col("i").alias("tile"), "sure"), ["root", "tile"]).select("node", F.col("sure").alias("links"))
    pairs = plan.where("j is not null").select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    met = places.select("root", "tile", "node", "weight", "v").join(pairs, ["root", "tile"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["root", "i", "j"]):
            first = (pdf["tile"] == pdf["i"]).to_numpy()
            own, weight, node = units(pdf["v"], kind), pdf["weight"].to_numpy(), pdf["node"].to_numpy()
            if first.all():
                yield pd.DataFrame({"node": node, "links": (own @ own.T >= cosine) @ weight})
                continue
            linked = own[first] @ own[~first].T >= cosine
            yield pd.DataFrame({"node": node[first], "links": linked @ weight[~first]})
            yield pd.DataFrame({"node": node[~first], "links": weight[first] @ linked})

    compared = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(run, COUNTS)
    return sure.unionByName(compared).groupBy("node").agg(F.sum("links").alias("links"))


def linked(rows: DataFrame, vector: str = "embedding", cosine: float = LINK, window: int = WINDOW, miss: float = MISS, tile: int = TILE, passes: int | None = None) -> DataFrame:
    """``rows(vec_id, <vector>)`` to (vec_id, n_links, component_id, kept), a row for each.

    Every row is a vector of its own: exact copies, repeated rows and ids among
    them, link with each other. Vectors that aren't usable (see packed) link with
    nothing, nor do vectors of different lengths. A component's id is its smallest
    vec_id; a row with a null id takes part, but names a component only if that has
    no other ids. kept is whether a row's id is its component's. An empty table
    gives no rows; other columns are ignored.
    """
    packed_rows, kind = packed(rows, vector)
    every = staged(packed_rows, "vectors")
    copies = every.where("v is not null").groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    nodes = staged(copies.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = window_edges(nodes, kind, passes or passes_for(nodes.count(), cosine, window, miss), cosine, window)
    found = staged(components(edges).select("node", "root"), "components")
    members = staged(found.join(nodes, "node"), "members")
    sizes = staged(members.groupBy("root").agg(F.count("*").alias("size"), F.min("first").alias("component_id")), "sizes")
    sized = members.join(sizes, "root")
    counts = small_counts(sized.where(F.col("size") <= tile).select("root", "node", "weight", "v"), kind, cosine)
    if not sizes.where(F.col("size") > tile).isEmpty():
        large = staged(sized.where(F.col("size") > tile).select("root", "node", "weight", "v"), "large")
        counts = counts.unionByName(large_counts(large, kind, cosine, tile))
    named = sized.select("node", "component_id").join(counts, "node")
    whole = nodes.join(named, "node", "left").select("v", F.coalesce("links", "weight").alias("links"), F.when(F.col("links").isNotNull(), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    usable = every.where("v is not null").join(whole, "v").select("vec_id", (F.col("links") - 1).alias("n_links"), "component_id")
    other = every.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(other).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links at a cosine of 0.95 and its component."""
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle() -> str:
    """The query in SQL, over all pairs."""
    return f"""
with recursive v as (select row_number() over () as row, vec_id, cast(embedding as double[]) as e from embeddings),
good as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pairs as materialized (select a.row, b.row as other from good a join good b on a.row <> b.row and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {LINK}),
reach as (select row, row as other from v union select r.row, p.other from reach r join pairs p on p.row = r.other),
named as (select r.row, min(v.vec_id) as component_id from reach r join v on v.row = r.other group by r.row),
counts as (select row, count(*) as n from pairs group by row)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id is not distinct from component_id as kept from v join named using (row) left join counts using (row)"""
