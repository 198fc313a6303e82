"""A Merkle manifest of a table: a postorder log of nodes, proofs read from it by closed-form positions.

Leaves are rows, in one tree for each source, and one more tree stands over the
sources' roots. Every 16 consecutive nodes have a parent. A tree's log holds its
nodes in the order in which a reader of its leaves completes them; where a node
stands follows from the number of leaves alone:

    position(leaf r) = r + r div 16 + r div 256 + ...   (as many terms as levels above the leaves)
    position(node i of level l) = position(its last leaf) + l

Builders are tasks over aligned runs of 4096 nodes: each writes the nodes that
complete within its run, three levels at a time, so a source of any size is built
by many tasks. Proofs go the other way: a run's task finds the siblings of its
own nodes at their positions in its part of the log, and takes what lies above
from the stage before.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table
from tidemark.llm.crc_sql import CRCS, crc32_sql
from tidemark.llm.ranks import ranked, whole_groups

FAN = 16
LEVELS = 3  # that a builder completes, in an aligned run of 16**3 nodes
HEX = 64  # characters of a digest
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED = 5

#: A doc_id is carried as text: pandas would make floats of numbers among nulls.
LOG = "tree string, n long, run long, position long, level int, hash string, doc_id string, changed string"
PATH = "tree string, run long, position long, path array<string>, subroot string, root string"
PROOF = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[framed(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, hash, changed): each row's leaf, and the leaf of its tampered text where it is tampered with, else null.

    Texts are read once, here. A null doc_id isn't tampered with. Trees sort as
    sources do, null first.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(F.col("text")).alias("hash"),
        F.when(hit, leaf_hash(F.translate("text", UPPER, LOWER))).alias("changed"),
    )


def height(n: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while FAN**levels < n:
        levels += 1
    return levels


def positions(n: int, level: int, index: np.ndarray) -> np.ndarray:
    """Where nodes of a level stand in the log of a tree of n leaves."""
    last = np.minimum((index + 1) * FAN**level, n) - 1
    return last + sum((last // FAN**k for k in range(1, height(n) + 1)), np.zeros_like(last)) + level


class Stage(NamedTuple):
    """Nodes of level ``base`` and the ``levels`` levels above it, as rows of LOG; each run has its base nodes too."""

    base: int
    levels: int
    log: DataFrame

    @property
    def top(self) -> int:
        return self.base + self.levels

    def complete(self) -> Column:
        """Whether a tree of n leaves has its root in this stage."""
        return (F.col("n") > (FAN**self.base if self.base else 0)) & (F.col("n") <= FAN**self.top)


def built(base: int, levels: int, nodes: DataFrame) -> DataFrame:
    """The log of the runs of ``nodes(tree, n, index, hash, doc_id, changed)`` of level ``base``, in completion order within a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["tree", "run"]):
            tree, n, number = pdf["tree"].iloc[0], int(pdf["n"].iloc[0]), int(pdf["run"].iloc[0])
            index = pdf["index"].to_numpy()
            parts = [pd.DataFrame({"position": positions(n, base, index), "level": base, "hash": pdf["hash"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "changed": pdf["changed"].to_numpy()})]
            hashes = pdf["hash"].tolist()
            for level in range(base + 1, min(base + levels, height(n)) + 1):
                hashes = [hashed(*hashes[i : i + FAN]) for i in range(0, len(hashes), FAN)]
                first = number * FAN ** (base + levels - level)
                parts.append(pd.DataFrame({"position": positions(n, level, first + np.arange(len(hashes))), "level": level, "hash": hashes}))
            yield pd.concat(parts).sort_values("position").assign(tree=tree, n=n, run=number)[["tree", "n", "run", "position", "level", "hash", "doc_id", "changed"]]

    dealt = nodes.withColumn("run", F.expr(f"index div {FAN**levels}")).repartition("tree", "run").sortWithinPartitions("tree", "run", "index")
    return dealt.mapInPandas(run, LOG)


def append_log(nodes: DataFrame, most: int, levels: int) -> list[Stage]:
    """All stages of trees of ``most`` leaves or fewer, from ``nodes(tree, n, index, hash, doc_id, changed)``.

    A stage's tops are the next one's base; a tree that is complete takes no more part.
    """
    stages: list[Stage] = []
    while True:
        base = levels * len(stages)
        stages.append(Stage(base, levels, staged(built(base, levels, nodes), f"log{base}")))
        top = stages[-1].top
        if FAN**top >= most:
            return stages
        none = F.lit(None).cast("string")
        tops = stages[-1].log.where((F.col("level") == top) & (F.col("n") > FAN**top))
        nodes = tops.select("tree", "n", F.col("run").alias("index"), "hash", none.alias("doc_id"), none.alias("changed"))


def tops_of(stages: list[Stage]) -> DataFrame:
    """(tree, hash): the root of each tree."""
    out = None
    for stage in stages:
        last = stage.log.where(stage.complete()).groupBy("tree").agg(F.max_by("hash", "position").alias("hash"))
        out = last if out is None else out.unionByName(last)
    return out


def siblings(pdf: pd.DataFrame, base: int, levels: int, n: int, number: int) -> list[list[tuple[str, str]]]:
    """For each base node of a run, its siblings left and right at each level below the run's top, found by position."""
    there, hashes = pdf["position"].to_numpy(), pdf["hash"].to_numpy()
    start = number * FAN**levels
    count = min(start + FAN**levels, -(-n // FAN**base)) - start
    out: list[list[tuple[str, str]]] = [[] for _ in range(count)]
    for level in range(base, min(base + levels, height(n))):
        below = FAN ** (level - base)
        index = start // below + np.arange(-(-count // below))
        own = hashes[np.searchsorted(there, positions(n, level, index))]
        sides = []
        for i in range(0, len(own), FAN):
            whole = "".join(own[i : i + FAN])
            sides += [(whole[:at], whole[at + HEX :]) for at in range(0, len(whole), HEX)]
        for i, mine in enumerate(out):
            mine.append(sides[i // below])
    return out


def with_paths(stage: Stage, above: DataFrame) -> DataFrame:
    """A stage's log rows with the path above each run, which comes as a row of PATH before them."""
    empty = {c: F.lit(None).cast(kind) for c, kind in (("n", "long"), ("level", "int"), ("hash", "string"), ("doc_id", "string"), ("changed", "string"))}
    none = {c: F.lit(None).cast(kind) for c, kind in (("path", "array<string>"), ("subroot", "string"), ("root", "string"))}
    rows = stage.log.withColumns(none).unionByName(above.withColumn("position", F.lit(-1).cast("long")).withColumns(empty))
    return rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "position")


def paths(stage: Stage, above: DataFrame) -> DataFrame:
    """PATH of each base node, as a run of the stage below: siblings left and right, level by level to the root."""
    base, levels = stage.base, stage.levels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["tree", "run"]):
            top, rest = pdf.iloc[0], pdf.iloc[1:]
            n, number = int(rest["n"].iloc[0]), int(top["run"])
            own = siblings(rest, base, levels, n, number)
            yield pd.DataFrame({"tree": top["tree"], "run": number * FAN**levels + np.arange(len(own)), "position": -1, "path": [[x for pair in mine for x in pair] + list(top["path"]) for mine in own], "subroot": top["subroot"], "root": top["root"]})

    return with_paths(stage, above).mapInPandas(run, PATH)


def proofs(stage: Stage, above: DataFrame) -> DataFrame:
    """PROOF of each leaf of the lowest stage; the folded root starts at the tampered leaf where there is one."""
    base, levels = stage.base, stage.levels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["tree", "run"]):
            top, rest = pdf.iloc[0], pdf.iloc[1:]
            own = siblings(rest, base, levels, int(rest["n"].iloc[0]), int(top["run"]))
            path = list(top["path"])
            higher, upper = "".join(path), list(zip(path[::2], path[1::2], strict=True))
            low = rest[rest["level"] == base]
            digests, folded = [], []
            for leaf, changed, mine in zip(low["hash"], low["changed"], own, strict=True):
                digests.append(hashed(*[x for pair in mine for x in pair], higher))
                at = leaf if changed is None else changed
                for left, right in (*mine, *upper):
                    at = hashed(left, at, right)
                folded.append(at)
            out = pd.DataFrame({"doc_id": low["doc_id"], "leaf": low["hash"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": digests, "folded_root": folded})
            yield out.assign(verified=out["folded_root"] == out["root"])

    return with_paths(stage, above).mapInPandas(run, PROOF).withColumn("doc_id", F.col("doc_id").cast("long"))


class Manifest(NamedTuple):
    """Stages of the sources' trees, and of the tree over their roots, whose leaves' index is the source's place; trees has (tree, n, place, subroot)."""

    stages: list[Stage]
    over: list[Stage]
    trees: DataFrame


def log_of(stages: list[Stage]) -> DataFrame:
    """(tree, position, level, hash): the whole log, a row for each node."""
    out = None
    for stage in stages:
        own = (stage.log.where(F.col("level") > stage.base) if stage.base else stage.log).select("tree", "position", "level", "hash")
        out = own if out is None else out.unionByName(own)
    return out


def manifest(docs: DataFrame, levels: int = LEVELS) -> Manifest | None:
    """The log of all rows of ``docs``; None for an empty table.

    Rows of a source ascend by doc_id, null first, then by leaf. Repeated rows are
    leaves of their own. Other columns than FIELDS aren't read.
    """
    rows = staged(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = ranked(rows, ["tree", "doc_id", "hash", "row"], "ordered")
    sizes = staged(placed.groupBy("tree").agg(F.count("*").alias("n"), F.min("rank").alias("first")), "sizes")
    most = sizes.agg(F.max("n"), F.count("*")).first()
    if not most[1]:
        return None
    nodes = placed.join(sizes, "tree").select("tree", "n", (F.col("rank") - F.col("first")).alias("index"), "hash", F.col("doc_id").cast("string").alias("doc_id"), "changed")
    stages = append_log(nodes, most[0], levels)
    roots = ranked(staged(tops_of(stages), "subroots"), ["tree"], "places")
    trees = staged(roots.join(sizes, "tree").select("tree", "n", F.col("rank").alias("place"), F.col("hash").alias("subroot")), "trees")
    none = F.lit(None)
    over = append_log(trees.select(F.lit("").alias("tree"), F.lit(most[1]).cast("long").alias("n"), F.col("place").alias("index"), F.col("subroot").alias("hash"), none.cast("string").alias("doc_id"), none.cast("string").alias("changed")), most[1], levels)
    return Manifest(stages, over, trees)


def all_proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """PROOF of every row of ``docs``, from a log that is built and read back; no rows for an empty table."""
    spark, made = docs.sparkSession, manifest(docs, levels)
    if made is None:
        return spark.createDataFrame([], PROOF).withColumn("doc_id", F.col("doc_id").cast("long"))
    stages, over, trees = made
    root = tops_of(over).first().hash
    above = spark.createDataFrame([("", 0, -1, [], None, root)], PATH)
    for stage in reversed(over):
        above = staged(paths(stage, above), "paths")
    # Each source's path to the root, for the one run of its highest stage; then stage by stage down.
    tops = staged(above.select(F.col("run").alias("place"), "path", "root").join(trees, "place").select("tree", "n", F.lit(0).cast("long").alias("run"), F.lit(-1).cast("long").alias("position"), "path", "subroot", "root"), "tops")
    names = [c.split()[0] for c in PATH.split(", ")]
    above = None
    for stage in reversed(stages):
        here = tops.where(stage.complete()).select(names)
        above = here if above is None else here.unionByName(above)
        if stage.base:
            above = staged(paths(stage, above), "paths")
    return proofs(stages[0], above)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from the tampered text where it is tampered with."""
    return all_proofs(table(spark, sf_dir, "documents").select(*FIELDS))


def levels_sql(name: str, count: int) -> list[str]:
    """Relations of a forest from {name}0(tree, i, h): {name}r1 to {name}r<count> hold each run's joined hashes, and n, the nodes of its tree's level."""
    out = []
    for k in range(1, count + 1):
        below = f"(select *, count(*) over (partition by tree) as n from {name}{k - 1})"
        out.append(f"{name}r{k} as materialized (select tree, i // {FAN} as i, n, string_agg(h, '' order by i) as r from {below} group by tree, i // {FAN}, n)")
        out.append(f"{name}{k} as materialized (select tree, i, case when n = 1 then r else sha256(r) end as h from {name}r{k})")
    return out


def oracle(levels: int = 5, over: int = 3) -> str:
    """The query in SQL, level by level: for sources of at most 16**levels rows, and at most 16**over sources."""

    def frame(c: str) -> str:
        return f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(frame(text if c == "text" else c) for c in FIELDS) + ")"

    hit = f"doc_id is not null and {crc32_sql('cast(doc_id as varchar)')} % {TAMPERED} = 0"
    parts = [
        CRCS,
        f"leaves as materialized (select doc_id, coalesce('s' || source, '') as tree, {leaf('text')} as h, case when {hit} then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as changed from documents, crcs)",
        "d0 as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i from leaves)",
        *levels_sql("d", levels),
        f"o0 as materialized (select '' as tree, row_number() over (order by encode(tree)) - 1 as i, h, tree as source from d{levels})",
        *levels_sql("o", over),
        f"p0 as (select d0.doc_id, d0.h as leaf, o0.h as subroot, o{over}.h as root, d0.tree, d0.i, o0.i as place, '' as proof, coalesce(changed, d0.h) as folded from d0 join o0 on o0.source = d0.tree, o{over})",
    ]
    steps = [("d", k, "p.tree", "p.i") for k in range(1, levels + 1)] + [("o", k, "''", "p.place") for k in range(1, over + 1)]
    for number, (name, k, tree, index) in enumerate(steps):
        here = f"{index} // {FAN ** (k - 1)}"
        left, right = (f"case when n > 1 then {x} else '' end" for x in (f"left(r, cast({HEX} * ({here} % {FAN}) as int))", f"substr(r, cast({HEX} * ({here} % {FAN}) + {HEX + 1} as int))"))
        sides = f"select p.*, x.n, {left} as a, {right} as b from p{number} p join {name}r{k} x on x.tree = {tree} and x.i = {here} // {FAN}"
        parts.append(f"p{number + 1} as (select * exclude (n, a, b) replace (proof || a || b as proof, case when n > 1 then sha256(a || folded || b) else folded end as folded) from ({sides}))")
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from p{len(steps)}"
