"""SimHash near-duplicates, paired through vantage-point trees.

Fingerprints are 64-bit SimHash values over 3-word shingles. Distinct values are
dealt to shards by a shallow vantage-point tree whose vantage points and radii
come from a bounded sample. At a node with vantage point p and radius r a value
x goes in if d(x, p) <= r, else out. By the triangle bound a partner within k
bits of x lies at a distance from p between d(x, p) - k and d(x, p) + k, so only
values near the boundary are also sent, as visitors, to the shards behind it.
Each shard then runs the same recursion in memory down to small blocks, which
are compared exactly, and returns a spanning forest of the links that it found.
Components of those forests are the near-duplicate groups.

``similar_groups`` links texts by the Jaccard similarity of their shingle sets
instead. The radius that this needs is so wide that vantage points from a sample
can't divide all fingerprints: nearly every value would be sent to every shard.
There the shards are blocks of texts that share a rare shingle. Two sets of
similarity LIKE have one in common among the first (1 - LIKE) n + 1 of each, in
any order of all shingles, and the order puts common ones last. Blocks run the same
vantage-point recursion over two fingerprint words, its links make clusters, and
all pairs within a cluster are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged, whole_row
from tidemark.llm.graph import components
from tidemark.llm.url_filter import marked, semi_join

BITS = 3  # fingerprints link at so many differing bits or fewer
WORDS = 3  # words of a shingle
SAMPLE = 4096  # fingerprints that the shard tree is fitted on, at most
SHARD = 16384  # distinct fingerprints that a shard should own
CELL = 400_000  # rows, visitors included, that one task holds at once
BLOCK = 1 << 20  # pairs that are compared without further branching

LIKE = 0.8  # Jaccard similarity of shingle sets at which texts are similar
LIKE_WORDS = 5  # words of a shingle there
NEAR_BITS = 28  # differing bits of the first fingerprint word within which similar texts are looked for
WIDE_BITS = 44  # and of both words together; at 0.8 about 19 of 128 are expected, 24 for sets of five, between unlike texts 64
SKETCH = 1 << 18  # counters of shingles, by hash; a power of two
TILE = 1024  # counters in a row of the sketch
SALTS = 1024  # parts of the texts with a common shingle; a power of two
CLUSTER_CHARS = 6 << 20  # characters of a cluster's texts in one of the parts that meet in a task


def shingle_hashes(text: str | None, size: int = WORDS) -> list[int]:
    """Hashes of a text's word shingles, with repetitions; a text of fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hash_of = xxhash.xxh64_intdigest
    return [hash_of(joined[a:b], 42) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """The 64-bit SimHash of hashes, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a long text is counted piece by piece
        chunk = np.array(hashes[i : i + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(chunk, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """SimHash of one text, as a signed 64-bit integer.

    Null, empty and blank texts give 0. A-Z are lower-cased and words are runs
    without ASCII white space, which is what bytes.lower and bytes.split do.
    """
    return majority(shingle_hashes(text))


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def distance(values: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ to).astype(np.int16)


def fit_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int] | None]:
    """Vantage points and radii of a complete binary tree, by heap position.

    The vantage point of a node is its first sample value, the radius the median
    distance to it. None marks a node that can't be divided: all goes in.
    """
    nodes: list[tuple[int, int] | None] = [None] * (2**depth - 1)
    own = {0: sample}
    for i in range(len(nodes)):
        mine = own.pop(i, sample[:0])
        if len(mine) < 2:
            continue
        d = distance(mine, mine[0])
        nodes[i] = (int(mine[0]), int(np.median(d)))
        own[2 * i + 1], own[2 * i + 2] = mine[d <= nodes[i][1]], mine[d > nodes[i][1]]
    return nodes


def route(values: np.ndarray, nodes: list[tuple[int, int] | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, shards and owner flags: one owner for each value, and visitors where the bound can't exclude a partner.

    An owner inside near the boundary visits the outside; owners outside needn't
    visit the inside, as each pair has to meet once only.
    """
    parts, todo = [], [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        node, at, owner = todo.pop()
        if not len(at):
            continue
        if node >= len(nodes):
            parts.append((at, np.full(len(at), node - len(nodes), np.int32), owner))
        elif nodes[node] is None:
            todo.append((2 * node + 1, at, owner))
        else:
            vantage, r = nodes[node]
            d = distance(values[at], np.uint64(vantage))
            inside = np.where(owner, d <= r, d - bits <= r)
            outside = d + bits > r
            todo.append((2 * node + 1, at[inside], owner[inside]))
            todo.append((2 * node + 2, at[outside], owner[outside] & (d[outside] > r)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Links:
    """Labels of values under the links met so far; the smallest position of a group is its label."""

    def __init__(self, values: np.ndarray, bits: int, second: np.ndarray | None = None):
        self.values, self.bits, self.label, self.found, self.held = values, bits, np.arange(len(values)), [], 0
        self.second = second  # further words of the values, or None

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs between two lists of positions, in blocks."""
        rows = max(1, BLOCK // max(1, len(b)))
        for i in range(0, len(a), rows):
            part = a[i : i + rows]
            x, y = np.nonzero(np.bitwise_count(self.values[part][:, None] ^ self.values[b][None, :]) <= self.bits)
            x, y = part[x], b[y]
            if self.second is not None:
                both = np.bitwise_count(self.values[x] ^ self.values[y]) + np.bitwise_count(self.second[x] ^ self.second[y])
                x, y = x[both <= WIDE_BITS], y[both <= WIDE_BITS]
            new = self.label[x] != self.label[y]
            if new.any():
                self.found.append((x[new], y[new]))
                self.held += int(new.sum())
                if self.held > BLOCK:
                    self.merge()

    def merge(self) -> None:
        if not self.found:
            return
        x, y = (np.concatenate(z) for z in zip(*self.found, strict=True))
        self.found, self.held = [], 0
        while True:
            a, b = self.label[x], self.label[y]
            new = a != b
            if not new.any():
                return
            x, y, a, b = x[new], y[new], a[new], b[new]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def search(self, own: np.ndarray, visit: np.ndarray) -> None:
        """Links among ``own`` and between ``own`` and ``visit``: a vantage-point recursion."""
        todo = [(own, visit)]
        while todo:
            own, visit = todo.pop()
            if len(own) * (len(own) + len(visit)) <= BLOCK:
                self.compare(own, np.concatenate([own, visit]))
                continue
            vantage = self.values[own[len(own) // 2]]
            d, e = distance(self.values[own], vantage), distance(self.values[visit], vantage)
            r = int(np.median(d))
            inside, edge = d <= r, (d <= r) & (d + self.bits > r)
            if inside.all() or edge.mean() > 0.45:  # nothing to gain from this division
                self.compare(own, own)
                self.compare(own, visit)
                continue
            todo.append((own[inside], visit[e - self.bits <= r]))
            todo.append((own[~inside], np.concatenate([visit[e + self.bits > r], own[edge]])))
        self.merge()


def cell_links(values: np.ndarray, owner: np.ndarray, second: np.ndarray | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over one cell's links: (a, b), b the smallest fingerprint of a's group."""
    order = np.lexsort((~owner, values))  # an owner may visit its own shard
    order = order[np.diff(values[order], prepend=values[order[0]] - 1) != 0] if len(order) else order
    values, owner = values[order], owner[order]
    links = Links(values.view(np.uint64), bits, None if second is None else second[order].view(np.uint64))
    links.search(np.flatnonzero(owner), np.flatnonzero(~owner))
    linked = np.flatnonzero(links.label != np.arange(len(values)))
    return values[linked], values[links.label[linked]]


def shard_links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The edges of all cells in a stream of rows sorted by cell; one cell is held at once."""
    held: list[np.ndarray] = []

    def close(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = cell_links(rows[2], rows[3].astype(bool), rows[4] if len(rows) > 4 else None, bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        new = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        found = [close([c[i:j] for c in columns]) for i, j in zip([0, *new[:-1].tolist()], new.tolist(), strict=False)]
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0] if sum(map(len, found)) else found[0]
        held = [c[new[-1] if len(new) else 0 :] for c in columns]
    if held and len(held[0]):
        yield close(held)


def near_links(fps: DataFrame, bits: int = BITS, shard_rows: int = SHARD, cell_rows: int = CELL) -> DataFrame:
    """``fps(fp)``, distinct, to edges (a, b) whose components are those of all links at ``bits`` bits."""
    n = fps.count()
    depth = max(0, math.ceil(math.log2(max(1, n / shard_rows))))
    sample = [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()] if depth else []
    nodes = fit_tree(np.array(sample, dtype=np.int64).view(np.uint64), depth)

    def deal(batches):
        for pdf in batches:
            values = pdf["fp"].to_numpy(dtype=np.int64)
            at, shard, owner = route(values.view(np.uint64), nodes, bits)
            yield pd.DataFrame({"shard": shard.astype(np.int64), "fp": values[at], "owner": owner})

    dealt = staged(fps.select("fp").mapInPandas(deal, "shard long, fp long, owner boolean"), "shards")
    return links_within(dealt, bits, cell_rows)


def links_within(dealt: DataFrame, bits: int, cell_rows: int = CELL) -> DataFrame:
    """``dealt(shard, fp, owner)``, written out, to edges (a, b) of each shard's links.

    With a column fp2, a second fingerprint word, links also need WIDE_BITS or fewer over both words.
    A shard with more than ``cell_rows`` rows is divided into salted parts and
    each two parts meet in a cell of their own, so that no task holds more.
    """
    names = [c for c in ("fp", "fp2") if c in dealt.columns]
    size = dealt.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(cell_rows / 2)).cast("int").alias("parts")).where("parts > 2")
    salt = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(salt, j) * F.col("parts") + F.greatest(salt, j))
    cells = dealt.join(size, "shard", "left").select("shard", *names, "owner", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pair)).alias("cell"))
    dealt = cells.select("shard", "cell", "fp", "owner", *names[1:]).repartition("shard", "cell").sortWithinPartitions("shard", "cell")
    return dealt.mapInArrow(lambda batches: shard_links(batches, bits), "a long, b long")


def near_groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs(doc_id, text, ...)`` to (doc_id, fp, component_id), a row for each row.

    component_id is the smallest doc_id that links reach, itself included. Rows
    with equal fingerprints are one node, so copies cost no pairs. Nulls: a null
    text has fingerprint 0; a null doc_id takes part, but is never the smallest
    unless a group has no other. Repeated rows get equal results; an empty table
    gives no rows; other columns are ignored.
    """
    fps = staged(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(staged(near_links(nodes.select("fp"), bits), "links"))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(named.select("fp", "root").join(first, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's distinct LIKE_WORDS-word shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, LIKE_WORDS), dtype=np.uint64))


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes made from given ones (the finaliser of splitmix64)."""
    h = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def read_sets(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, digest, chars, key, fp, fp2), a row for each row, and to rows (tile, counts) of a sketch.

    digest is the text's hash, chars its length, key the hash of its shingle set, fp and
    fp2 are the set's fingerprint words. The sketch counts shingles of all texts by their hash
    modulo SKETCH; each task adds its own counts, TILE of them a row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            key, fp, fp2 = [], [], []
            for text in batch.column("text"):  # one text at a time
                s = shingle_set(text.as_py())
                key.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                fp.append(majority(s))
                fp2.append(majority(remixed(s)))
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            n = batch.num_rows
            columns = [batch.column("doc_id"), batch.column("digest"), batch.column("chars"), pa.array(key, pa.string()), pa.array(fp, pa.int64()), pa.array(fp2, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
            doc_id = batch.column("doc_id").type
        if counts.any():
            tiles = [(i, t.tobytes()) for i, t in enumerate(counts.reshape(-1, TILE)) if t.any()]
            n = len(tiles)
            columns = [pa.nulls(n, doc_id), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([t[0] for t in tiles], pa.int32()), pa.array([t[1] for t in tiles], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "digest", "chars", "key", "fp", "fp2", "tile", "counts"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, digest long, chars int, key string, fp long, fp2 long, tile int, counts binary")


def levels_of(tiles: DataFrame) -> np.ndarray:
    """A level for each counter of a sketch: 0 where its count is usual, else the count's binary logarithm."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for tile, counts in zip(batch.column("tile").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[tile] = sums.get(tile, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["tile", "counts"])

    summed = tiles.repartition(16, "tile").mapInArrow(add, "tile int, counts binary").collect()  # SKETCH / TILE rows at most, 2 MB
    counts = np.zeros(SKETCH, np.int64)
    for r in summed:
        counts[r.tile * TILE : (r.tile + 1) * TILE] = np.frombuffer(r.counts, np.int64)
    usual = counts.mean() + 8 * np.sqrt(counts.mean()) + 8
    return np.where(counts > usual, np.log2(np.maximum(counts, 1)), 0).astype(np.uint8)


def prefix(text: str | None, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which one is common to any two sets of similarity LIKE: the first ones, rare ones before common ones; and whether each is common."""
    s = shingle_set(text)
    level = levels[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    if level.any():
        order = np.argsort(level, kind="stable")
        s, level = s[order], level[order]
    n = len(s) - math.ceil(LIKE * len(s) - 1e-9) + 1
    return s[:n], level[:n] > 0


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(h, digest, salt): the prefix shingles of all texts; salt is -1 for usual shingles, one of SALTS by digest for common ones."""

    def run(batches):
        for batch in batches:
            digests, texts = batch.column("digest").to_numpy(), batch.column("text")
            for i in range(0, len(texts), 512):
                found, common = zip(*[prefix(t.as_py(), levels) for t in texts[i : i + 512]], strict=True)
                digest = np.repeat(digests[i : i + 512], [len(f) for f in found])
                salt = np.where(np.concatenate(common), digest & (SALTS - 1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(digest), pa.array(salt)], ["h", "digest", "salt"])

    return docs.select(F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "h long, digest long, salt int")


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, digest, salt), sorted by h and digest, to the different (h, digest) of salted shingles and of those with several digests; one shingle is held beside a batch."""

    def close(h: np.ndarray, digest: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
        new = np.diff(h, prepend=h[:1] - 1) != 0
        first = new | (np.diff(digest, prepend=digest[:1] - 1) != 0)
        h, digest, salt, new = h[first], digest[first], salt[first], new[first]
        several = ~(new & np.append(new[1:], True))
        keep = several | (salt >= 0)
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(digest[keep])], ["h", "digest"])

    held: list[np.ndarray] = []
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "digest", "salt")]
        columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        if cut:
            yield close(*[c[:cut] for c in columns])
        held = [c[cut:] for c in columns]
    if held and len(held[0]):
        yield close(*held)


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def block_links(docs: DataFrame, sets: DataFrame, levels: np.ndarray, cell_rows: int = CELL) -> DataFrame:
    """Edges (a, b) between the fingerprints in ``sets(digest, fp, fp2)`` that are near each other and whose texts share a prefix shingle.

    Prefix shingles are shuffled once, and most go there: a shingle counts if it has
    different digests, or if it is common; the rows of a common one are dealt to SALTS
    tasks. Blocks of the same texts, and a pair of near copies has many, are searched once.
    """
    rows = prefixes(docs, levels).repartition("h", "salt").sortWithinPartitions("h", "digest").mapInArrow(shared_rows, "h long, digest long")
    named = sets.groupBy("digest").agg(F.min(F.struct("fp", "fp2")).alias("f")).select("digest", "f.fp", "f.fp2")
    members = staged(rows.join(named, "digest").select("h", "fp", "fp2").distinct(), "members")
    blocks = members.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp", "fp2")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "fp", "fp2")).alias("m2"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    once = staged(blocks.where("n > 1").groupBy("n", "m1", "m2").agg(F.min(F.struct("h", "a", "b")).alias("x")).select("n", "x.h", "x.a", "x.b"), "blocks")
    pairs = once.where("n = 2 and a < b").select("a", "b").distinct().where(differing("a", "b") <= NEAR_BITS)
    dealt = members.join(once.where("n > 2").select("h"), "h").select(F.col("h").alias("shard"), "fp", "fp2", F.lit(True).alias("owner"))
    return pairs.unionByName(links_within(staged(dealt, "dealt"), NEAR_BITS, cell_rows))


def similar_links(cell: pd.DataFrame) -> pd.DataFrame:
    """Edges of a spanning forest over all pairs of one cell's texts that are LIKE or more alike: (a, b), b the smallest key of a's group."""
    cell = cell.sort_values("key")
    keys, sets = cell["key"].to_numpy(), [shingle_set(t) for t in cell["text"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    holders = doc[np.argsort(token, kind="stable")]  # of each shingle, in order of texts
    ends = np.cumsum(np.bincount(token, minlength=1))
    label, at = np.arange(len(sets)), np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], ends[:-1]])
    usual = np.bincount(doc, (ends - first)[token], len(sets)) / np.maximum(sizes, 1)
    for i in np.argsort(-usual, kind="stable").tolist():
        if label[i] == label[np.argmax(usual)] and i != np.argmax(usual):
            continue  # pairs of one group needn't be compared, and the others of it compare themselves with i
        mine = token[at[i] : at[i + 1]]
        shared = np.zeros(len(sets), np.int64)
        for part in np.array_split(mine, max(1, int((ends[mine] - first[mine]).sum()) >> 20)):  # bounded lists of holders at once
            n = ends[part] - first[part]
            spots = np.arange(n.sum()) + np.repeat(first[part] - np.cumsum(n) + n, n)
            shared += np.bincount(holders[spots], minlength=len(sets))
        alike = np.flatnonzero((shared > 0) & (shared >= LIKE * (sizes + sizes[i] - shared) - 1e-9))
        groups = np.unique(label[alike])
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]
    linked = np.flatnonzero(label != np.arange(len(sets)))
    return pd.DataFrame({"a": keys[linked], "b": keys[label[linked]]})


def similar_groups(docs: DataFrame, part_chars: int = CLUSTER_CHARS) -> DataFrame:
    """``docs(doc_id, text, ...)`` to (doc_id, digest, root), a row for each row; digest is the text's hash, root names its group.

    Groups are the components of all pairs found whose sets of 5-word shingles
    have a Jaccard similarity of LIKE or more. Texts with equal sets are one node
    and those without words one group. Clusters with long texts are divided into
    salted parts, each two of which meet in a cell. Rows with a null doc_id or text
    take part; an empty table gives no rows; other columns are ignored.
    """
    read = staged(read_sets(docs), "sets")
    fps = read.where("tile is null").select("doc_id", "digest", "chars", "key", "fp", "fp2")
    edges = block_links(docs, fps, levels_of(read.where("tile is not null").select("tile", "counts")))
    roots = components(staged(edges, "links"))
    keys = staged(fps.groupBy("key").agg(F.min("fp").alias("fp"), F.min(F.struct("digest", "chars")).alias("x")).select("key", "fp", "x.digest", "x.chars"), "keys")
    named = keys.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "digest", "chars", F.coalesce("root", "fp").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("n"), F.ceil(F.sum("chars") / F.lit(part_chars)).cast("int").alias("parts"))
    wanted = staged(named.join(sizes.where("n > 1"), "cluster").select("cluster", "key", "digest", "parts"), "clusters")
    texts = semi_join(docs.select(F.xxhash64("text").alias("digest"), "text"), wanted.select("digest"), "digest").dropDuplicates(["digest"])
    salt = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(salt, j) * F.col("parts") + F.greatest(salt, j))
    cells = wanted.join(texts, "digest").select("cluster", "key", "text", F.explode(F.when(F.col("parts") <= 2, F.array(F.lit(0))).otherwise(cell)).alias("cell"))
    edges = cells.groupBy("cluster", "cell").applyInPandas(lambda pdf: similar_links(pdf), "a string, b string")
    found = components(staged(edges, "similar"))
    return fps.join(found.select(F.col("node").alias("key"), "root"), "key", "left").select("doc_id", "digest", F.coalesce("root", "key").alias("root"))


def row_key(doc_id: str) -> list[Column]:
    """doc_id as two columns without nulls, for joins."""
    return [F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id")]


def dedup_similar(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, with all columns of ``docs``, whatever those are called: the smallest doc_id, null last, then the smallest digest.

    Most rows stay and are the only ones with their doc_id and text. Whole rows are
    shuffled where that isn't so, or where a Bloom filter can't tell, and no others.
    """
    own = ["none", "id", "digest"]
    rows = staged(similar_groups(docs).groupBy("doc_id", "digest", "root").agg(F.count("*").alias("n")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    kept = rows.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k.digest").alias("digest"))
    kept = kept.select(*row_key("doc_id"), "digest", F.lit(True).alias("kept"))
    doubtful = rows.select(*row_key("doc_id"), "digest", "n").join(kept, own, "left").where("kept is null or n > 1")
    doubtful = staged(doubtful.select(F.xxhash64(*own).alias("h"), *own, F.coalesce("kept", F.lit(False)).alias("kept")), "doubtful")
    keyed = docs.select(whole_row(docs), *row_key("doc_id"), F.xxhash64("text").alias("digest")).withColumn("h", F.xxhash64(*own))
    told = marked(keyed, doubtful.select("h"), "h")
    rest = told.where("_possible").join(doubtful.drop("h"), own, "left").where("kept is null or kept").dropDuplicates(own)
    return told.where("not _possible").select("row.*").unionByName(rest.select("row.*"))


def op3_simhash_vptree(spark, sf_dir):
    """Near-duplicate groups of the whole documents table."""
    from tidemark.llm.common import table

    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
