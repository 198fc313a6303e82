import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_vptree as S


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """rows: (doc_id, fp); smallest reachable id for each."""
    parent = {fp: fp for _, fp in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, fp in rows:
        if d is not None:
            least[root(fp)] = min(least.get(root(fp), d), d)
    return sorted(((d, fp, least.get(root(fp))) for d, fp in rows), key=str)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "a b c", "A b c D e f", "x " * 70000, "é\xa0È ü\x1c b c d", " a b c"])
def test_fingerprint(text):
    assert S.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_sql_function_agrees(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_links_match_brute_force(depth, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2048)
    rng = random.Random(depth)
    base = [rng.getrandbits(64) for _ in range(150)]
    values = set(base)
    for b in base[:80]:
        for _ in range(rng.randrange(1, 12)):
            for _ in range(rng.randrange(1, 5)):
                b ^= 1 << rng.randrange(64)
            values.add(b)
    values = np.array(sorted(values), dtype=np.uint64)
    at, shard, owner = S.route(values, S.fit_tree(values[::3], depth), 3)
    assert owner.sum() == len(values) and len(np.unique(at[owner])) == len(values)
    parent = {int(v): int(v) for v in values.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in np.unique(shard):
        mine = at[shard == k]
        for a, b in zip(*S.cell_links(values.view(np.int64)[mine], owner[shard == k], None), strict=True):
            a, b = sorted((root(int(a)), root(int(b))))
            parent[b] = a
    want = {}
    for d, fp, c in brute_groups([(i, int(v)) for i, v in enumerate(values)]):
        want.setdefault(c, set()).add(int(np.uint64(fp).view(np.int64)))
    got = {}
    for v in parent:
        got.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_groups(docs).collect()), key=str)
    want = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert got == want


def test_sharded_and_salted_cells(spark):
    rng = random.Random(5)
    base = rng.getrandbits(63)
    fps = {base}
    while len(fps) < 400:
        x = base
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(63)
        fps.add(x)
    fps |= {rng.getrandbits(63) for _ in range(200)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from tidemark.llm.graph import components

    edges = S.near_links(df, shard_rows=50, cell_rows=60)
    roots = {r.node: r.root for r in components(edges).collect()}
    got = sorted((i, x, None) for i, x in enumerate(sorted(fps)))
    want = brute_groups([(i, x) for i, x, _ in got])
    by_want, by_got = {}, {}
    for _, x, c in want:
        by_want.setdefault(c, set()).add(x)
    for x in fps:
        by_got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string, fp string, root int"
    rows = [(3, "same words here now", "x", 1), (1, "same words here now", "y", 2), (3, "same words here now", "z", 3), (7, None, None, None), (8, "", None, 4), (None, "other text of its own kind", "q", 5)]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.component_id) for r in S.near_groups(docs).collect()}
    assert got == {(3, 1), (1, 1), (7, 7), (8, 7), (None, None)}
    assert S.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["ascending", "mixed"])
def test_components_of_a_long_path(spark, monkeypatch, order):
    """Two paths of 10,000 nodes take a bounded number of rounds; a star with a large centre and a node of two components too."""
    from tidemark.llm import graph

    written = []
    monkeypatch.setattr(graph, "staged", lambda df, name, staged=graph.staged: written.append(name) or staged(df, name))
    place = list(range(10_000))
    if order == "mixed":
        random.Random(2).shuffle(place)
    paths = [(a + base, b + base) for base in (0, 50_000) for a, b in zip(place, place[1:], strict=False)]
    star = [(90_000 + i, 99_999) for i in range(200)]
    edges = spark.createDataFrame([*paths, *star, (7, 7), (99_999, 90_000)], "a long, b long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert {found[i] for i in range(10_000)} == {0} and {found[50_000 + i] for i in range(10_000)} == {50_000}
    assert {found[i] for i in (*range(90_000, 90_200), 99_999)} == {90_000} and len(found) == 20_201
    assert written.count("edges") <= (3 if order == "ascending" else 12) and written.count("labels") <= 40


def brute_similar(texts):
    """Groups of positions linked by Jaccard similarities of 5-word shingle sets of 0.8 or more."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("part_chars", [S.CLUSTER_CHARS, 3000])
def test_similar_groups_against_brute_force(spark, part_chars):
    rng = random.Random(8)
    texts = [None, "", " \n", "One two", "one  TWO", "a b c d e f"]
    for _ in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            edited = list(words)
            for _ in range(rng.randrange(1, 4)):
                edited[rng.randrange(len(edited))] = "new"
            texts.append(" ".join(edited[rng.randrange(4) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in S.similar_groups(docs, part_chars).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    want = brute_similar(texts)
    assert sorted(map(sorted, got.values())) == want
    kept = {r.doc_id for r in S.dedup_similar(docs).collect()}
    assert kept == {g[0] for g in want}
    assert len({c for _, _, c in brute_groups([(i, brute_fingerprint(t)) for i, t in enumerate(texts)])}) > len(want)  # 3 bits find fewer


def local_mb(spark):
    """MB of shuffle files and others that Spark holds on its local disk."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles())
    return sum(f.length() for f in files) / 1e6


def test_few_whole_rows_are_shuffled(spark, tmp_path):
    """Rows with a text of their own stay where they are: the disk holds no copy of the table while near copies go."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)), rng.randbytes(20_000)) for i in range(1000)]
    rows += [(1000 + i, rows[i][1] + " more", rows[i][2]) for i in range(20)] + rows[30:35]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload binary").repartition(8)
    docs.write.parquet(f"{tmp_path}/docs")
    docs, size = spark.read.parquet(f"{tmp_path}/docs"), sum(len(r[2]) for r in rows) / 1e6
    before = local_mb(spark)
    kept = S.dedup_similar(docs)
    built = local_mb(spark)
    kept.write.parquet(f"{tmp_path}/kept")
    assert max(built, local_mb(spark)) - before < size / 4
    got = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/kept").collect()}
    assert got.keys() == set(range(1000)) and spark.read.parquet(f"{tmp_path}/kept").count() == 1000
    assert all(got[i].payload == rows[i][2] for i in range(1000))


def test_staged_leaves_no_shuffle_files(spark):
    df = spark.range(300_000).withColumn("k", F.xxhash64("id")).groupBy("k").agg(F.max("id").alias("id"))
    before, was = local_mb(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert S.staged(df, "rows").count() == 300_000
    for _ in range(50):  # files go in the background
        if local_mb(spark) < before + 1:
            break
        time.sleep(0.1)
    assert local_mb(spark) < before + 1 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_shared_rows_against_brute_force(size):
    rng = random.Random(size)
    rows = [(h, d, d & 3 if h % 5 == 0 else -1) for h, d in ((rng.randrange(-60, 60), rng.randrange(-8, 8)) for _ in range(250))]
    rows += [(-(2**63), 1, -1), (2**63 - 1, 5, -1), (2**63 - 1, 6, -1)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[:2])
    batches = [pa.RecordBatch.from_pylist([dict(zip(("h", "digest", "salt"), r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
    batches.insert(1, batches[0].slice(0, 0))
    got = [tuple(r.values()) for b in S.shared_rows(iter(batches)) for r in b.to_pylist()]
    digests = {h: {d for g, d, _ in rows if g == h} for h, _, _ in rows}
    assert sorted(got) == sorted({(h, d) for h, d, salt in rows if salt >= 0 or len(digests[h]) > 1})
    assert list(S.shared_rows(iter([]))) == []


def test_common_shingles_and_repeated_rows(spark):
    """A passage that most texts share is common; near copies with little else are still found. Ids are texts here, one of them empty and one null."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(n))}" for n in [3] * 30 + [9] * 30 + [300] * 30]
    texts += [passage, passage, passage + " end", "of its own kind", None, "of its own kind"]
    ids = [f"{i:03}" for i in range(len(texts) - 2)] + ["", None]
    rows = [*zip(ids, texts, strict=True), (None, texts[-1]), (None, passage), (ids[70], texts[70]), (ids[70], texts[70])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    levels = S.levels_of(S.staged(S.read_sets(docs), "sets").where("tile is not null").select("tile", "counts"))
    assert S.prefix(passage, levels)[1].all() and not S.prefix("of its own kind", levels)[1].any()
    assert {r.salt >= 0 for r in S.prefixes(docs, levels).select("salt").distinct().collect()} == {True, False}
    groups = [{rows[i] for i in g} for g in brute_similar([r[1] for r in rows])]
    want = [min(g, key=lambda r: (r[0] is None, r[0] or ""))[0] for g in groups]
    got = S.dedup_similar(docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, want)) and {(r.doc_id, r.text) for r in got} <= set(rows)
