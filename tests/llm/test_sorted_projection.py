import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import sorted_projection as P


def by_hand(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows, from all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for size in {len(rows[i][1]) for i in good}:
        some = [i for i in good if len(rows[i][1]) == size]
        v = np.array([rows[i][1] for i in some], np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        near = v @ v.T / norm[:, None] / norm >= cosine
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near), strict=True):
            links[some[a]] += 1
            root[max(find(some[a]), find(some[b]))] = min(find(some[a]), find(some[b]))
    ids = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            ids[find(i)] = min(ids.get(find(i), vec_id), vec_id)
    return sorted(((vec_id, links[i], c := ids.get(find(i)), vec_id == c) for i, (vec_id, _) in enumerate(rows)), key=str)


def result(df):
    assert df.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted(map(tuple, df.collect()), key=str)


def near(rng, centre, cosine, n):
    """n vectors at the given cosine to a centre, of any length."""
    side = rng.standard_normal((n, len(centre)))
    side -= (side @ centre)[:, None] * centre / (centre @ centre)
    side /= np.linalg.norm(side, axis=1)[:, None]
    unit = centre / np.linalg.norm(centre)
    return (cosine * unit + math.sqrt(1 - cosine**2) * side) * rng.uniform(0.1, 50, n)[:, None]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    table = pd.read_parquet(f"{d}/embeddings.parquet")
    assert result(P.op11_sorted_projection(spark, d)) == by_hand(list(zip(table["vec_id"].tolist(), table["embedding"], strict=True)))


def test_groups_of_all_sizes_and_cosines(spark):
    """Pairs just above and below the cosine, groups wider than a window, and one of 700 in tiles whose angles settle some pairs and leave others."""
    rng = np.random.default_rng(5)
    parts = [rng.standard_normal((1500, 32))]
    for size, cosine in [(2, 0.975)] * 60 + [(2, 0.973)] * 30 + [(12, 0.98)] * 10 + [(90, 0.985)] * 3:
        parts.append(near(rng, rng.standard_normal(32), cosine, size))
    hot = rng.standard_normal(32)
    parts += [near(rng, hot, c, 140) for c in (0.999, 0.99, 0.977, 0.965, 0.95)]
    v = rng.permutation(np.concatenate(parts)).astype(np.float32)
    rows = list(zip((rng.permutation(len(v)) * 3).tolist(), v.tolist(), strict=True))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = by_hand(rows)
    assert result(P.linked(frame, window=32, tile=64)) == want
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841  read by DuckDB
    assert sorted(duckdb.sql(P.oracle()).fetchall(), key=str) == want
    assert max(r[1] for r in want) > 400 and sum(r[1] == 1 for r in want) > 60


def test_tiles_settled_and_left_to_compare(spark):
    limit = math.acos(0.95)
    rows = [(7, t, 10, limit * t / 6, limit * (t + 0.9) / 6) for t in range(12)]
    plan = P.tile_plan(spark.createDataFrame(rows, "root long, tile long, weight long, low double, high double"), 0.95).collect()
    sure = {r.i: r.sure for r in plan if r.j is None}
    compared = {(r.i, r.j) for r in plan if r.j is not None}
    for i in range(12):
        assert sure[i] == 10 * sum(i + j + 1.8 <= 6 for j in range(12))
        assert {j for j in range(i, 12) if (i, j) in compared} == {j for j in range(i, 12) if i + j + 1.8 > 6 and j - (i + 0.9) <= 6}


ODD = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (None, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]),
    (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.01, 0.0]), (12, [-1.0, 0.0]), (13, [0.0, 1.0]), (None, [0.0, -1.0]), (13, [0.5, 0.5]), (None, None),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_vectors(spark, kind):
    """Nulls, zeros, repeats, ids that repeat or are null, several lengths, columns with the operator's names."""
    frame = spark.createDataFrame([(*r, 1, 2) for r in ODD], f"vec_id long, embedding array<{kind}>, node int, root int")
    want = by_hand([(i, None if v is None else v) for i, v in ODD])
    got = result(P.linked(frame))
    fixed = sorted(((a, b, c, True if a is None and c is None else d) for a, b, c, d in want), key=str)
    assert got == fixed
    assert P.linked(frame.limit(0)).collect() == []


def test_many_exact_copies_are_one_node(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(5000)] + [(9000 + i, [1.0, 2.0, 3.0 + i / 1000]) for i in range(5)]
    got = result(P.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert all(n == 5004 and c == 0 for _, n, c, _ in got) and sum(r[3] for r in got) == 1


def test_passes_grow_slowly():
    assert P.passes_for(10) == P.passes_for(128) == 1
    assert 10 < P.passes_for(50_000) < 30 < P.passes_for(10**9) < 200
