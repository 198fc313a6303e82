import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import onebit_search as O


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            scores = [(-float((w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), j) for j, w in good if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def compare(got, want):
    """Recall, with ranks and scores checked."""
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert by.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        mine = by.get(q, [])
        assert [r for r, _, _ in mine] == list(range(1, len(w) + 1))
        true = dict(w)
        hits += sum(j in true for _, j, _ in mine)
        total += len(w)
        for _, j, s in mine:
            assert j not in true or abs(true[j] - s) < 1e-12
    return hits / total


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert compare(O.op1_onebit_search(spark, d).collect(), brute(rows)) > 0.99


def test_bound_holds_and_prunes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    turn, centre = O.rotation(64), np.full(64, 0.01)
    assert np.allclose(turn @ turn.T, np.eye(64))
    code, length, match, product = O.codes(x, centre, turn)
    import pandas as pd

    cell = O.Cell(pd.DataFrame({"vec_id": np.arange(3000), "vector": list(x), "code": [c.tobytes() for c in code], "length": length, "match": match, "centre": product}), centre, turn, O.BOUND)
    asked = []
    plain = cell.exact
    cell.exact = lambda at, q, n: (asked.append(len(at)), plain(at, q, n))[1]
    for i, ids, score in cell.nearest(x[:20], 6):
        true = O.units(x) @ O.units(x[i : i + 1])[0]
        assert ids[0] == i and abs(score[0] - 1) < 1e-12
        assert len(set(ids) & set(np.argsort(-true)[:6])) >= 5
    assert sum(asked) < 0.6 * 20 * 3000


def test_copies_ties_and_unusable_rows(spark):
    v = [1.0, 2.0, 0.5, -1.0]
    rows = [(i, v) for i in range(0, 400)] + [(1000 + i, [float(i), 1.0, -2.0, 0.25]) for i in range(50)]
    rows += [(450, None), (500, [0.0] * 4), (550, [1.0, None, 2.0, 1.0]), (600, [float("nan"), 1.0, 1.0, 1.0]), (650, [float("inf"), 1.0, 1.0, 1.0]), (2000, [2.0, 4.0, 1.0, -2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, query string")
    df = df.unionByName(spark.createDataFrame([(None, v, "x"), (700, [1.0], "x"), (0, v, "x")], df.schema))
    got = O.neighbours(df, F.col("vec_id") % 50 == 0)
    assert compare(got.collect(), brute(rows)) == 1.0
    first = [r.vec_id for r in got.where("query_id = 50").orderBy("rank").collect()]
    assert first == [0, 1, 2, 3, 4]


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in O.neighbours(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.0)]
    assert O.neighbours(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert O.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
    odd = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3), -1.0, 2.0 + i, 0.1, 0.2, 0.3, float(i % 11)]) for i in range(200)], "vec_id long, embedding array<float>")
    assert O.neighbours(odd, F.col("vec_id") % 50 == 0).count() == 20


def test_estimates_and_their_bound():
    rng = np.random.default_rng(5)
    for d in (9, 64, 100):
        x = rng.standard_normal((2000, d)) + 0.3
        turn, centre = O.rotation(d), O.units(x[:500]).mean(axis=0)
        code, length, match, product = O.codes(x, centre, turn)
        import pandas as pd

        cell = O.Cell(pd.DataFrame({"vec_id": np.arange(2000), "vector": list(x), "code": [c.tobytes() for c in code], "length": length, "match": match, "centre": product}), centre, turn, O.BOUND)
        assert cell.words.nbytes == 2000 * 8 * (-(-d // 64))
        query = O.units(rng.standard_normal((1, d)) + 0.3)[0]
        estimate, off = cell.estimate(query)
        signs = np.where((O.units(x) - centre) @ turn >= 0, 1, -1) / np.sqrt(d)
        plain = length / match * (signs @ ((query - centre) @ turn)) + product + query @ centre - centre @ centre
        assert (np.abs(estimate - plain) <= off + 1e-12).all() and np.abs(estimate - plain).max() < 0.02
        assert (np.abs(estimate - O.units(x) @ query) <= off).mean() > 0.97


def test_doubles_stay_doubles_and_ties(spark):
    near = [(i, [1.0, 1e-12 * (i % 3), 0.5]) for i in range(12)] + [(50 + i, [1.0, 0.25, float(i)]) for i in range(3)]
    df = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    assert O.usable(df).schema["vector"].dataType.simpleString() == "array<double>"
    got = O.neighbours(df, F.col("vec_id") % 50 == 0)
    assert compare(got.collect(), brute(near)) == 1.0


def test_ties_between_different_vectors(spark):
    """Multiples of a vector by powers of two have the same cosine to the last bit: the smaller ids are nearer."""
    draw = np.random.default_rng(5)
    v = draw.standard_normal(32).astype(np.float32)
    rows = [(i, draw.standard_normal(32).astype(np.float32).tolist()) for i in range(1, 60)]
    rows += [(100 + i, (v * np.float32(2.0 ** (i % 7 - 3))).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = O.neighbours(df, F.col("vec_id") % 50 == 0).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [101, 102, 103, 104, 105]
    assert len({r.score for r in got}) == 1
