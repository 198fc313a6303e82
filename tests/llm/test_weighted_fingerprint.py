import hashlib
from collections import Counter

import pytest

from tidemark.llm import weighted_fingerprint as G


def brute_edits(rows):
    """rows of different ids, to {id: (edited text, next id)}"""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (d, t) in enumerate(order):
        n, (after, text) = len(t or ""), order[(i + 1) % len(order)]
        out[d] = ((t or "")[: n - n // 2] + (text or "")[: n // 2], after)
    return out


def similarity(a, b):
    a, b = (Counter(w for w in t.lower().replace("\t", " ").replace("\n", " ").split(" ") if w) for t in (a, b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) * len(k) for k in keys) / max(1, sum(max(a[k], b[k]) * len(k) for k in keys))


@pytest.fixture(scope="module")
def results(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    return docs, {r.doc_id: r for r in G.op4_weighted_fingerprint(spark, d).collect()}


def test_query(results):
    docs, got = results
    edits = brute_edits(list(docs.items()))
    assert got.keys() == docs.keys()
    errors = []
    for d, text in docs.items():
        edited, after = edits[d]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and len(r.fingerprint) == 8 * G.SAMPLES
        same = [r.fingerprint[i : i + 8] == got[after].fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)]
        assert r.near_next == sum(same) / G.SAMPLES
        errors += [r.near_edited - similarity(text, edited), r.near_next - similarity(text, docs[after])]
    # samples collide at the rate of the generalised Jaccard similarity
    assert abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.08


def test_equal_texts(results):
    docs, got = results
    by_text = {}
    for d, text in docs.items():
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_rate_of_collisions(spark):
    pairs = [("a a a bb cc dd", "a bb bb ee"), ("x y z", "x y z q q q q"), ("one two", "three four")]
    df = spark.createDataFrame([(i, j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "a long, b long, text string")
    sig = {(r.a, r.b): r.sig for r in G.fingerprints(df, ["a", "b"], samples=400).collect()}
    for i, (x, y) in enumerate(pairs):
        rate = sum(p == q for p, q in zip(sig[i, 0], sig[i, 1], strict=True)) / 400
        assert abs(rate - similarity(x, y)) < 0.09


def test_edges_of_the_input(spark):
    rows = [(5, None), (3, ""), (9, "a b c d"), (None, "é中 x" * 3), (-4, "one\ttwo\nthree  four")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in G.edited_fingerprints(docs).collect()}
    for d, (edited, _) in brute_edits(rows).items():
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[5].near_next == 1.0 and got[5].near_edited == 1.0 and got[9].near_next == 0.0
    assert G.edited_fingerprints(docs.limit(0)).count() == 0
    one = G.edited_fingerprints(docs.where("doc_id = 9")).first()
    assert one.near_next == 1.0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d e f g")], "doc_id long, text string")
    assert G.edited_fingerprints(twice).count() == 4


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = G.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, long), (2, "a b"), (3, long + " w1")]
    got = {r.doc_id: r for r in G.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, (edited, _) in brute_edits(rows).items():
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[d].near_edited - similarity(dict(rows)[d], edited)) < 0.3
    assert got[1].n_chars == len(long) and got[3].near_next == 0.0
