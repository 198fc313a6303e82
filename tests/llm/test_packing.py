from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as K


def brute_force(pieces, lengths, overhead, policies=None):
    """The same rules without any index: all policies (None: by outlook), scanning all pieces and bins."""

    def outlook(i, size):
        held = pieces[i]
        for p in pieces[i + 1 :]:
            held += p if held + p <= size else 0
        return (min(n for n in lengths if n >= held) + overhead) / max(1, held)

    best = None
    for policy in (None, *sorted(lengths, reverse=True)) if policies is None else policies:
        bins = []
        for i, p in enumerate(pieces):
            fits = [b for b in bins if b[0] - b[1] >= p and b[0] > b[1]]
            if fits:
                min(fits, key=lambda b: b[0] - b[1])[1] += p
            else:
                able = [n for n in sorted(lengths) if n >= p]
                size = min(able, key=lambda n: (outlook(i, n), -n)) if policy is None else min(n for n in able if n >= policy)
                bins.append([size, p])
        total = sum(min(n for n in lengths if n >= used) + overhead for _, used in bins)
        best = total if best is None else min(best, total)
    return best


def optimum(pieces, lengths, overhead):
    """The least cost of all ways to divide the pieces."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(pieces):
            best[0] = min(best[0], sum(min(n for n in lengths if n >= b) + overhead for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + pieces[i] <= max(lengths):
                place(i + 1, [*bins[:k], bins[k] + pieces[i], *bins[k + 1 :]])
        place(i + 1, [*bins, pieces[i]])

    place(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=6), st.sampled_from([(10, 25, 100), (100,), (50, 60, 100)]), st.sampled_from([0, 3, 40]))
def test_cost_near_the_optimum(pieces, lengths, overhead):
    pieces = sorted(pieces, reverse=True)
    _, final = K.pack_block(pieces, lengths, overhead)
    assert int(final.sum()) + overhead * len(final) <= 1.5 * optimum(pieces, lengths, overhead)


def test_mixed_lengths_beat_any_one_length():
    rng = np.random.default_rng(3)
    pieces = sorted([*rng.integers(985, 1001, 300).tolist(), *rng.integers(840, 851, 300).tolist()], reverse=True)
    where, opened = K.best_fit(pieces, [1000, 1700, 4000], None, K.OVERHEAD)
    assert len(set(opened)) > 1
    filled = np.bincount(where, pieces, len(opened))
    lengths = np.array([1000, 1700, 4000])
    joint = int((lengths[np.searchsorted(lengths, filled)] + K.OVERHEAD).sum())
    assert joint < brute_force(pieces, (1000, 1700, 4000), K.OVERHEAD, policies=(4000, 1700, 1000))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40), st.sampled_from([(10, 25, 100), (100,), (50, 60, 100)]), st.sampled_from([0, 3, 40]))
def test_cost_like_brute_force(pieces, lengths, overhead):
    pieces = sorted(pieces, reverse=True)
    where, final = K.pack_block(pieces, lengths, overhead)
    filled = np.bincount(where, pieces, len(final)) if pieces else np.zeros(0)
    assert len(where) == len(pieces) and (filled <= final).all()
    assert all(f == min(n for n in lengths if n >= x) for f, x in zip(final, filled, strict=True))
    total = int(final.sum()) + overhead * len(final)
    assert total == brute_force(pieces, lengths, overhead) <= brute_force(pieces, lengths, overhead, policies=lengths) if pieces else not total


def whole(rows, texts):
    """Checks that pieces cover the documents and bins hold their pieces apart."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        bins[r.bin].append((r.bin_offset, r.length, r.bin_length))
    assert docs.keys() == texts.keys()
    for d, parts in docs.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(texts[d] or "")
    for parts in bins.values():
        at = 0
        for offset, n, size in sorted(parts):
            assert offset >= at
            at = offset + n
        assert at <= size and all(s < at for s in K.LENGTHS if s < parts[0][2])
    return sum(len(t or "") for t in texts.values()) / sum(p[0][2] for p in bins.values())


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert whole(K.op2_packing(spark, d).collect(), texts) > 0.9


@pytest.mark.parametrize("block", [3, 1000])
def test_edges_of_the_input(spark, block):
    texts = {1: None, 2: "", 3: "x" * 50_000, 4: "y", 5: "z" * 16384, 6: "ab" * 700}
    docs = spark.createDataFrame([(k, v, "q") for k, v in texts.items()], "doc_id long, text string, bin string")
    assert whole(K.pack(docs, block=block).collect(), texts) > 0.5
    assert K.pack(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, "abc"), (7, "abc"), (None, "d")], "doc_id long, text string")
    assert K.pack(twice).count() == 3


@pytest.mark.parametrize("doc_id", [None, 7])
def test_one_id_in_very_many_rows_is_dealt_to_several_tasks(spark, doc_id):
    docs = spark.range(100_000).selectExpr(f"cast({doc_id or 'null'} as bigint) as doc_id", "repeat(cast(id as string), 1 + id % 5) as text", "cast(id as string) as salt", "map(1, id) as other")
    rows = K.pack(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert rows.columns == ["doc_id", "piece", "start", "length", "bin", "bin_length", "bin_offset"]
    try:
        tasks = rows.selectExpr("split(bin, '-')[0] as task").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(t["count"] for t in tasks) == 100_000 and len(tasks) >= 4 and max(t["count"] for t in tasks) < 50_000
