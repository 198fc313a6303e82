import zlib
from hashlib import sha256

import duckdb
import pandas as pd
import pytest

from tidemark.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, tree string, hash string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def frame(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*[frame(x) for x in (doc_id, source, lang, n_chars, text)])


def folded_up(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        run = level[start : start + 16]
        out.append((run[: i - start], run[i - start + 1 :]))
        i //= 16
    return out


def by_hand(rows):
    """Sorted rows of the result; rows are (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s], key=lambda x: x[:3]) for s in names}
    levels = {s: folded_up([x[2] for x in trees[s]]) for s in names}
    over = folded_up([levels[s][-1][0] for s in names])
    root, out = over[-1][0], []
    for place, s in enumerate(names):
        above = siblings(over, place)
        for i, (_, _, leaf, row) in enumerate(trees[s]):
            path = siblings(levels[s], i) + above
            at = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                at = leaf_of(row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            for left, right in path:
                at = digest(*left, at, *right)
            out.append((row[0], leaf, levels[s][-1][0], root, digest(*[x for pair in path for side in pair for x in side]), at, at == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = pd.read_parquet(f"{d}/documents.parquet")[["doc_id", "text", "lang", "source", "n_chars"]].astype(object)
    want = by_hand([tuple(None if pd.isna(x) else x for x in r) for r in rows.itertuples(index=False)])
    got = result(M.op12_merkle_manifest(spark, d))
    assert got == want
    assert {r[6] for r in got} == {True, False}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert sorted(con.execute(M.oracle()).fetchall(), key=str) == want


def small(n, source, start=0):
    return [(start + i, f"Text {i}", "en", source, i) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        small(1, "one"),
        small(1, None),
        small(16, "a") + small(17, "b", 100) + small(1, "c", 200) + small(2, None, 300),
        [(None, None, None, None, None)] * 3 + [(None, "X", "", "", None)] * 18 + [(5, "É TEXT Z", None, "é", 2**60), (2**62 + 1, "", "x", "é", 0), (5, "É TEXT Z", None, "é", 2**60), (-7, "Ab" * 100_000, "x", "Z", 3)],
        [row for i in range(40) for row in small(1 + i % 3, f"s{i}", 10 * i)],
    ],
)
def test_odd_tables(spark, rows):
    """Lone leaves and runs of one; nulls, repeated rows and ids, empty and long texts, many sources; columns with the log's names."""
    docs = spark.createDataFrame([(*r, 1, "t", "h") for r in rows], SCHEMA)
    assert result(M.all_proofs(docs)) == by_hand(rows)


def test_empty_table(spark):
    assert M.all_proofs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages_of_tall_trees(spark):
    """With builders of one level, trees of a few hundred leaves go through several stages; the log is in completion order."""
    rows = small(600, "big") + small(256, "even", 1000) + small(257, "odd", 2000) + small(16, "low", 3000)
    docs = spark.createDataFrame([(*r, 1, "t", "h") for r in rows], SCHEMA)
    assert result(M.all_proofs(docs, 1)) == by_hand(rows)
    made = M.manifest(docs, 1)
    assert len(made.stages) == 3
    for tree, n in (("sbig", 600), ("seven", 256), ("sodd", 257), ("slow", 16)):
        log = [(r.position, r.level, r.hash) for r in M.log_of(made.stages).where(f"tree = '{tree}'").collect()]
        leaves = sorted(x for x in rows if f"s{x[3]}" == tree)
        want, levels = [], folded_up([leaf_of(*r) for r in leaves])
        for i in range(n):
            want.append((0, levels[0][i]))
            for level in range(1, len(levels)):
                if (i + 1) % 16**level == 0 or i == n - 1:
                    want.append((level, levels[level][i // 16**level]))
        assert [x[1:] for x in sorted(log)] == want and [x[0] for x in sorted(log)] == list(range(len(want)))
