"""Every registered query of the library against its SQL in DuckDB."""

import duckdb
import pytest

from tidemark.plans import round_trips  # noqa: F401  registers its queries
from tidemark.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(sf_dir).execute(SQL[name])
    want_names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert names == want_names
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w) if any(isinstance(x, float) for x in g) else g == w
    assert got, "the query has no rows"


def test_all_have_sql():
    assert set(QUERIES) - set(SQL) == set()
