import duckdb

from tidemark.llm import url_filter as U

COLUMNS = ["page_id", "host", "path", "rule", "verdict", "listed"]


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, U.op7_url_filter(spark, d).select(COLUMNS).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({U.oracle()})").fetchall(), key=str)
    assert sorted(got, key=str) == want
    assert {r[4] for r in got} == {"allow", "block"} and any(r[5] for r in got)


def test_rules_and_list(spark):
    urls = [None, "no scheme", "http://EXAMPLE.org/es/x", "http://a.example.org/en/12", "http://badexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de", "http://b.net/p/?utm_a=1&z=2&a=1#f", "https://www.b.net/p?a=1&z=2", "http://b.net/p", "http://a.org", "x://É.ORG/", "http://h.net?q=://x.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'old' as host", "1 as listed")
    listed = spark.createDataFrame([("b.net/p?a=1&z=2",), ("b.net/p?a=1&z=2",), (None,), ("",), ("x.com/fr/1",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("example.org", "/es/x", "example.org/es/", "block"),
        3: ("a.example.org", "/en/12", "example.org/en/1", "block"),
        4: ("badexample.org", "/es/", "org/", "allow"),
        5: ("x.com", "/fr/1", "com/fr/", "allow"),
        6: ("x.com", "/de/1", "com/de/", "block"),
        7: ("com", "/de", None, "allow"),
        8: ("b.net", "/p/", None, "block"),
        9: ("www.b.net", "/p", None, "block"),
        10: ("b.net", "/p", None, "allow"),
        11: ("a.org", "", None, "allow"),
        12: ("É.org", "/", "org/", "allow"),
        13: ("h.net", "", None, "allow"),
    }


def test_full_filter_stays_exact(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h.net/', id) as url")
    listed = spark.range(0, 3000, 3).selectExpr("concat('h.net/', id) as canonical")
    rows = U.judge(pages, listed, max_blocks=1).collect()
    assert len(rows) == 3000 and all(r.listed == (r.page_id % 3 == 0) for r in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "canonical string")
    assert U.judge(pages, none).first().verdict == "allow"
    assert U.judge(pages.limit(0), none).count() == 0
