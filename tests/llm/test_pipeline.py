from collections import defaultdict

import pytest

import corpus_pipeline as C
from tests.llm.test_packing import whole
from tests.llm.test_pii import brute
from tests.llm.test_simhash_vptree import brute_similar
from tidemark.llm import pii, toxicity


def test_run_and_empty_tables(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    assert C.run(spark, d).count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(i, f"document number {'abcdefghij'[i]} says {'klmnopqrst'[i]} of {'uvwxyzabcd'[i]} things", "en", "s", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(100, 1)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.count() == 10
    sizes = defaultdict(int)
    for r in C.packing_stage(spark, kept, "").collect():
        sizes[r.doc_id] += r.length
    assert len(sizes) == 10


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, spans string"
    rows = [(1, None, None, None, None, 5, "x"), (2, "", "en", "s", 0, 5, "x"), (None, "call +1 (017) 555-7713 now or never", "en", "s", 9, 5, "x"), (3, "a b c d e f", "en", "s", 11, 5, "x"), (3, "a b c d e f", "en", "s", 11, 5, "x"), (4, "word " * 30_000, "en", "s", 150_000, 5, "x")]
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(3, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 6
    groups = C.near_dedup_stage(spark, kept, "")
    assert groups.columns == docs.columns and sorted((r.doc_id for r in groups.collect()), key=str) == [1, 3, 4, None]
    clean = C.pii_stage(spark, groups, "")
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()}[None] == "call [PHONE] now or never"
    packed = C.packing_stage(spark, clean, "")
    assert packed.groupBy("doc_id").count().count() == 4 and packed.where("doc_id = 4").count() == 10


@pytest.mark.parametrize("number", range(4))
def test_columns_with_the_stages_own_names(spark, number):
    """Columns of any name come out as they went in; packing says what it returns."""
    names = "root _id id _digest digest _spans spans _terms terms _toxicity score _kept_id kept_id kept_digest row key fp cluster".split()
    own = {3: "call +1 (017) 555-7713 now or never", 4: "mail a.person@mail.example and more words here", 5: "six words that have no copy", 6: None}
    rows = [(i, text, "en", "s", len(text or ""), *[f"{n}-{i}" for n in names]) for i, text in own.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    if number == 0:
        out = toxicity.without_toxic(docs, spark.createDataFrame([(3, 0), (4, 1)], "doc_id long, toxic int"))
    else:
        out = C.STAGES[number][1](spark, docs, "")
    if number == 3:
        assert out.groupBy("doc_id").count().count() == 4
        return
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == own.keys() and all(r[n] == f"{n}-{i}" for i, r in got.items() for n in names)
    changed = {3: "call [PHONE] now or never", 4: "mail [EMAIL] and more words here"} if number == 2 else {}
    assert {i: r.text for i, r in got.items()} == own | changed


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = [r for r in sorted(docs.collect()) if model.score(r.text) < toxicity.THRESHOLD]
    want = {want[g[0]].doc_id: want[g[0]] for g in brute_similar([r.text for r in want])}
    for name, stage in C.STAGES[:3]:
        docs = C.staged(stage(spark, docs, d), name)
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows.keys() == want.keys()
    for i, r in rows.items():
        spans = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in brute(want[i].text)]
        assert r.text == pii.sanitised(want[i].text, spans, []) or "[WORD]" in r.text or spans
        assert r.n_chars == len(r.text) and not brute(r.text)
    assert whole(C.STAGES[3][1](spark, docs, d).collect(), {i: r.text for i, r in rows.items()}) > 0.8
