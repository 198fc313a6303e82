import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_records as R
from tidemark.llm.common import scratch

PATH = public_tokenizers.path(R.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(texts):
    return [np.frombuffer(x, "<u2").tolist() for part in R.words(PATH).encode_all(pa.array(texts, pa.string())) for x in part.to_pylist()]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("aZéÉΣς中1²٣ \t\n\r\x1c\x85\xa0　'sdmtrevl!-_.\U0001f600́İ<|endoftx>")), max_size=30), min_size=1, max_size=4))
def test_words_encode_as_texts(library, texts):
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_special_strings(library):
    for text in ("a<|endoftext|>b", "<|startoftext|> x", "<|ENDOFTEXT|>", "T\u0308 t\u0308, E\u0301.", "a|b | c", "x" * 500 + " it's"):
        assert encoded([text]) == [[*library.encode(text, add_special_tokens=False).ids, 2]]


def test_query(spark, library):
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: r for r in R.op9_token_records(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(5, None, "x"), (5, "a b", "y"), (None, "it's", "z"), (-1, "", "")], "doc_id long, text string, start string")
    records = R.read_records(spark, R.write_records(docs, scratch(spark, "t")), records_a_task=1).orderBy("start").collect()
    assert [r.doc_id for r in records] == [None, -1, 5, 5]
    assert sum(len(r.ids) // 4 for r in records[:-1]) == records[-1].start
    assert R.read_records(spark, R.write_records(docs.limit(0), scratch(spark, "t"))).count() == 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(5)], "doc_id long, text string")
    row = R.write_records(docs, f"file://{tmp_path}/d").first()
    assert [x[0] for x in R.read_file(row.path, 0, row.records)] == sorted(x[0] for x in R.read_file(row.path, 0, row.records))
    file = row.path.removeprefix("file://") + ".ids"
    data = bytearray(open(file, "rb").read())
    data[-6] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(R.read_file(row.path, 0, row.records))


def test_many_chunks_and_a_full_cache(library, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 40)
    monkeypatch.setattr(R, "CACHE", 12)
    R.words.cache_clear()
    texts = [f"Word{i % 7}, number {i} of {'x' * (i % 60)}!" for i in range(120)] + ["", "long " * 3000]
    assert encoded(texts) == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert encoded([]) == []
    R.words.cache_clear()


def test_files_in_order_of_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_A_FILE", 10)
    ids = [None] * 30 + [7] * 40 + list(range(-20, 30))
    docs = spark.createDataFrame([(x, f"text {i % 35}", "y") for i, x in enumerate(ids)], "doc_id long, text string, ids string")
    manifest = R.write_records(docs, scratch(spark, "t"))
    assert manifest.count() > 8 and manifest.agg({"records": "max"}).first()[0] < 40
    rows = R.read_records(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows][1:] == np.cumsum([len(r.ids) // 4 for r in rows])[:-1].tolist()


def test_records_in_any_order(spark):
    docs = spark.createDataFrame([(i, "" if i % 9 == 0 else f"text {i} " * (i % 5 + 1)) for i in range(200)] + [(500, "very long " * 40_000)], "doc_id long, text string")
    manifest = R.write_records(docs, scratch(spark, "t"))
    row = manifest.where("records > 5").first()
    every = list(R.read_file(row.path, 0, row.records))
    order = np.random.default_rng(1).permutation(row.records)
    assert list(R.read_at(row.path, R.read_index(row.path)[order])) == [every[i] for i in order]
    want = {r.doc_id: r.ids for r in R.read_records(spark, manifest).collect()}
    orders = []
    for seed in (1, 2, 1):
        rows = R.read_shuffled(spark, manifest, seed, tasks=3).orderBy("task", "position").collect()
        assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want)
        assert [r.position for r in rows if r.task == 1] == list(range(sum(r.task == 1 for r in rows)))
        orders.append([r.doc_id for r in rows])
    assert orders[0] == orders[2] != orders[1] and orders[0] != sorted(want)
    assert R.read_shuffled(spark, manifest.limit(0), 1).count() == 0
