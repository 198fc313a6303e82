import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(library, texts):
    words = B.vocabulary(PATH)
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert words.decode(ids, words.offsets(ids)) == text.encode()


ALPHABET = st.sampled_from(list("aZé中1²٣ \t\n\r\x1c\x85\xa0　'sdmtrevlL!-_.\U0001f600́$#"))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(ALPHABET, max_size=40), max_size=5))
def test_like_the_library(library, texts):
    same(library, texts)


def test_corner_cases(library):
    same(library, ["", "'", "''s", "'s's", " 's", "a's b'll c'lll 're've", "  'tis", "a  b", "a \n b", "\n\n a", "a   ", "<|endoftext|>", "'r", "'l", "don't'"])
    same(library, ["a" * 5000, "ab" * 3000 + " " * 300 + "x", "é" * 999, "zq" * 40, "9" * 700])


def test_code_points(library):
    points = [c for c in (*range(0, 0x3000), *range(0xA000, 0x110000, 89), 0x1C89, 0xA7DC, 0x105C0, 0x18CFF, 0x1CCF0) if not 0xD800 <= c < 0xE000]
    same(library, [f"a{chr(c)}1 {chr(c)}{chr(c)}'s{chr(c)} ." for c in points])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50])
def test_many_short_texts(library, n):
    same(library, ["x" * (i % 5) + " it's" * (i % 3) for i in range(n)])


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in B.op10_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_edges_of_the_input(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "it's", "z")], "doc_id long, text string, ids string")
    rows = B.decode(B.encode(docs)).collect()
    assert [bytes(r.decoded) for r in rows] == [b"", b"", b"it's"] and [len(r.ids) for r in rows][:2] == [0, 0]
    assert B.encode(docs.limit(0)).count() == 0
