import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from tidemark.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_by_hand(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts, factor=5):
    """Words that share a pattern (a letter deleted or blanked out) are compared one by one."""
    groups = defaultdict(set)
    for w in counts:
        groups[w].add(w)
        for i in range(len(w)):
            groups[w[:i] + w[i + 1 :]].add(w)
            groups[f"{w[:i]}\0{w[i + 1 :]}"].add(w)
    near = defaultdict(set)
    for some in groups.values():
        for a in some:
            near[a] |= {b for b in some if b not in near[a] and one_edit(a, b)}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda b: (-counts[b], b), default=None)
        if best is not None and counts[best] >= factor * counts[w]:
            form[w] = best
    rows = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows[w] = (form.get(w), root, n, len(near[w]), counts.get(form.get(w)))
    return rows


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{d}/documents.parquet")
    want = variants_by_hand(words_by_hand(zip(docs["doc_id"], docs["text"], strict=True)))
    got = result(S.op13_spelling_variants(spark, d))
    assert got == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.execute(S.oracle()).fetchall()} == want
    assert any(form for form, *_ in got.values()) and any(root != form for form, root, *_ in got.values() if form)


ODD = {
    "letter": 500, "lettre": 40, "leter": 9, "lettter": 20, "letters": 90, "bletter": 5, "lettee": 100, "lettez": 100,
    "aaaaaa": 7, "aaaaaaa": 40, "aaaaaaaa": 300, "écoleé": 50, "écoleE": 5, "Écoleé": 6, "ecoleé": 5, "×÷ÿÀaa": 8,
    "x" * 3000: 25, "x" * 2999: 5, "x" * 1500 + "y" + "x" * 1499: 5, "lonely": 5,
}


@pytest.mark.parametrize("round_blocks", [2**19, 1])
def test_odd_words(spark, monkeypatch, round_blocks):
    """Repeated letters, ends, accents, ties, very long words; with filters in one round or in several with parts."""
    counts = {w: n for w, n in ODD.items() if w not in ("leter", "écoleE")} | {"leterr": 9}
    if round_blocks == 1:
        monkeypatch.setattr(S, "BLOCK_WORDS", 2)
        vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
        shards = S.shards_of(vocab, 1)
        assert len(shards) > 5 and any(s.parts > 1 for some in shards for s in some)
    vocab = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, root int")
    got = result(S.variants(vocab, round_blocks=round_blocks))
    assert got == variants_by_hand(counts)
    assert got["aaaaaa"][:2] == ("aaaaaaa", "aaaaaaaa") and got["lonely"] == (None, "lonely", 5, 0, None)


def test_texts_with_nulls_slips_and_copies(spark):
    slips = [(i, "variant") for i in range(4000)]  # about twenty lose a letter
    docs = [(None, "UPPERCASE ÉTÉETUDE"), (None, "uppercase"), (1, None), (2, ""), (3, "a1b2 short"), (4, "word-break word_break wordbreak " * 5), (5, "Über×÷mut " * 6), *slips, *[(7, "UPPERCASE x uppercasE")] * 3]
    frame = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, word string")
    vocab = S.vocabulary(S.occurrences(frame))
    assert {r.word: r.n for r in vocab.collect()} == words_by_hand(docs)
    assert result(S.variants(vocab)) == variants_by_hand(words_by_hand(docs))
    assert S.variants(S.vocabulary(S.occurrences(frame.limit(0)))).collect() == []


def test_filters_let_every_word_through_and_few_others(spark):
    words = [f"{a}{b}{c}word" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    [shards] = S.shards_of(vocab, S.ROUND_BLOCKS)
    [bits] = S.filters(vocab, shards).values()
    assert len(S.passing(S.hashes_of(S.spelled(words, 7)), bits)) == len(words)
    others = [f"{i:07d}" for i in range(50_000)]
    assert len(S.passing(S.hashes_of(S.spelled(others, 7)), bits)) < 250
