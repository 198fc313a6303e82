import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from(list("ab@.-_%+ 0123459()é\n٣")), max_size=60))
def test_spans_like_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_spans_of_known_values():
    for text in ("a@b.c.d@e.f", "@a.b@c.d x.@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "4111 1111 1111 1111-4111111111111111", "+1 (017) 555-7713.", "1" * 5000, "1." * 3000, "0001.2.3.004"):
        assert P.base_spans(text) == brute(text), text


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in P.op8_pii(spark, d).collect()}
    for doc in spark.read.parquet(f"{d}/documents.parquet").collect():
        want, r = brute(doc.text or ""), got[doc.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in PLAIN]


def documents(spark):
    rows = [(i, f"Here w{i}a writes Zaphod to zb@mail.org with w{i}b and the words", "x", 0) for i in range(6)]
    rows += [(100 + i, "the words go with here and to no one " * 5, "x", 0) for i in range(20)]
    rows += [(200, None, "y", 0), (201, "", "y", 0), (202, "call +1 (017) 555-7713 or 4111 1111 1111 1111", None, 0), (202, "call +1 (017) 555-7713 or 4111 1111 1111 1111", None, 0), (None, "at 10.0.0.1", "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")


def test_disclosing_terms(spark):
    docs = documents(spark)
    found = P.found_spans(docs)
    terms = {(r.term, r.entity): r.ratio for r in P.disclosing(found, docs).collect()}
    assert terms[("zaphod", "email:zb@mail.org")] > 0.999 and ("the", "email:zb@mail.org") not in terms
    assert not any(t.startswith("w1") for t, _ in terms)  # met once only
    rows = P.detect(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None and r.doc_id < 6:
            text = f"Here w{r.doc_id}a writes Zaphod"
            assert (len(text) - 6, len(text)) in {(t.start, t.end) for t in r.terms}


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, "Zaphod at zb@mail.org now") for i in range(50)], "doc_id long, text string")
    assert P.disclosing(P.found_spans(docs), docs).count() == 0


def test_sanitise(spark):
    docs = documents(spark)
    clean = P.sanitise(docs)
    assert clean.columns == docs.columns
    rows = clean.collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in rows}
    assert "Zaphod" not in text[1] and "zb@" not in text[1] and "[EMAIL]" in text[1]
    assert text[202] == "call [PHONE] or [CARD]" and text[None] == "at [IP]" and text[200] is None and text[201] == ""
    assert all(r.n_chars == len(r.text) for r in rows if r.text and r.doc_id not in range(100, 200))
    assert P.sanitise(docs.limit(0)).count() == 0 and P.detect(docs.limit(0)).count() == 0


def test_overlapping_spans():
    spans = [{"kind": "card", "start": 3, "end": 22}, {"kind": "phone", "start": 2, "end": 20}]
    assert P.sanitised("x +1234 5678 9012 34567 y", spans, []) == "x [PHONE] y"[:9] + "x +1234 5678 9012 34567 y"[22:]


def test_ip_with_a_very_long_run_of_zeros():
    zeros = "0" * 5000
    assert P.base_spans(f"{zeros}.1.1.1") == [("ip", 0, 5006)]
    assert P.base_spans(f"{zeros}255.0.0.{zeros}") == [("ip", 0, 10008)] and P.base_spans(f"{zeros}256.1.1.1") == []


def test_disclosing_terms_far_from_the_entity(spark):
    filler = " ".join(["plain words go here"] * 10)
    rows = [(i, f"Note k{i}a k{i}b on Zaphod here {filler} k{i}c zb@mail.org k{i}d {filler} again Zaphod says") for i in range(4)]
    rows += [(100 + i, f"{filler} and on again says note here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    for r in P.detect(docs).collect():
        want = [i for i in range(len(text[r.doc_id])) if text[r.doc_id].startswith("Zaphod", i)]
        assert [t.start for t in r.terms] == want, r.doc_id
    assert all("Zaphod" not in r.text for r in P.sanitise(docs).collect())


def brute_disclosing(texts, alpha, support):
    """(term, entity) to ratio, by loops."""
    every, meets, contexts, words_of = Counter(), Counter(), defaultdict(set), Counter()
    for text in texts:
        spans = brute(text)
        every.update(w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w)
        taken = {i for _, a, b in spans for i in range(a, b)}
        free = [m[0].lower() for m in regex.finditer(r"[\p{L}\p{N}]+", text) if taken.isdisjoint(range(*m.span()))]
        for entity, context, passages in P.nearby(text, spans):
            here = [w for p in passages for w in free[p * P.PASSAGE : (p + 1) * P.PASSAGE]]
            words_of[entity] += len(here)
            for w in here:
                meets[w, entity] += 1
                contexts[w, entity].add(context)
    n, out = sum(every.values()), {}
    for (w, e), f in meets.items():
        if len(contexts[w, e]) >= support:
            ratio = math.log2(f * n / (every[w] * words_of[e])) / -math.log2(words_of[e] / n)
            if ratio >= 1 / alpha:
                out[w, e] = ratio
    return out


def test_disclosing_terms_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.collect()]
    for alpha, support, few in ((4.0, 2, P.FEW), (4.0, 2, 3), (P.ALPHA, P.SUPPORT, P.FEW)):  # few = 3: entities of both kinds
        got = {(r.term, r.entity): r.ratio for r in P.disclosing(P.found_spans(docs), docs, alpha, support, few).collect()}
        want = brute_disclosing(texts, alpha, support)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert len(want) > 0 or support > 2


def test_classes_of_values():
    assert P.entities("email", "Ann.Lee.88@mail.Example.org") == ["email:ann.lee.88@mail.example.org", "email:@mail.example.org", "email:ann@", "email:lee@"]
    assert P.entities("ip", "010.2.3.4") == ["ip:010.2.3.4", "ip:10.2.*"] and P.entities("phone", "+1 (017) 555-7713") == ["phone:10175557713", "phone:1017*"]


def test_terms_that_disclose_a_class(spark):
    filler = "plain words go here and there with some more of them "
    rows = [(i, f"{filler}k{i}a writes for Sirius k{i}b now: person{'abcdefgh'[i]}@megadodo.org k{i}c {filler}") for i in range(8)]
    rows += [(100 + i, f"{filler} writes for now k{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in P.detect(docs).collect():  # no address recurs, their domain does
        assert (len(r.terms) == 1 and "Sirius" == dict(rows)[r.doc_id][r.terms[0].start : r.terms[0].end]) if r.doc_id < 100 else not r.terms


def test_a_very_long_text_with_many_entities(spark):
    text = " ".join(f"person{i}@mail{i % 7}.org wrote from 10.0.{i % 250}.{i % 199} to everyone" for i in range(8000))
    docs = spark.createDataFrame([(1, text), (2, "no one")], "doc_id long, text string")
    rows = {r.doc_id: r for r in P.detect(docs).collect()}
    assert len(rows[1].spans) == 16_000 and not rows[2].spans
    assert "@" not in {r.doc_id: r.text for r in P.sanitise(docs).collect()}[1]


def test_passages_of_an_entity():
    words = [f"w{i}" for i in range(3 * P.PASSAGE)]

    def of(at):
        text = " ".join([*words[:at], "a.person@mail.example", *words[at:]])
        return {e: p for e, _, p in P.nearby(text, P.base_spans(text))}["email:@mail.example"]

    assert of(0) == of(5) == [0] and of(P.PASSAGE - 1) == [0] and of(P.PASSAGE) == [0, 1] and of(P.PASSAGE + 1) == [1] and of(3 * P.PASSAGE) == [2]
    assert P.nearby("a@b.example", P.base_spans("a@b.example")) == [("email:a@b.example", P.nearby("a@b.example", P.base_spans("a@b.example"))[0][1], [0]), ("email:@b.example", P.nearby("a@b.example", P.base_spans("a@b.example"))[1][1], [0])]


def test_pairs_grow_in_proportion_to_long_texts(spark):
    """Texts of many words and many addresses of shared domains; results equal brute force."""

    def texts(n):
        return [" ".join(f"x{t}y{i} common person{i}@mail{i % 50}.example" for i in range(n)) for t in range(4)]

    rows = {}
    for n in (500, 2000):
        docs = spark.createDataFrame(list(enumerate(texts(n))), "doc_id long, text string")
        held = P.holders(P.found_spans(docs))
        items = held.groupBy("digest").agg(F.collect_list(F.struct("entity", "context", "copies", "passages")).alias("items"))
        rows[n] = P.met(docs, items).count()
    assert rows[2000] < 5 * rows[500]
    docs = spark.createDataFrame(list(enumerate(texts(500))), "doc_id long, text string")
    got = {(r.term, r.entity): r.ratio for r in P.disclosing(P.found_spans(docs), docs, 100.0, 2).collect()}
    want = brute_disclosing(texts(500), 100.0, 2)
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
