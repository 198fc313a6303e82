"""Personal data: patterns, and terms that give a protected value away.

Base spans are e-mail addresses, IP addresses, card and telephone numbers. Each
value found is a protected entity, and so is each class that it belongs to, as most
values stand in too few documents to count with: an address's domain and the names
in its local part, a network, an area code, a card's issuer. Words outside spans
are counted in the passages that an entity stands in, PASSAGE words each, so that a
long text with many words and many entities has no product of both: with f(t)
occurrences of term t, f(t, e) of them outside spans in passages with entity e, f(e)
words in those and n words in all, where f(t) and n count all words of all texts,

    PMI(t, e) = log2(f(t, e) n / (f(t) f(e))),    IC(e) = -log2(f(e) / n).

PMI is how much t tells about e and IC all there is to tell. A term is disclosing
if PMI >= IC / ALPHA and the two meet in at least SUPPORT documents that differ
in the words near e, so that copies of one passage are no evidence. All occurrences
of disclosing terms in documents with their entity are generalised, or removed
where PMI >= REMOVE * IC.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged, table, whole_row
from tidemark.llm.url_filter import marked

WINDOW = 8  # words on either side of an entity that tell copies from different contexts
PASSAGE = 256  # words outside spans
ALPHA = 1.25
REMOVE = 0.95
SUPPORT = 3
FEW = 100_000  # texts with an entity whose pairs need no sums by context before their shuffle
NAME_LENGTH = 3  # letters of a name in the local part of an address, at least
CLASS_DIGITS = {"card": 6, "phone": 4}  # leading digits that name an issuer, and a country with an area

# Kinds in the order in which spans are listed, and their patterns.
# The lookbehind of ip skips starts within a run of digits, where no match can begin
# that the run's start doesn't give; an e-mail address is found from its @.
KINDS = ["email", "ip", "card", "phone", "term"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = "[^\\p{L}\\p{N}]+"  # what separates words

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
NEAR = T.StructType([T.StructField("entity", T.StringType()), T.StructField("context", T.LongType()), T.StructField("passages", T.ArrayType(T.IntegerType()))])
COUNTED = pa.list_(pa.struct([("words", pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))), ("items", pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("copies", pa.int64())])))]))
PLACED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))
TOGETHER = 64  # texts whose words are held at once


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    if not any(d in text for d in "0123456789"):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


@functools.cache
def word_pattern():
    import regex

    return regex.compile(r"[\p{L}\p{N}]+")


def entities(kind: str, value: str) -> list[str]:
    """The protected entities of a span: its value, and the classes that it backs off to."""
    if kind == "email":
        local, domain = value.lower().rsplit("@", 1)
        names = sorted({n for n in word_pattern().findall(local) if len(n) >= NAME_LENGTH and not n.isdigit()})
        return [f"email:{value.lower()}", f"email:@{domain}", *[f"email:{n}@" for n in names]]
    if kind == "ip":
        return [f"ip:{value}", f"ip:{'.'.join(p.lstrip('0') or '0' for p in value.split('.')[:2])}.*"]
    digits = digits_of(value)
    return [f"{kind}:{digits}", f"{kind}:{digits[:CLASS_DIGITS[kind]]}*"]


def nearby(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, list[int]]]:
    """(entity, context, passages) for each entity and class of a text.

    context is a hash of the words within WINDOW words of its places, passages are
    those that it stands in, two where it stands between them.
    """
    words = [m.span() for m in word_pattern().finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    free = [a for _, a, _ in free_words(text, spans)]
    near: dict[str, tuple[set[str], set[int]]] = {}
    for kind, start, end in spans:
        left, right = bisect.bisect_right(ends, start), bisect.bisect_left(starts, end)
        at = (*range(max(0, left - WINDOW), left), *range(right, min(len(words), right + WINDOW)))
        context = " ".join(text[a:b] for a, b in (words[i] for i in at))
        before = bisect.bisect_left(free, start)
        passages = {max(0, min(i, len(free) - 1)) // PASSAGE for i in (before - 1, before)}
        for entity in entities(kind, text[start:end]):
            contexts, found = near.setdefault(entity, (set(), set()))
            contexts.add(context)
            found |= passages
    return [(e, xxhash.xxh64_intdigest("\n".join(sorted(c)).encode("utf-8", "replace")) - (1 << 63), sorted(p)) for e, (c, p) in near.items()]


def free_words(text: str, spans: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words outside all base spans."""
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in (base_spans(text) if spans is None else spans)):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts, out = [s for s, _ in taken], []
    for m in word_pattern().finditer(text):
        a, b = m.span()
        i = bisect.bisect_left(starts, b) - 1
        if i < 0 or taken[i][1] <= a:
            out.append((m[0], a, b))
    return out


@F.pandas_udf(T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("near", T.ArrayType(NEAR))]))
def find_udf(text: pd.Series) -> pd.DataFrame:
    spans = [base_spans(t) if t else [] for t in text]
    near = [nearby(t, s) if s else [] for t, s in zip(text, spans, strict=True)]
    names, fields = SPAN.names, NEAR.names
    return pd.DataFrame({"spans": [[dict(zip(names, x, strict=True)) for x in s] for s in spans], "near": [[dict(zip(fields, x, strict=True)) for x in s] for s in near]})


def found_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, digest, spans, near), a row for each row; digest is the text's hash."""
    found = docs.select("doc_id", F.xxhash64("text").alias("digest"), find_udf("text").alias("found"))
    return staged(found.select("doc_id", "digest", "found.spans", "found.near"), "pii")


def holders(found: DataFrame) -> DataFrame:
    """(digest, entity, context, passages, copies) of the texts that entities stand in."""
    near = found.select("digest", F.explode("near").alias("n")).select("digest", "n.entity", "n.context", "n.passages")
    return near.groupBy("digest", "entity", "context", "passages").agg(F.count("*").alias("copies"))


def texts_with(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(digest, text, items) of the texts that ``items(digest, items)`` has a row for, each text once.

    Copies of a text become one before the shuffle, and texts that aren't wanted hardly reach it.
    """
    texts = marked(docs.select(F.xxhash64("text").alias("digest"), "text"), items.select("digest"), "digest").where("_possible")
    return texts.select("digest", "text").dropDuplicates(["digest"]).join(items, "digest")


def parts_of(text: str, items: list[dict]) -> list[dict]:
    """The passages of a text that an item stands in: their words outside spans with their counts, their number as that of the empty word, and the items."""
    held: dict[int, list[dict]] = {}
    for x in items:
        for p in x["passages"]:
            held.setdefault(p, []).append({k: x[k] for k in ("entity", "context", "copies")})
    words, out = [w[0].lower() for w in free_words(text)], []
    for p, some in held.items():
        counts = Counter(words[p * PASSAGE : (p + 1) * PASSAGE])
        out.append({"words": [{"term": "", "n": counts.total()}, *({"term": w, "n": n} for w, n in counts.items())], "items": some})
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text, items) to (parts): see parts_of."""
    for batch in batches:
        for part in (batch.slice(i, TOGETHER) for i in range(0, batch.num_rows, TOGETHER)):
            made = [parts_of(t.as_py() or "", items.as_py()) for t, items in zip(part.column("text"), part.column("items"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, COUNTED)], ["parts"])


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, text, items) to (digest, terms): the places of the text's words that its items (term, ratio) name."""
    for batch in batches:
        for part in (batch.slice(i, TOGETHER) for i in range(0, batch.num_rows, TOGETHER)):
            ratios = [{x["term"]: x["ratio"] for x in items.as_py()} for items in part.column("items")]
            terms = [[{"start": a, "end": b, "ratio": r[low]} for w, a, b in free_words(t.as_py() or "") if (low := w.lower()) in r] for t, r in zip(part.column("text"), ratios, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(terms, PLACED)], ["digest", "terms"])


def word_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_hash, f_t): occurrences of words in all texts, exact for those of ``terms(term_hash)``; most others share the null row."""
    wanted = staged(terms.select("term_hash").distinct(), "terms")
    words = docs.select(F.explode(F.split(F.lower("text"), WORD)).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("term_hash"))
    known = marked(words, wanted, "term_hash").select(F.when(F.col("_possible"), F.col("term_hash")).alias("term_hash"))
    return staged(known.groupBy("term_hash").agg(F.count("*").alias("f_t")), "words")


def met(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(term, entity, context, n): the words of the passages of ``items(digest, items)`` with each of their entities, n with the texts' copies."""
    schema = "parts array<struct<words:array<struct<term:string,n:bigint>>,items:array<struct<entity:string,context:bigint,copies:bigint>>>>"
    parts = texts_with(docs, items).mapInArrow(counted, schema).select(F.inline("parts"))
    rows = parts.select("items", F.inline("words")).select("term", "n", F.inline("items"))
    return rows.select("term", "entity", "context", (F.col("n") * F.col("copies")).alias("n"))


def pairs_of(docs: DataFrame, held: DataFrame, support: int, few: int = FEW) -> DataFrame:
    """(term, entity, f_te) of terms and entities that meet in ``support`` contexts; the empty term has the entity's f_e.

    ``held(digest, entity, context, passages, copies, texts)`` has the number of texts with the entity. With at most
    ``few`` texts, so few rows a pair, pairs are shuffled once; with more they are first summed up by context.
    """
    item = F.struct("entity", "context", "copies", "passages")
    kinds = [staged(held.where(kind).groupBy("digest").agg(F.collect_list(item).alias("items")), "held") for kind in (F.col("texts") <= few, F.col("texts") > few)]
    rows = [met(docs, kinds[0]).repartition("term", "entity")]
    if not kinds[1].isEmpty():
        rows.append(met(docs, kinds[1]))
    parts = [r.groupBy("term", "entity", "context").agg(F.sum("n").alias("n")).groupBy("term", "entity").agg(F.sum("n").alias("f_te"), F.count("*").alias("contexts")) for r in rows]
    return staged(reduce(DataFrame.unionByName, parts).where(F.col("contexts") >= support).drop("contexts"), "pairs")


def disclosing(found: DataFrame, docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, few: int = FEW) -> DataFrame:
    """(term, entity, ratio) of disclosing terms, ratio = PMI / IC."""
    held = staged(holders(found), "holders")
    often = held.groupBy("entity").agg(F.countDistinct("context").alias("contexts"), F.count("*").alias("texts")).where(F.col("contexts") >= support)
    pairs = pairs_of(docs, held.join(often.select("entity", "texts"), "entity"), support, few)  # other entities have too few contexts for any term
    entities = pairs.where("term = ''").select("entity", F.col("f_te").alias("f_e"))
    candidates = pairs.where("term <> ''").withColumn("term_hash", F.xxhash64("term"))
    counts = word_counts(docs, candidates)
    total = counts.agg(F.sum("f_t")).first()[0] or 0
    n, f_te, f_e = F.lit(float(total)), F.col("f_te"), F.col("f_e")
    rated = candidates.join(entities, "entity").join(counts, "term_hash", "left").withColumn("f_t", F.greatest("f_t", "f_te"))
    ratio = F.log2(f_te * n / (F.col("f_t") * f_e)) / -F.log2(f_e / n)
    return rated.where(f_e < n).withColumn("ratio", ratio).where(F.col("ratio") >= 1 / alpha).select("term", "entity", "ratio")


def term_spans(found: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, terms): each text's spans (start, end, ratio) of terms that disclose an entity in it, in order; texts without any are absent."""
    rated = holders(found).join(terms, "entity").groupBy("digest", "term").agg(F.max("ratio").alias("ratio"))
    of_text = staged(rated.groupBy("digest").agg(F.collect_list(F.struct("term", "ratio")).alias("items")), "rated")
    return texts_with(docs, of_text).mapInArrow(placed, "digest long, terms array<struct<start:int,end:int,ratio:double>>")


def id_key() -> Column:
    """doc_id with a value for null, for joins."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id")


def detect(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, digest, spans, terms), a row for each row.

    spans are base spans (kind, start, end), terms those of disclosing terms
    (start, end, ratio), both in order. A null or empty text has none; rows that
    repeat a doc_id keep their own; a very long text is read as a whole; an empty
    table gives no rows.
    """
    found = found_spans(docs)
    terms = term_spans(found, disclosing(found, docs), docs)
    out = found.select("doc_id", "digest", "spans").join(terms, "digest", "left")
    return out.select("doc_id", "digest", "spans", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,ratio:double>>")).alias("terms"))


def sanitised(text: str, spans: list, terms: list) -> str:
    """The text with base spans as [KIND], overlapping ones together, and terms generalised or removed."""
    edits = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in spans]
    for t in terms:
        word = text[t["start"] : t["end"]]
        shape = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"
        edits.append((t["start"], t["end"], "" if t["ratio"] >= REMOVE else shape))
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def sanitise_udf(text: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([sanitised(t, s, m) if len(s) or len(m) else t for t, s, m in zip(text, spans, terms, strict=True)], dtype=object)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data taken out of ``text`` and n_chars brought up to date.

    All rows and columns stay, whatever those are called; null and empty texts stay null and empty, rows that
    repeat an id and a text are changed alike. Texts without a digit or @ can't hold a base span,
    so they pass through and only the others are joined with their spans.
    """
    suspect = F.coalesce(F.col("text").rlike("[@0-9]"), F.lit(False))
    some = docs.where(suspect)
    found = found_spans(some)
    terms = term_spans(found, disclosing(found, docs), some)
    spans = found.where(F.size("spans") > 0).select(id_key(), "digest", "spans").dropDuplicates(["id", "digest"])
    keyed = some.select(whole_row(docs), "text", id_key(), F.xxhash64("text").alias("digest"))
    both = keyed.join(spans.join(terms, "digest", "left"), ["id", "digest"], "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(sanitise_udf("text", F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))), F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,ratio:double>>"))))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    done = both.withColumn("text", clean).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
    return done.unionByName(docs.where(~suspect))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op8_pii(spark, sf_dir):
    """Every document's base spans and the spans that disclosing terms add."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("spans", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:4]]
    added = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    every = F.array_join(F.concat(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), added), ",")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_term"))
