"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a weighted set of its lower-cased words: a word's weight is its
occurrences times its length, the share of the text that it takes up. For each of
SAMPLES samples a word has r and c from Gamma(2, 1) and b from Uniform(0, 1), all
functions of the word and the sample's number. With weight w,

    t = floor(ln w / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r,

and the sample is the (word, t) of least a. Two documents agree in a sample with
the probability of their generalised Jaccard similarity, sum of least weights over
sum of greatest ones. ln a and a 32-bit hash of (word, t) share one integer, so
that a sample is a plain minimum. Minima pre-aggregate; what is shuffled is text,
once, and the prefixes that edited texts are made with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged, table

SAMPLES = 32
PART_CHARS, MAX_PARTS = 4_000_000, 20_000  # characters of text in a partition, about, and partitions at most: beyond, tasks spill
SPACE = "[\\x20\\x09-\\x0D]+"
NO_ID = -(2**63)  # stands for a null doc_id: below all others


def sample(k: int, term: str = "term", weight: str = "ln_w") -> Column:
    """ln a of sample k in the upper 32 bits, a hash of (term, t) in the lower ones."""
    h1, h2 = f"xxhash64({term}, {2 * k})", f"xxhash64({term}, {2 * k + 1})"

    def uniform(h: str, shift: int, bits: int) -> str:
        return f"((shiftrightunsigned({h}, {shift}) & {2**bits - 1}L) + 0.5D) * {0.5**bits!r}D"

    r = f"(-ln(({uniform(h1, 32, 32)}) * ({uniform(h1, 0, 32)})))"
    c = f"(-ln(({uniform(h2, 43, 21)}) * ({uniform(h2, 22, 21)})))"
    b = f"({uniform(h2, 0, 22)})"
    t = f"floor({weight} / {r} + {b})"
    ln_a = f"(ln({c}) - {r} * ({t} - {b}) - {r})"
    packed = f"shiftleft(cast(least(greatest(({ln_a} + 128D) * 4194304D, 0D), 1073741823D) as bigint), 32)"
    return F.expr(f"{packed} | (xxhash64({term}, {t}, 'id') & 4294967295L)")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``texts(*keys, text)`` to (*keys, sig), sig the ids of all samples as integers, -1 for a text without words.

    No shuffle is needed where ``texts`` is already dealt by some of the keys.
    """
    words = texts.select(*keys, F.explode(F.split(F.lower(text), SPACE)).alias("word"))
    some = F.col("word") != ""
    hashed = words.select(*keys, F.when(some, F.xxhash64("word")).alias("term"), F.when(some, F.length("word")).alias("size"))
    weights = hashed.groupBy(*keys, "term").agg((F.count("*") * F.max("size")).alias("weight"))
    weighed = weights.select(*keys, "term", F.ln(F.col("weight").cast("double")).alias("ln_w"))
    least = weighed.groupBy(*keys).agg(*[F.min(F.when(F.col("term").isNotNull(), sample(k))).alias(f"s{k}") for k in range(samples)])
    ids = [F.coalesce(F.expr(f"cast(((s{k} & 4294967295L) ^ 2147483648L) - 2147483648L as int)"), F.lit(-1)) for k in range(samples)]
    return least.select(*keys, F.array(*ids).alias("sig"))


def likeness(a: str, b: str) -> Column:
    """The share of samples in which two fingerprints agree, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(sig: str) -> Column:
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(2**32 - 1))), 8, "0")), ""))


def next_keys(keys: DataFrame) -> DataFrame:
    """``keys(key, ...)``, distinct, with next_key: the next smaller key, the largest for the smallest.

    Keys are dealt by ranges; a window finds each range's successors and one row
    for each range links the ranges, so that no task sorts all keys.
    """
    ranged = staged(keys.repartitionByRange(F.desc("key")).withColumn("part", F.spark_partition_id()), "ranged")
    heads = ranged.groupBy("part").agg(F.max("key").alias("head"))
    largest = F.max("head").over(Window.partitionBy())
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), largest).alias("head"))
    own = F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key")))
    return ranged.withColumn("own", own).join(F.broadcast(heads), "part").withColumn("next_key", F.coalesce("own", "head")).drop("part", "own", "head")  # heads: a row for each partition


def edited_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (key, row, next_key, n_chars, text, edited), a row for each row.

    edited has the last floor(n_chars / 2) code points replaced by as many (or
    all) of the next document's first, in descending doc_id; the last document's
    next is the first. key is doc_id, NO_ID for null; row numbers rows of one id,
    in the order of their texts' hashes, and the first of them is the document
    that others have as their next. A null text is empty.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2)
    sizes = staged(rows.groupBy("key").agg(F.max(half).cast("int").alias("need"), F.sum(F.length("text").cast("long")).alias("chars")), "sizes")
    total = sizes.agg(F.sum("chars")).first()[0] or 0
    parts = min(MAX_PARTS, max(1, -(-total // PART_CHARS)))
    order = staged(next_keys(sizes.select("key", "need")), "order")
    dealt = rows.repartition(parts, "key")
    numbered = dealt.withColumn("row", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text"))))
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), "need")
    prefixes = numbered.where("row = 1").join(wanted.hint("shuffle_merge"), "key").select(F.col("for_key").alias("key"), F.expr("left(text, need)").alias("prefix"), F.col("key").alias("next_key"))
    both = numbered.join(prefixes.repartition(parts, "key").hint("shuffle_merge"), "key")
    n = F.length("text").cast("long")
    edited = F.expr("concat(left(text, cast(length(text) - floor(length(text) / 2) as int)), left(prefix, cast(floor(length(text) / 2) as int)))")
    return both.select("key", "row", "next_key", n.alias("n_chars"), "text", edited.alias("edited"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each row's own and edited fingerprints and their likeness, and that to the next document's.

    Equal texts have equal fingerprints; texts without words are like each other
    only. Texts count whole, however long. An empty table gives no rows; columns
    but doc_id and text are ignored.
    """
    texts = edited_texts(docs)
    sides = texts.select("key", "row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x")).select("key", "row", "x.side", "x.text")
    sigs = fingerprints(sides, ["key", "row", "side"], samples=samples)
    paired = sigs.groupBy("key", "row").agg(F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("sig"), F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("edited_sig"))
    facts = texts.select("key", "row", "next_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    done = staged(facts.join(paired, ["key", "row"]), "fingerprints")
    after = done.where("row = 1").select(F.col("key").alias("next_key"), F.col("sig").alias("next_sig"))
    out = done.join(after, "next_key")
    return out.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )


def op4_weighted_fingerprint(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
