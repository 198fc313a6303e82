"""Spelling variants: words one edit apart, found with Bloom filters of the vocabulary.

Every word's edits are generated and probed against blocked Bloom filters of the
vocabulary, one for each word length, which are broadcast. Only edits that may be
words are shuffled to an exact join with the vocabulary, which removes the false
positives. An unordered pair is generated once: a replacement only by the larger
letter, a pair of neighbouring lengths only by deletion from the longer word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table
from tidemark.llm.crc_sql import CRCS, crc32_sql

# The letters of a word, of which only A-Z are lower-cased; the query's slips of the pen.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199

MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
#: Words for each block of 512 bits; about one probe in 1500 is then a false positive.
BLOCK_WORDS = 32
#: Blocks that are broadcast at once (32 MB). A larger vocabulary is probed in several rounds, each with part of the filters.
ROUND_BLOCKS = 2**19
#: Words of a task of probes, and probes held at once.
TASK_WORDS = 8192
HELD = 2**20


class Shard(NamedTuple):
    """The filter of words of one length, or of a part of them: ``part`` of ``parts``."""

    length: int
    part: int
    parts: int
    blocks: int


def occurrences(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (word): each run of at least MIN_LENGTH letters as the query reads it, slips included.

    A slip deletes a letter, so a shorter run never becomes a word that counts. A
    null text has no runs; a null doc_id counts as the empty text.
    """
    runs = F.regexp_extract_all("text", F.lit(f"({RUN}{{{MIN_LENGTH},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)))  # most have no capitals
    drawn = rows.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return drawn.select(F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words that are long and frequent enough; counts pre-aggregate, so a frequent word is no hot key.

    Length is asked of the counted words: Catalyst would else work each occurrence's word out twice.
    """
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.when(F.length("word") >= min_length, F.col("n")) >= min_count)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with their bits mixed, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def placed(place: np.ndarray | int, letter: np.ndarray) -> np.ndarray:
    """A random value for each letter at each place; a word's hash is their sum, so that an edit's hash costs a few additions."""
    at = np.asarray(place, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(at + (letter.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The bit that a key sets in each of its block's eight words, as eight rows of masks."""
    drawn = mixed(hashes + np.uint64(0x2545F4914F6CDD1D))
    return np.uint64(1) << (drawn >> (np.arange(8, dtype=np.uint64) * np.uint64(6))[:, None] & np.uint64(63))


def spelled(words: np.ndarray | pd.Series, length: int) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)


def hashes_of(letters: np.ndarray) -> np.ndarray:
    return mixed(placed(np.arange(letters.shape[1]), letters).sum(axis=1, dtype=np.uint64))


def by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """(length, words) of a batch, few enough at once that their edits at one place fit in HELD."""
    sizes = words.str.len()
    for length, some in words.groupby(sizes):
        step = max(1, HELD // max(len(LETTERS), int(length)))
        for i in range(0, len(some), step):
            yield int(length), some.to_numpy()[i : i + step]


def shards_of(vocab: DataFrame, round_blocks: int) -> list[list[Shard]]:
    """The filters, dealt into rounds of ``round_blocks`` at most. One row a word length comes to the driver."""
    rounds: list[list[Shard]] = []
    room = 0
    for r in sorted(vocab.groupBy(F.length("word").alias("length")).count().collect()):
        blocks = -(-r["count"] // BLOCK_WORDS)
        parts = -(-blocks // round_blocks)
        for part in range(parts):
            shard = Shard(r["length"], part, parts, -(-blocks // parts))
            if shard.blocks > room:
                rounds.append([])
                room = round_blocks
            rounds[-1].append(shard)
            room -= shard.blocks
    return rounds


def filters(vocab: DataFrame, shards: list[Shard]) -> dict[Shard, np.ndarray]:
    """Each shard's filter, eight rows of a word for each block. Blocks are joined on Spark; a round's are of bounded size."""
    of = {(s.length, s.part): s for s in shards}
    parts = {s.length: s.parts for s in shards}
    schema = "length int, part int, block long, " + ", ".join(f"w{i} long" for i in range(8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, words in by_length(pdf["word"]):
                if length not in parts:
                    continue
                hashes = hashes_of(spelled(words, length))
                part = (hashes % np.uint64(parts[length])).astype(np.int32)
                for p in np.unique(part):
                    if shard := of.get((length, int(p))):
                        own = hashes[part == p]
                        bits = bits_of(own).view(np.int64)
                        yield pd.DataFrame({"length": np.int32(length), "part": p, "block": block_of(own, shard.blocks), **{f"w{i}": bits[i] for i in range(8)}})

    rows = vocab.where(F.length("word").isin(list(parts))).select("word").mapInPandas(run, schema)
    out = {s: np.zeros((8, s.blocks), np.uint64) for s in shards}
    built = rows.groupBy("length", "part", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toArrow().to_pandas()
    for (length, part), some in built.groupby(["length", "part"]):
        out[of[length, part]][:, some["block"]] = some[[f"w{i}" for i in range(8)]].to_numpy().view(np.uint64).T
    return out


def passing(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions of keys that may be in a filter; most fall at the first of eight tests."""
    drawn = mixed(hashes + np.uint64(0x2545F4914F6CDD1D))
    block = block_of(hashes, words.shape[1])
    left = np.flatnonzero(words[0][block] >> (drawn & np.uint64(63)) & np.uint64(1))
    for i in range(1, 8):
        left = left[(words[i][block[left]] >> (drawn[left] >> np.uint64(6 * i) & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return left


def edits(words: np.ndarray, length: int, same: list[np.ndarray], shorter: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(word numbers, candidates): edits of words of one length that a filter of that or the next smaller length lets through."""
    letters = spelled(words, length)
    own = placed(np.arange(length), letters)
    whole = own.sum(axis=1, dtype=np.uint64)
    if same:
        for i in range(length):
            larger = letters[:, i][:, None] < LETTERS[None, :]
            row, letter = np.nonzero(larger)
            hashes = mixed((whole - own[:, i])[row] + placed(i, LETTERS)[letter])
            for words_of in same:
                hit = passing(hashes, words_of)
                yield row[hit], [f"{w[:i]}{chr(c)}{w[i + 1 :]}" for w, c in zip(words[row[hit]], LETTERS[letter[hit]], strict=True)]
    if shorter:
        before = np.zeros_like(own)  # of the letters left of each place
        np.cumsum(own[:, :-1], axis=1, out=before[:, 1:])
        moved = np.zeros_like(own)
        moved[:, 1:] = placed(np.arange(length - 1), letters[:, 1:])  # of each letter, one place to the left
        after = np.flip(np.cumsum(np.flip(moved, 1), axis=1), 1) - moved
        last = np.ones_like(letters, bool)  # of equal letters in a row the last is deleted
        last[:, :-1] = letters[:, :-1] != letters[:, 1:]
        row, place = np.nonzero(last)
        hashes = mixed((before + after)[row, place])
        for words_of in shorter:
            hit = passing(hashes, words_of)
            yield row[hit], [w[:i] + w[i + 1 :] for w, i in zip(words[row[hit]], place[hit], strict=True)]


def near_pairs(vocab: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """(word, n, other, other_n): every unordered pair of words of ``vocab(word, n)`` one edit apart, once.

    ``vocab`` is read several times, so it should be a written table. Words must
    have LETTERS only.
    """
    spark, found = vocab.sparkSession, None
    for shards in shards_of(vocab, round_blocks):
        held = spark.sparkContext.broadcast({(s.length, s.part): f for s, f in filters(vocab, shards).items()})

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            of: dict[int, list[np.ndarray]] = {}
            for (length, _), words_of in held.value.items():
                of.setdefault(length, []).append(words_of)
            for pdf in batches:
                counts = dict(zip(pdf["word"], pdf["n"], strict=True))
                for length, words in by_length(pdf["word"]):
                    for row, candidates in edits(words, length, of.get(length, []), of.get(length - 1, [])):
                        if len(row):
                            yield pd.DataFrame({"word": words[row], "n": [counts[w] for w in words[row]], "other": candidates})

        spread = vocab.select("word", "n").repartition(max(1, -(-sum(s.blocks for s in shards) * BLOCK_WORDS // TASK_WORDS)), "word")
        some = spread.mapInPandas(run, "word string, n long, other string")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return found.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms followed to the last. A form is more frequent by a factor, so there are no circles, and each round doubles the steps."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = now.join(ahead, "root", "left")
        now = staged(joined.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        moved = not now.where("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            return now


def variants(vocab: DataFrame, factor: int = FACTOR, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """``vocab(word, n)`` with form, root, n_near and form_n.

    Near words are one inserted, deleted or replaced letter apart. A word's form is
    the most frequent near word (of equals the first in code-point order) if that
    is ``factor`` times as frequent; its root is the end of the chain of forms, or
    the word itself. Words must be distinct and of LETTERS. An empty vocabulary
    gives no rows; other columns are ignored.
    """
    vocab = staged(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pairs = near_pairs(vocab, round_blocks)
    both = pairs.select(F.inline(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    enough: Column = -F.col("best.less") >= factor * F.col("n")
    rows = vocab.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    rows = staged(rows, "forms")
    return rows.join(roots(rows.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of six letters or more that occurs five times or more, with its more frequent spelling."""
    return variants(vocabulary(occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def oracle() -> str:
    """The query in SQL: near words share a pattern with one letter taken or blanked out."""
    cut = "left({0}, cast({1} as int)) || {2} || substr({0}, cast({1} as int) + 2)"
    run = RUN.replace("\\u00C0-\\u00FF", "\u00c0-\u00ff")
    drawn = crc32_sql("coalesce(cast(doc_id as varchar), '') || ':' || run")
    at = "h % length(run)"
    return f"""
with recursive {CRCS},
found as (select doc_id, translate(unnest(regexp_extract_all(text, '{run}+')), '{UPPER}', '{LOWER}') as run from documents),
runs as (select doc_id, run, count(*) as n from found where length(run) >= {MIN_LENGTH} group by doc_id, run),
drawn as (select run, n, {drawn} as h from runs, crcs),
words as materialized (select word, cast(sum(n) as bigint) as n from (select case when h % {SLIP} = 0 then {cut.format("run", at, "''")} else run end as word, n from drawn)
  where length(word) >= {MIN_LENGTH} group by word having sum(n) >= {MIN_COUNT}),
places as (select word, unnest(range(length(word))) as i from words),
blanked as (select word, {cut.format("word", "i", "'_'")} as pattern from places),
shorter as (select distinct word, {cut.format("word", "i", "''")} as pattern from places),
pairs as (select a.word, b.word as other from blanked a join blanked b on a.pattern = b.pattern and a.word <> b.word
  union all select word, pattern from shorter where pattern in (select word from words)
  union all select pattern, word from shorter where pattern in (select word from words)),
near as (select p.word, other, o.n as other_n from pairs p join words o on o.word = other),
best as (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, encode(other)) as place from near),
forms as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= {FACTOR} * w.n then other end as form, case when other_n >= {FACTOR} * w.n then other_n end as form_n
  from words w left join best b on b.word = w.word and b.place = 1),
chain as (select word, word as root, form as next from forms union all select c.word, f.word, f.form from chain c join forms f on f.word = c.next)
select f.word, form, c.root, n, n_near, form_n from forms f join chain c on c.word = f.word and c.next is null"""
