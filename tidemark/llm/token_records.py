"""Token ids as length-delimited binary records with a separate offset index.

A data file is a 16-byte header (magic, format version, bytes per id) and records:

    length   8 bytes, of the payload
    check    4 bytes, masked checksum of those 8 bytes
    payload  1 byte (1: doc_id is null), 8 bytes doc_id, then the ids
    check    4 bytes, masked checksum of the payload

Its index holds 16 bytes a record: where the record begins, and how many ids the
file has before it, so that a reader can fetch records in any order (read_shuffled) or
take any part of a file (read_records). All integers are little-endian. A checksum is CRC-32, rotated
right by 15 bits plus a constant, so that it isn't the checksum of data that
holds checksums. Ids take 2 bytes where the vocabulary allows, else 4.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, staged, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2  # appended to every document
MAGIC = b"TIDEIDS1"
CACHE, CACHE_CHARS = 800_000, 16 << 20  # encoded words that a Python worker keeps, and their characters
TOGETHER = 5000  # words that go to the library in one string
CHUNK = 2 << 20  # characters whose words are held at once
BATCH = 1000  # records that a reader gives on at a time
OPEN_INDEXES = 64  # files whose index a shuffled reader keeps
ROWS_A_FILE, MAX_FILES = 5000, 10_000  # documents that a file is meant for, and files at most
NO_ID = -(2**63)  # stands for a null doc_id: below all others
OF_FRAME = 25  # bytes of a record besides its ids
# A place between an ASCII or Latin-1 letter or digit (normalising and lower-casing leave one letter) and an ASCII sign other than the apostrophe, which may begin a contraction.
SIGN = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
MANIFEST = "part int, path string, records long, ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    payload = struct.pack("<?q", doc_id is None, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


class Words:
    """Encodes with the tokenizers library, word by word, signs after a word apart.

    The tokenizer drops white space and its normaliser composes nothing across a
    space or line feed, so a text's ids are those of its words in turn. Each
    different word goes to the library once, many of them in one string, between
    bars that stand alone; words with a bar in them go one by one. The ids of known
    words lie end to end in one array, and texts are put together by position.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.bar = self.ids(["|"])[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # a word's position in starts and sizes
        self.chars = 0
        self.flat, self.starts, self.sizes = np.zeros(0, f"<u{self.width}"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        plain, barred = [w for w in new if "|" not in w], [w for w in new if "|" in w]
        flat, sizes = [self.flat], [self.sizes]
        groups = (plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER))
        for ids in self.ids([" | ".join(g) for g in groups]):
            bars = ids == self.bar[0]
            flat.append(ids[~bars])
            sizes.append(np.diff(np.flatnonzero(bars), prepend=-1, append=len(ids)) - 1)
        apart = self.ids(barred)
        self.flat = np.concatenate([*flat, *apart])
        self.sizes = np.concatenate([*sizes, np.array([len(x) for x in apart], np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known.update(zip([*plain, *barred], range(len(self.known), len(self.sizes)), strict=True))
        self.chars += sum(map(len, new))

    @staticmethod
    def apart(texts: pa.Array) -> pa.Array:
        """Texts in small letters and with a space before a sign that follows a letter, where that changes no id.

        A new pre-token begins at such a sign anyway. Special tokens are written in
        small letters, and an accent may join a small letter only, so texts with a
        special token's bracket, or with signs from the combining marks on, stay as they are.
        """
        odd = pc.match_substring_regex(texts, "<\\||[^\x00-\u02ff]")
        easy = pc.replace_substring_regex(pc.ascii_lower(pc.if_else(odd, "", texts)), SIGN, "\\1 \\2")
        return pc.if_else(odd, texts, easy)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, END_ID after each, and where each text's ids end."""
        split = pc.split_pattern(pc.replace_substring(self.apart(texts), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if (number < 0).any():
            new = words[number < 0].tolist()
            if len(self.known) + len(new) > CACHE or self.chars > CACHE_CHARS:
                self.forget()
                new = words.tolist()
            self.learn(new)
            number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        of_word = number[coded.indices.to_numpy()]
        size = self.sizes[of_word]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(before[-1]) + np.repeat(self.starts[of_word] - before[:-1], size)]
        ends = before[np.cumsum(pc.list_value_length(split).to_numpy())]
        return np.insert(ids, ends, END_ID), ends + np.arange(1, len(texts) + 1)

    def encode_all(self, texts: pa.Array) -> Iterator[pa.Array]:
        """As binary values, for one group of texts after the other, so that few words are held at once."""
        if not len(texts):
            return
        group = np.cumsum(pc.utf8_length(texts).to_numpy()) // CHUNK
        cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            ids, ends = self.encode(texts[a:b])
            offsets = np.concatenate([[0], ends * self.width]).astype(np.int64)
            yield pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


@functools.cache
def words(path: str) -> Words:
    return Words(path)


def bounds_of(docs: DataFrame) -> np.ndarray:
    """Ids that cut ``docs`` into runs of about ROWS_A_FILE rows, MAX_FILES runs at most; an id that is more than one run is there as often."""
    counts = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    parts = min(MAX_FILES, -(-counts.rows // ROWS_A_FILE))
    if parts < 2:
        return np.zeros(0, np.int64)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) if counts.named < counts.rows else F.col("doc_id").cast("long")
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("cuts")).first().cuts
    return np.array(cuts, np.int64)


def part_of(doc_id: pa.Array, digest: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The run of each row by doc_id, and by digest where an id has several runs."""
    key = pc.fill_null(doc_id, NO_ID).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    many = high - low > 1
    share = digest.astype(np.float64) / 2.0**64 + 0.5
    return np.where(many, np.minimum(high, low + (share * (high - low + 1)).astype(np.int64)), high).astype(np.int32)


def encoded(docs: DataFrame, bounds: np.ndarray, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to (part, doc_id, digest, ids), a row for each row; ids in the files' width, digest the text's hash."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches):
        for batch in batches:
            at, parts = 0, part_of(batch.column("doc_id"), batch.column("digest").to_numpy(), bounds)
            for ids in words(path).encode_all(batch.column("text")):
                rows = batch.slice(at, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(parts[at : at + len(ids)]), rows.column("doc_id"), rows.column("digest"), ids.cast(pa.binary())], ["part", "doc_id", "digest", "ids"])
                at += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, digest long, ids binary")


def write_records(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files below ``folder``, in ascending doc_id order.

    Returns the manifest, one row a file: part (files in order), path, records
    and ids. Texts are encoded where they are read, once; only their ids are
    dealt, by ranges of doc_id whose bounds come from the ids alone. A null doc_id
    comes first (so does the least possible one), rows that repeat one are in the
    order of their texts' hashes. A null text counts as empty and has the end id
    alone; a very long text is one record. An empty table gives no files; columns
    but doc_id and text are ignored. A task writes under a name of its own and
    renames at the end, so a lost or repeated task leaves whole files only.
    """
    path = path or tokenizer_path(VOCABULARY)
    bounds = bounds_of(docs)
    dealt = encoded(docs, bounds, path).repartitionById(len(bounds) + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("doc_id", "digest").select("doc_id", "ids")

    def write(batches):
        task = TaskContext.get()
        part, at, ids, index = task.partitionId(), 16, 0, []
        store, base = pafs.FileSystem.from_uri(folder)
        final = f"{base}/part-{part:06d}"
        own = f"{final}.attempt-{task.taskAttemptId()}"
        width, out = words(path).width, None
        for batch in batches:
            if out is None and len(batch):
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{own}.ids")
                out.write(MAGIC + struct.pack("<II", 1, width))
            names = batch.column("doc_id").to_pylist()
            for i in range(0, len(names), BATCH):
                records = [frame(name, data) for name, data in zip(names[i : i + BATCH], batch.column("ids")[i : i + BATCH].to_pylist(), strict=True)]
                for record in records:
                    index.append((at, ids))
                    at += len(record)
                    ids += (len(record) - OF_FRAME) // width
                out.write(b"".join(records))
        if out is not None:
            out.close()
            with store.open_output_stream(f"{own}.index") as file:
                file.write(np.array(index, "<u8").tobytes())
            for kind in ("index", "ids"):
                store.move(f"{own}.{kind}", f"{final}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}"], "records": [len(index)], "ids": [ids]})

    return staged(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_index(path: str, first: int = 0, count: int | None = None) -> np.ndarray:
    """Where records begin and the ids before them, a row for each of ``count`` records from ``first`` on (all by default)."""
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}.index") as file:
        file.seek(first * 16)
        index = np.frombuffer(file.read() if count is None else file.read(count * 16), "<u8").reshape(-1, 2)
    if count is not None and len(index) != count:
        raise ValueError(f"{path}.index is too short")
    return index


def read_at(path: str, index: np.ndarray) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the file, ids as unsigned 32-bit integers) of the records at ``index``, in that order, checked."""
    store, base = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{base}.ids") as file:
        magic, version, width = struct.unpack("<8sII", file.read(16))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{path}.ids isn't a file of token ids")
        at = 16
        for begin, before in index.tolist():
            if at != begin:
                file.seek(begin)
            head = file.read(12)
            length, check = struct.unpack("<QI", head)
            if masked(head[:8]) != check:
                raise ValueError(f"{path}.ids: damaged length at byte {begin}")
            payload = file.read(length)
            if struct.unpack("<I", file.read(4))[0] != masked(payload):
                raise ValueError(f"{path}.ids: damaged record at byte {begin}")
            at = begin + 16 + length
            none, doc_id = struct.unpack("<?q", payload[:9])
            yield None if none else doc_id, before, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4").tobytes()


def read_file(path: str, first: int, count: int) -> Iterator[tuple[int | None, int, bytes]]:
    """The ``count`` records from number ``first`` on, as read_at gives them."""
    return read_at(path, read_index(path, first, count))


def as_batch(held: list[tuple]) -> pa.RecordBatch:
    doc_id, at, ids = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


def read_records(spark: SparkSession, manifest: DataFrame, records_a_task: int = 50_000) -> DataFrame:
    """(doc_id, start, ids) of every record: start counts the ids of all documents before it.

    The manifest has a row a file and is gathered on the driver for the files'
    first positions; the records are read by tasks, a long file by several. Files
    without records, or no files, give no rows.
    """
    jobs, start = [], 0
    for row in manifest.orderBy("part").collect():
        jobs += [(row.path, i, min(records_a_task, row.records - i), start) for i in range(0, row.records, records_a_task)]
        start += row.ids

    def read(batches):
        for batch in batches:
            for path, first, count, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records = ((doc_id, base + before, ids) for doc_id, before, ids in read_file(path, first, count))
                while held := list(itertools.islice(records, BATCH)):
                    yield as_batch(held)

    files = spark.createDataFrame(jobs, "path string, first long, count long, base long").repartition(max(1, len(jobs)))
    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def read_shuffled(spark: SparkSession, manifest: DataFrame, seed: int, tasks: int = 64) -> DataFrame:
    """(task, position, doc_id, ids) of every record once, in an order that ``seed`` draws.

    Each record's number goes to a task and a position there by hash; a task then
    fetches its records through the files' indexes, wherever they lie. Numbers
    alone are shuffled. Another seed gives another order of the same records.
    """
    numbers = manifest.where("records > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)).alias("record"))
    drawn = numbers.withColumn("draw", F.xxhash64(F.lit(seed), "path", "record")).withColumn("task", F.pmod("draw", F.lit(tasks)).cast("int"))
    dealt = drawn.repartition(tasks, "task").sortWithinPartitions("task", "draw", "path", "record")

    def read(batches):
        indexes: dict[str, np.ndarray] = {}
        position: dict[int, int] = {}
        for batch in batches:
            task, path, record = (batch.column(c).to_pylist() for c in ("task", "path", "record"))
            for i in range(0, len(task), BATCH):
                part = range(i, min(i + BATCH, len(task)))
                by_file: dict[str, list[int]] = {}
                for k in part:
                    by_file.setdefault(path[k], []).append(k)
                found: dict[int, tuple] = {}
                for name, places in by_file.items():
                    if name not in indexes:
                        indexes = dict(list(indexes.items())[-OPEN_INDEXES:]) | {name: read_index(name)}
                    places.sort(key=record.__getitem__)  # a file is read forwards
                    found |= zip(places, read_at(name, indexes[name][[record[k] for k in places]]), strict=True)
                at = []
                for k in part:
                    at.append(position.get(task[k], 0))
                    position[task[k]] = at[-1] + 1
                columns = [pa.array([task[k] for k in part], pa.int32()), pa.array(at, pa.int64()), pa.array([found[k][0] for k in part], pa.int64()), pa.array([found[k][2] for k in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["task", "position", "doc_id", "ids"])

    return dealt.mapInArrow(read, "task int, position long, doc_id long, ids binary")


def op9_token_records(spark, sf_dir):
    """Every document's place and checksum in the files that hold all documents' ids."""
    manifest = write_records(table(spark, sf_dir, "documents"), scratch(spark, "token-ids"))
    records = read_records(spark, manifest)
    return records.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
