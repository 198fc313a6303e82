"""Byte-level BPE: encoding and decoding without a regex.

Pre-tokenisation works on whole batches. Each code point gets a symbol from its
class (letter, number, white space, other) and from what follows it; an automaton
over those symbols says where the pattern's next match begins. Its transition
functions compose associatively, so the text is cut into blocks, each block's
function is worked out for all states at once, the functions are combined by a
doubling scan, and a last pass marks the starts. The slices between starts go
through a cache of merged pieces. Each token's byte offset is kept, and decoding
writes every token's bytes at its offset.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE = 400_000  # merged pieces that a Python worker keeps
LONG = 64  # longer pieces are merged with a heap and not kept
CHUNK = 1 << 20  # code points that are scanned, and given on, together

# The code points that a pattern's \s matches (Unicode White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Where Unicode 16, the pattern library's version, has letters and digits that an older interpreter may lack.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]

END = 0x110000  # stands between texts
LETTER, NUMBER, OTHER, SPACE_THEN_WORD, WHITE_THEN_WORD, WHITE, APOSTROPHE_1, APOSTROPHE_2, STOP = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a match begins, both by symbol * 8 + state."""
    to, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        to[symbol] = own
        begins[symbol, [own, AFTER_SPACE]] = False
    to[LETTER, ONE_MORE], to[LETTER, TWO_MORE] = FRESH, ONE_MORE  # the letters of a contraction, which ends there
    begins[LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, own in ((APOSTROPHE_1, ONE_MORE), (APOSTROPHE_2, TWO_MORE)):
        to[symbol] = own
        to[symbol, [IN_OTHER, AFTER_SPACE]] = IN_OTHER  # within a run of other signs it is one of them
        begins[symbol, [IN_OTHER, AFTER_SPACE]] = False
    to[SPACE_THEN_WORD] = AFTER_SPACE
    to[WHITE] = IN_WHITE
    begins[WHITE, IN_WHITE] = False
    return to.ravel(), begins.ravel()


TO, BEGINS = automaton()


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, WHITE or STOP of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(END)), np.uint8, END)
    out[WHITE_SPACE] = WHITE
    for first, last in UNICODE_16:
        for c in range(first, last + 1):
            if unicodedata.category(chr(c)) == "Cn":
                out[c] = LETTER if regex.match(r"\p{L}", chr(c)) else NUMBER if regex.match(r"\p{N}", chr(c)) else OTHER
    return np.append(out, np.uint8(STOP))


def symbols(points: np.ndarray) -> np.ndarray:
    """The automaton's symbols for code points; the last point is END."""
    out = classes()[points]
    after = np.append(out[1:], np.uint8(STOP))
    word_next = (out == WHITE) & (after < SPACE_THEN_WORD)
    out[word_next] = WHITE_THEN_WORD
    out[word_next & (points == 0x20)] = SPACE_THEN_WORD
    for at in np.flatnonzero(points == ord("'")).tolist():
        a, b = (chr(x) if x < END else "" for x in (points[at + 1], points[min(at + 2, len(points) - 1)]))
        if a in ("s", "t", "m", "d"):
            out[at] = APOSTROPHE_1
        elif a + b in ("re", "ve", "ll"):
            out[at] = APOSTROPHE_2
    return out


def starts(points: np.ndarray) -> np.ndarray:
    """Where matches of the pattern begin, and every END."""
    n = len(points)
    width = max(1, int(n**0.5))
    blocks = -(-n // width)
    padded = np.full(blocks * width, STOP * 8, np.uint8)
    padded[:n] = symbols(points) * 8
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    block = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:  # each block's function, for all states at once
        block = TO[column[:, None] + block]
    shift = 1
    while shift < blocks:  # prefixes of blocks, by doubling
        block[shift:] = np.take_along_axis(block[shift:], block[:-shift], axis=1)
        shift *= 2
    state = np.append(np.uint8(FRESH), block[:-1, FRESH])
    marks = np.empty(columns.shape, bool)
    for j, column in enumerate(columns):
        at = column + state
        marks[j] = BEGINS[at]
        state = TO[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def slices(texts: list[str]) -> list[list[bytes]]:
    """The pieces of each text: what the pattern's successive matches cover."""
    stop = np.array([END], np.uint32)
    points = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), stop)] or [stop[:0]])
    if not len(points):
        return []
    data = "".join(texts).encode()
    widths = np.where(points == END, 0, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    begin = starts(points)
    offsets = np.concatenate([[0], np.cumsum(widths)])[begin].tolist()
    ends = np.flatnonzero(points[begin] == END).tolist()
    out, first = [], 0
    for end in ends:
        out.append([data[a:b] for a, b in zip(offsets[first:end], offsets[first + 1 : end + 1], strict=True)])
        first = end + 1
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank is joined first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= LONG:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], END) for i in range(n - 1)]
        while pairs and (rank := min(pairs)) != END:
            i = pairs.index(rank)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], END)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], END)
        return [ranks[p] for p in parts]
    end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        if end[i] < n and (rank := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if end[i] != middle or end[middle] != last:  # one of the two has been joined meanwhile
            continue
        end[i], end[middle] = last, -1
        if last < n:
            before[last] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pieces = Pieces(self.ranks)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in slices(texts)]

    def offsets(self, ids: bytes) -> bytes:
        """Each token's first byte in its text, as little-endian unsigned 32-bit integers (a Spark value has under 2 GB)."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        return (np.cumsum(lengths) - lengths).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        tokens, at = np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        lengths = self.lengths[tokens]
        out = np.empty(int(at[-1] + lengths[-1]) if len(at) else 0, np.uint8)
        step = 1 << 20
        for i in range(0, len(tokens), step):
            part, size = at[i : i + step], lengths[i : i + step]
            source = np.repeat(self.begins[tokens[i : i + step]] - part, size) + np.arange(part[0], part[-1] + size[-1])
            out[part[0] : part[-1] + size[-1]] = self.data[source]
        return out.tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def grouped(texts: list[str]):
    """Positions of successive texts with about CHUNK code points together."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHUNK:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def mapped(docs: DataFrame, path: str | None, text: str, new: tuple[str, ...]) -> DataFrame:
    """``docs`` with the binary columns ``new``; a task holds the results of one group of texts at a time."""
    path = path or tokenizer_path(VOCABULARY)
    docs = docs.drop(*[n for n in new if n != text])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in new]])

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in grouped(texts):
                out = {"ids": words.encode(texts[a:b])}
                out["offsets"] = list(map(words.offsets, out["ids"]))
                if "decoded" in new:
                    out["decoded"] = list(map(words.decode, out["ids"], out["offsets"]))
                columns = [*batch.slice(a, b - a).columns, *[pa.array(out[n], pa.binary()) for n in new]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``offsets`` (binary): token ids and their byte
    offsets, both as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens. A text of any length is encoded whole.
    Rows that repeat are encoded alike; an empty table gives no rows.
    Columns of ``docs`` with these names are replaced, the others stay as they
    are. No special tokens exist: their strings are ordinary text.
    """
    return mapped(docs, path, text, ("ids", "offsets"))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """As encode, with ``decoded`` (binary), the bytes that the ids give back, in the same pass."""
    return mapped(docs, path, text, ("ids", "offsets", "decoded"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(ids, offsets, ...)`` with ``decoded`` (binary), the bytes that the tokens stand for."""
    path = path or tokenizer_path(VOCABULARY)

    @F.pandas_udf(T.BinaryType())
    def run(ids: pd.Series, offsets: pd.Series) -> pd.Series:
        words = vocabulary(path)
        return pd.Series([words.decode(a, b) for a, b in zip(ids, offsets, strict=True)], dtype=object)

    return encoded.withColumn("decoded", run("ids", "offsets"))


def op10_byte_bpe(spark, sf_dir):
    """Digests of every document's ids and of the bytes decoded from them."""
    done = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
