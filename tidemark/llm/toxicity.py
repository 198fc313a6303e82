"""Toxicity: a logistic classifier on words, regularised by counterfactuals.

Features are the different words of a text; those kept are significantly tied to
the label in the training rows, plus all identity terms. Two kinds of counterfactuals
are made of the training texts, and the squared change of the score (before the
logistic function) from text to counterfactual is added to the loss. Each identity
term in a text is swapped for the other terms of its group: a mention of one group
isn't scored unlike another. And one term that the text doesn't have, drawn by the
row's number, is mentioned in it, which also works where no text names a group: a
neutral mention by itself is no reason for a high score.

The model is fitted on a bounded sample of labelled rows, MAX_ROWS at most; word
statistics of the sample are counted by Spark, and only the few kept words of the
sample's texts come to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged, table, whole_row

MAX_ROWS = 20_000  # labelled rows that a model is fitted on, at most
SIGNIFICANT = 15.0  # chi-square of a word and the label
LEAST = 3  # texts that a word must be in
RIDGE = 0.3
SWAPS = 1.0  # weight of the counterfactual loss
ROUNDS = 300
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")

# Identity terms, by group; terms of one group are swapped for each other.
IDENTITY = [
    ["men", "women", "boys", "girls", "transgender"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"],
    ["gay", "lesbian", "bisexual", "heterosexual", "straight", "queer"],
    ["african", "american", "arab", "asian", "european", "indian", "latino", "mexican"],
    ["blind", "deaf", "disabled"],
    ["black", "white"],
    ["old", "young"],
]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    swaps: int = 0  # counterfactuals that the fit used: terms swapped,
    mentions: int = 0  # and terms mentioned anew

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[w] for w in self.weights.keys() & set(words_of(text))))
        return float(1 / (1 + np.exp(-z)))


def words_of(text: str | None) -> list[str]:
    return sorted(set(WORD.findall(text.lower()))) if text else []


def held_out(doc_id):
    """Rows that a fit must not see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def swaps(rows: np.ndarray, columns: np.ndarray, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term's column, column of the term swapped in, whether that is new to the text) of every swap in the rows."""
    groups = {place[t]: [place[o] for o in g if o != t] for g in IDENTITY for t in g}
    named = np.isin(columns, list(groups))
    has = set(zip(rows[named].tolist(), columns[named].tolist(), strict=True))
    found = [(c, o, (r, o) not in has) for r, c in has for o in groups[c]]
    term, other, new = zip(*sorted(found), strict=True) if found else ((), (), ())
    return np.array(term, np.int64), np.array(other, np.int64), np.array(new, np.float64)


def mentions(rows: np.ndarray, columns: np.ndarray, n: int, place: dict[str, int]) -> np.ndarray:
    """A column for each of ``n`` rows: an identity term that the row doesn't have, drawn by its number; none for a row with all of them."""
    terms = np.array(sorted(place[t] for g in IDENTITY for t in g), np.int64)
    named = np.isin(columns, terms)
    has = set(zip(rows[named].tolist(), columns[named].tolist(), strict=True))
    drawn = [next((int(c) for c in np.roll(terms, -(row * 7 + 3) % len(terms)) if (row, int(c)) not in has), None) for row in range(n)]
    return np.array([c for c in drawn if c is not None], np.int64)


def fit_weights(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, size: int, swapped, mentioned: np.ndarray | None = None, strength: float = SWAPS) -> tuple[np.ndarray, float]:
    """Weights and bias for a sparse 0/1 matrix given by its ones; both classes count alike in the loss."""
    toxic = labels.sum()
    if not 0 < toxic < len(labels):
        return np.zeros(size), float(np.log((toxic + 0.5) / (len(labels) - toxic + 0.5)))
    share = np.where(labels == 1, (len(labels) - toxic) / toxic, 1.0)
    term, other, new = swapped
    named = np.bincount(mentioned, minlength=size) if mentioned is not None else np.zeros(size)
    w, b, sum_w, sum_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(rows, w[columns], len(labels)) + b
        error = (1 / (1 + np.exp(-z)) - labels) * share
        change = 2 * strength * (w[term] - new * w[other])
        step = np.bincount(columns, error[rows], size) + RIDGE * w + np.bincount(term, change, size) - np.bincount(other, change * new, size) + 2 * strength * named * w
        sum_w += step * step
        sum_b += error.sum() ** 2
        w -= 0.5 * step / np.sqrt(sum_w)
        b -= 0.5 * error.sum() / np.sqrt(sum_b)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, strength: float = SWAPS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Rows that are held out, have no id, or no label 0 or 1, aren't used; an id
    with several labels counts as toxic if one says so, and of several texts of an
    id that with the smallest hash is taken, so that the sample has ``max_rows``
    rows at most whatever repeats. Beyond ``max_rows`` ids those with the smallest
    hash are taken. Without both classes all texts get the share of the toxic ones
    as their score; without labels that is a half. ``strength`` weighs the
    counterfactual loss.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def split(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                yield pd.DataFrame({"toxic": part["toxic"], "words": [words_of(t) for t in part["text"]]})

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has max_rows rows at most
    sample = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    sample = staged(sample.mapInPandas(split, "toxic int, words array<string>").withColumn("row", F.monotonically_increasing_id()), "labelled")
    truth = sample.select("row", "toxic").orderBy("row").toArrow().to_pandas()
    n, n_toxic = len(truth), int(truth["toxic"].sum())
    identity = sorted({t for g in IDENTITY for t in g})
    seen, toxic = F.col("seen"), F.col("toxic")
    expected = seen * (n_toxic / max(1, n))
    chi = (toxic - expected) ** 2 / (expected * max(1e-9, 1 - n_toxic / max(1, n)) * (1 - seen / F.lit(max(1, n))) + 1e-9)
    counts = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("seen"), F.sum("toxic").alias("toxic"))
    best = counts.where(seen >= LEAST).withColumn("chi", chi).where(F.col("chi") >= SIGNIFICANT)
    kept = sorted({r.word for r in best.select("word").collect()} | set(identity))  # some of the sample's words
    place = {w: i for i, w in enumerate(kept)}
    at = docs.sparkSession.createDataFrame(list(place.items()), "word string, at int")
    ones = sample.select("row", F.explode("words").alias("word")).join(F.broadcast(at), "word").select("row", "at").toArrow().sort_by([("row", "ascending"), ("at", "ascending")]).to_pandas()
    rows, columns = np.searchsorted(truth["row"].to_numpy(), ones["row"].to_numpy()), ones["at"].to_numpy(dtype=np.int64)
    swapped, mentioned = swaps(rows, columns, place), mentions(rows, columns, n, place)
    w, b = fit_weights(rows, columns, truth["toxic"].to_numpy(dtype=np.float64), len(kept), swapped, mentioned, strength)
    return Model({word: float(x) for word, x in zip(kept, w, strict=True) if x}, b, len(swapped[0]), len(mentioned))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text, however long; null and empty texts get the bias alone."""

    @F.pandas_udf(T.DoubleType())
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in column], dtype="float64")

    return docs.withColumn(score, run(F.col(text)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns, whatever those are called.

    Null and empty texts score by the bias alone and repeated rows alike; rows
    without a label or an id are scored as all others. Without labels nothing goes.
    """
    return scored(docs.select(whole_row(docs), "text"), fit(docs, labels)).where(F.col("score") < threshold).select("row.*")


def op5_toxicity(spark, sf_dir):
    """A score for every document, by a model that saw no held-out label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
