"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its word pairs and its pairs with one word
between (skip-grams).  FTRL-proximal keeps a learning rate per coordinate, and its L1 term leaves
only a few hundred weights other than zero; these go to the tasks as two short arrays.

Fitting reads a bounded sample: of each label at most ``SAMPLE_PER_LABEL`` ids, those with the
smallest hashes, one text per id and exact repeats of a text once; it runs in one task, and only the
sparse weights reach the driver.  Scoring covers every row and whole texts.

Defined cases: null and empty texts score by the intercept alone; without any usable label every
score is 0; a score of exactly one half predicts 1; of several labels of one id the largest counts, of
several texts the smallest; texts above ``SAMPLE_CHARS`` characters are scored whole and not learned
from; repeated rows give one row each; null ids are scored and never learned from; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import crc_mod, release_memory, small_batches, workspace
from studyloom.llm.sampling import bounded_sample, fit_in_task

#: Bound of the labelled sample that the model is fitted on, for each label.
SAMPLE_PER_LABEL = 4000
#: Longer texts are not learned from; every text is scored, whatever its length.
SAMPLE_CHARS = 100_000
#: Rows whose id's crc32 leaves this remainder are held out and never learned from.
FOLDS, HELD_OUT = 5, 0
BITS = 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Odd multipliers that mix a word's hash by its place in an n-gram.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower().encode("utf-8", "replace"))
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def feature_slots(hashes: np.ndarray) -> np.ndarray:
    """Slots of the words, pairs and skip pairs, in [0, 2**BITS)."""
    shift = np.uint32(32 - BITS)
    a = hashes * MIX[0]
    parts = [(a ^ (a >> np.uint32(15))) * MIX[3] >> shift]
    for gap, (left, right) in ((1, (MIX[1], MIX[2])), (2, (MIX[4], MIX[1]))):
        if len(hashes) > gap:
            pair = hashes[:-gap] * left + (hashes[gap:] ^ (hashes[gap:] >> np.uint32(13))) * right
            parts.append((pair ^ (pair >> np.uint32(16))) * MIX[3] >> shift)
    return np.concatenate(parts)


@dataclass
class Ftrl:
    """FTRL-proximal for binary logistic loss, with features of value 1 and an unpenalised intercept."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    size: int = 1 << BITS
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n, self.bias = np.zeros(self.size), np.zeros(self.size), np.zeros(2)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def intercept(self) -> float:
        return -self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha)

    def step(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.intercept()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        rate = (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / self.alpha
        self.bias += (g - rate * b, g * g)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    fitted: bool = True

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.slots] = self.weights
        return dense

    def score(self, text: str | None, dense: np.ndarray) -> float:
        if not self.fitted:
            return 0.0
        slots = feature_slots(word_hashes(text))
        held = dense[slots]
        hit = np.unique(slots[held != 0])
        return float(1 / (1 + np.exp(-np.clip(float(dense[hit].sum(dtype=np.float64)) + self.intercept, -35, 35))))


def train(texts: list[str], labels: list[int], epochs: int = 3, **options) -> Model:
    if len(set(labels)) < 2:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), 0.0, False)
    model = Ftrl(**options)
    rows = [(np.unique(feature_slots(word_hashes(t))), float(y)) for t, y in zip(texts, labels, strict=True)]
    order = np.random.default_rng(17)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.step(*rows[k])
    every = np.arange(model.size)
    weights = model.weights(every)
    kept = np.flatnonzero(weights)
    return Model(kept, weights[kept].astype(np.float32), float(model.intercept()))


def sample(df: DataFrame, labels: DataFrame, label_col: str, text_col: str, id_col: str, per_label: int, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, label, text) of the bounded sample: at most 2 * per_label rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod("id", FOLDS) != HELD_OUT))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(crc_mod("id", FOLDS) != HELD_OUT)
    return bounded_sample(texts, known, per_label, 2, most_chars)


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", per_label: int = SAMPLE_PER_LABEL, **options) -> Model:
    """The model of the sample; a text that several ids share has the label of most of them, the higher one in a tie."""

    def learn(rows: list[dict]) -> Model:
        votes: dict[str, list[int]] = {}
        for row in sorted(rows, key=lambda r: (r["id"], r["text"])):
            votes.setdefault(row["text"], []).append(row["label"])
        return train(list(votes), [int(2 * sum(v) >= len(v)) for v in votes.values()], **options)

    with workspace(df.sparkSession):
        return fit_in_task(sample(df, labels, label_col, text_col, id_col, per_label), learn)


def score_texts(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, score) of every row, with the columns named in ``keep`` passed through."""
    small_batches(df.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.table()
        for batch in batches:
            scores = [model.score(t, dense) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(scores, pa.float64())], names=[*out_names, "score"])
        release_memory()

    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep or [])]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *kept)
    out_names = ["id", *(f"c{k}" for k in range(len(kept)))]
    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in out_names)
    scored = source.mapInArrow(score, f"{schema}, score double")
    return scored.select(F.col("id").alias(id_col), *(F.col(f"c{k}").alias(c) for k, c in enumerate(keep or [])), "score")


def toxicity_report(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    scored = score_texts(df, fit(df, labels, **options))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
