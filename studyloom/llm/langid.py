"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, every other character counts as a space, and the 1- to 3-grams of the
result are hashed into ``2**BITS`` slots.  A feature's value is its share of the text's n-grams times
its inverse document frequency in the fitted sample.  The weights are trained with
follow-the-regularised-leader steps under an elastic-net penalty (L1 keeps them sparse); a
temperature fitted on a part of the sample that training never saw calibrates the probabilities.

Fitting reads a bounded sample: of each of the ``MOST_LANGS`` most frequent languages at most
``SAMPLE_PER_LANG`` ids, those with the smallest hashes, one text per id; it runs in one task, and only
the sparse weights reach the driver.  Scoring covers every row and whole texts, a part at a time.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when
nothing could be learned; with one learned language every other text gets it with score 1; languages
that are equally likely go by name; of several texts with one id and language the smallest is learned, and
texts above ``SAMPLE_CHARS`` characters are predicted whole and not learned from; repeated rows give one
row each; null ids are predicted and never learned from; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import crc_mod, release_memory, small_batches, workspace
from studyloom.llm.sampling import bounded_sample, fit_in_task

#: Bound of the labelled sample that the model is fitted on, for each language.
SAMPLE_PER_LANG = 1000
#: Languages that are learned, the most frequent ones first; longer texts are not learned from.
MOST_LANGS, SAMPLE_CHARS = 200, 100_000
#: Rows whose id's crc32 leaves this remainder are held out and never learned from.
FOLDS, HELD_OUT = 4, 2
BITS, ORDERS = 17, 3
#: Characters worked on at once; n-grams that cross a cut are counted with the later part.
PART_CHARS = 32_768
UNDETERMINED = "und"
VALUE_SCALE = 10.0

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For every code point, itself if it is a letter and else a space."""
    global _letters
    if _letters is None:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for point in range(sys.maxunicode + 1):
            if unicodedata.category(chr(point))[0] == "L":
                table[point] = point
        _letters = table
    return _letters


def slots_of(points: np.ndarray, skip: int = 0) -> np.ndarray:
    """Hashed slots of the n-grams that end after the first ``skip`` characters."""
    shift = np.uint32(32 - BITS)
    parts = []
    for order in range(ORDERS):
        if len(points) <= order:
            break
        mixed = np.full(len(points) - order, order, np.uint32)
        for k in range(order + 1):
            mixed = (mixed ^ points[k : len(points) - order + k]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        parts.append((mixed * np.uint32(0x85EBCA77) >> shift)[max(0, skip - order) :])
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def parts_of(text: str | None) -> Iterator[np.ndarray]:
    """Slots of a whole text, part by part; nothing if it has no letter."""
    points = letter_table()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")]
    if not (points != 32).any():
        return
    for start in range(0, len(points), PART_CHARS):
        before = min(start, ORDERS - 1)
        yield slots_of(points[start - before : start + PART_CHARS], before)


@dataclass
class Model:
    langs: list[str]
    slots: np.ndarray
    weights: np.ndarray  # (slots, langs), inverse document frequency and temperature included
    bias: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros((1 << BITS, len(self.langs)), np.float32)
        dense[self.slots] = self.weights
        return dense

    def predict(self, text: str | None, dense: np.ndarray) -> tuple[str, float]:
        total, logits = 0, np.zeros(len(self.langs))
        if self.langs:
            for slots in parts_of(text):
                total += len(slots)
                logits += dense[slots].sum(axis=0, dtype=np.float64)
        if not total:
            return UNDETERMINED, 0.0
        p = softmax(logits / total + self.bias)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.3, epochs: int = 3) -> Model:
    names = sorted(set(langs))
    rows, at = [], {name: k for k, name in enumerate(names)}
    df = np.zeros(1 << BITS)
    for text, lang in zip(texts, langs, strict=True):
        parts = list(parts_of(text))
        if parts:
            slots, counts = np.unique(np.concatenate(parts), return_counts=True)
            df[slots] += 1
            rows.append((slots, counts / counts.sum(), at[lang]))
    if not rows:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty(0))
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    rng = np.random.default_rng(23)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    fit = order[len(rows) // 5 :] if len(rows) >= 20 else order
    z, n = np.zeros((1 << BITS, len(names))), np.zeros((1 << BITS, len(names)))
    zb, nb = np.zeros(len(names)), np.zeros(len(names))

    def weight(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(fit):
            slots, share, y = rows[k]
            value = (share * idf[slots] * VALUE_SCALE)[:, None]
            w, b = weight(z[slots], n[slots], l1, l2), weight(zb, nb, 0.0, 0.0)
            g = softmax((w * value).sum(axis=0) + b)
            g[y] -= 1
            step = g * value
            sigma = (np.sqrt(n[slots] + step * step) - np.sqrt(n[slots])) / alpha
            z[slots] += step - sigma * w
            n[slots] += step * step
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    weights, bias = weight(z, n, l1, l2) * (idf * VALUE_SCALE)[:, None], weight(zb, nb, 0.0, 0.0)
    logits = np.array([(weights[rows[k][0]] * rows[k][1][:, None]).sum(axis=0) + bias for k in held]).reshape(len(held), len(names))
    truth = np.array([rows[k][2] for k in held], int)
    heat = temperature(logits, truth)
    kept = np.flatnonzero(np.abs(weights).sum(axis=1))
    return Model(names, kept, (weights[kept] / heat).astype(np.float32), bias / heat)


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on the held part (golden section over its logarithm)."""
    if not len(truth) or logits.shape[1] < 2:
        return 1.0

    def loss(log_heat: float) -> float:
        return -float(np.log(softmax(logits / np.exp(log_heat))[np.arange(len(truth)), truth] + 1e-12).mean())

    low, high, ratio = -2.5, 2.5, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sample(df: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int, most_langs: int = MOST_LANGS, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, label, text) of the bounded sample: at most per_lang rows of each of the most_langs most frequent languages."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_mod("id", FOLDS) != HELD_OUT))
    return bounded_sample(rows, rows.select("id", "label"), per_lang, most_langs, most_chars)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, **options) -> Model:
    def learn(rows: list[dict]) -> Model:
        rows = sorted(rows, key=lambda r: (r["id"], r["label"], r["text"]))
        return train([r["text"] for r in rows], [r["label"] for r in rows], **options)

    with workspace(df.sparkSession):
        return fit_in_task(sample(df, text_col, lang_col, id_col, per_lang), learn)


def predict_languages(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row, with the columns named in ``keep`` passed through."""
    small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep or [])]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *kept)
    out_names = ["id", *(f"c{k}" for k in range(len(kept)))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.table()
        for batch in batches:
            found = [model.predict(t, dense) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*out_names, "lang_pred", "score"])
        release_memory()

    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in out_names)
    scored = source.mapInArrow(predict, f"{schema}, lang_pred string, score double")
    return scored.select(F.col("id").alias(id_col), *(F.col(f"c{k}").alias(c) for k, c in enumerate(keep or [])), "lang_pred", "score")


def language_report(df: DataFrame, **options) -> DataFrame:
    predicted = predict_languages(df, fit(df, **options))
    return predicted.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
