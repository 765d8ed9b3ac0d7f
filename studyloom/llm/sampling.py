"""Bounded samples of labelled rows, and models that are fitted in a task instead of on the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import materialize, release_memory, small_batches

#: Slices that a label's ids fall into by their hash; a sample takes whole slices, smallest hashes first.
SLICES = 1024


def bounded_sample(docs: DataFrame, known: DataFrame, per_label: int, most_labels: int, most_chars: int) -> DataFrame:
    """(id, label, text): of each of the ``most_labels`` most frequent labels at most ``per_label`` (id, label) pairs of ``known``.

    ``docs`` is (id, text), or (id, label, text) where texts have labels of their own, and ``known`` (id,
    label), with any number of repeats.  Pairs are distinct
    before they are counted and an id's smallest text stands for all of its texts, so the bound is on
    rows, whatever repeats.  Texts above ``most_chars`` are not learned from.  No window and no sort: a label's
    pairs are counted by slices of their hash (``most_labels * SLICES`` counts at most reach the
    driver), and the slices that fit are taken.  What the sample holds depends on the ids alone.
    """
    pairs = materialize(known.distinct().withColumn("place", F.xxhash64("id").cast("double") / F.lit(2.0**64) + 0.5))
    totals = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()}  # at most most_labels rows
    if not totals:
        return docs.limit(0).select("id", F.lit(None).cast(known.schema["label"].dataType).alias("label"), "text")
    share = pairs.sparkSession.createDataFrame([(k, 2.0 * per_label / n) for k, n in totals.items()], pairs.select("label", F.lit(0.0).alias("share")).schema)
    sliced = pairs.join(F.broadcast(share), "label").withColumn("slice", F.floor(F.col("place") / F.col("share") * SLICES)).filter(F.col("slice") < SLICES)
    counts: dict[Any, list[tuple[int, int]]] = {}
    for r in sliced.groupBy("label", "slice").agg(F.count("*").alias("n")).collect():  # at most most_labels * SLICES rows
        counts.setdefault(r["label"], []).append((r["slice"], r["n"]))
    cuts = []
    for label, slices in counts.items():
        cut, left = 0, per_label
        for at, n in sorted(slices):
            if n > left:
                break
            cut, left = at + 1, left - n
        cuts.append((label, cut))
    cut = pairs.sparkSession.createDataFrame(cuts, sliced.select("label", F.lit(0).alias("cut")).schema)
    chosen = sliced.join(F.broadcast(cut), "label").filter(F.col("slice") < F.col("cut")).select("id", "label")
    keys = [c for c in ("id", "label") if c in docs.columns]
    texts = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= most_chars)
    return texts.join(F.broadcast(chosen), keys).groupBy("id", "label").agg(F.min("text").alias("text"))  # chosen: at most most_labels * per_label rows


def fit_in_task(rows: DataFrame, train: Callable[[list[dict]], Any]) -> Any:
    """The model that ``train`` makes of a bounded sample, worked out in one task; only the model reaches the driver."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in batch.to_pylist()]
        model = train(held)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        held = model = None
        release_memory()

    found = rows.repartition(1).mapInArrow(run, "model binary").first()  # None: an empty sample has no task
    return pickle.loads(found[0]) if found else train([])
