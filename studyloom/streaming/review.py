"""The review log as a stream: card state kept by an arbitrary stateful operator.

The batch form (``operators.exposure.card_state``) replays the log in closed form and is the oracle
of this one.  A stream sees answers in arrival order, so late answers are sorted within a batch and
answers older than the last one of a card only count as reviews.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from studyloom.schema import REVIEW_LOG

STATE = "reviews long, correct long, last_at timestamp, interval_days double"
OUT = "card_id string, reviews long, correct long, last_at timestamp, interval_days double"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """JSON lines appended under ``path``; lines that do not parse are dropped."""
    return spark.readStream.schema(REVIEW_LOG).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path).filter("card_id IS NOT NULL AND at IS NOT NULL")


def card_states(log: DataFrame, ratio: float = 2.5, most: float = 365.0) -> DataFrame:
    """A stream of the cards' states after each trigger (update mode)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reviews, correct, last_at, interval = state.get if state.exists else (0, 0, None, 0.0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for answer in rows.itertuples():
            right = bool(answer.correct)
            reviews, correct = reviews + 1, correct + right
            if last_at is None or answer.at >= pd.Timestamp(last_at):
                interval = min(interval * ratio, most) if right and interval > 0 else 1.0
                last_at = answer.at.to_pydatetime()
        state.update((reviews, correct, last_at, interval))
        yield pd.DataFrame({"card_id": [key[0]], "reviews": [reviews], "correct": [correct], "last_at": [last_at], "interval_days": [interval]})

    return log.select("card_id", "at", F.coalesce("correct", F.lit(False)).alias("correct")).groupBy("card_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def accuracy_by_window(log: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Answers and accuracy per tumbling window, late answers allowed up to a watermark."""
    return log.withWatermark("at", late).groupBy(F.window("at", length)).agg(F.count("*").alias("answers"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def append_answers(answers: DataFrame, path: str) -> None:
    """Append to the log; state is never stored, only answers."""
    answers.write.mode("append").json(path)
