"""Joins that survive hot keys, and distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import materialize

#: A key is hot when it holds more than this many rows and more than one row in HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 1000


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """Inner join of many ``rows`` with one row per key in ``groups``, whose ``size_col`` counts the key's rows.

    Keys above one row in HOT_SHARE are fewer than HOT_SHARE by counting, so that part of ``groups``
    has a proven bound and is broadcast; the other keys are shuffled, none of them large.
    """
    bound = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = F.broadcast(groups.filter(F.col(size_col) > bound)), groups.filter(F.col(size_col) <= bound)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that links reach.

    Alternating large-star and small-star steps; each round is written to the shared folder, so the
    plan stays short and a lost executor costs one round at most.  Edges never grow in number.
    """
    state = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    seen = _mark(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = state.select(F.col("m").alias("u"), F.col("v").alias("w")).unionByName(state.select(F.col("v").alias("u"), F.col("m").alias("w")))
        large = _star(both, 2 * seen[0]).filter("w > u").select(F.col("w").alias("v"), F.col("least").alias("m"))
        down = materialize(large.distinct())
        low = _star(down.select(F.col("v").alias("u"), F.col("m").alias("w")), seen[0])
        small = low.filter("w <> least").select(F.col("w").alias("v"), F.col("least").alias("m")).unionByName(low.select(F.col("u").alias("v"), F.col("least").alias("m")))
        state = materialize(small.distinct())
        now = _mark(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return state.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(state.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())


def _star(rows: DataFrame, total: int) -> DataFrame:
    """(u, w, least): every neighbour of u with the smallest of u and its neighbours."""
    groups = rows.groupBy("u").agg(F.min("w").alias("least"), F.count("*").alias("degree")).select("u", F.least("u", "least").alias("least"), "degree")
    return join_hot(rows, groups, ["u"], "degree", total).select("u", "w", "least")


def _mark(state: DataFrame) -> tuple:
    row = state.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
    return row[0], row[1]
