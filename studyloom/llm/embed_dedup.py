"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine verification, components.

Every vector gets one key in each of L tables, the signs of its products with k random hyperplanes.
k grows with the logarithm of the number of vectors, so random collisions stay in proportion to the
input; L follows from k so that a pair right at the threshold shares a key with the chance
``RECALL``, and closer pairs do far more often.

Equal vectors are collapsed first, by two 64-bit hashes, into one vector with a count; everything below
works on distinct vectors, so a group of copies, however large, costs one row.  A task clusters the
vectors of one batch that share a key around leaders, with exact cosines.  Leaders that meet are paired
(all pairs in ordinary buckets, pairs with the first in large ones), verified exactly, and joined with
the batch links into connected components.  In every key that this does not settle (it has members besides leaders, or is large) all
vectors of different components are then compared, in large keys as matrix products in blocks, so a
pair that shares a key is either verified or inside one component.  Inside a component every pair of
vectors is compared the same way, so ``n_links`` counts all links of its members and no list of pairs
of a large group is ever built; a block pair is a task of its own, so n distinct vectors of a component
are copied ``n / BLOCK_ROWS`` times.

Tables: for n vectors, about n ** 0.22 of them, as sign hashing needs for a fixed chance at the threshold.

Defined cases: a null, empty or zero vector, or one with a null or non-finite component, links with
nothing; vectors of different length never link; rows that share an id are one vector (the smallest
as an array) and get one row each with the same answer; a row with a null id links with nothing and
is its own component (null); ids are integers, other types raise TypeError; ties at the threshold link; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import materialize, small_batches, workspace
from studyloom.llm.graph import connected_components, join_hot

THRESHOLD = 0.9
#: Chance that a pair exactly at the threshold shares a key of some table.
RECALL = 0.97
#: Bits beyond log2 of the number of vectors.
SPARE_BITS = 3
#: Vectors that a task clusters and hashes at a time.
BATCH_ROWS = 8192
#: Buckets up to this size pair all their leaders; larger ones pair by components.
BUCKET_ALL = 64
#: Keys of larger buckets up to this count are broadcast, more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Vectors in one block of a component's comparison.
BLOCK_ROWS = 1024
SEED = 20240501


def table_shape(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits per key, number of tables) for so many vectors."""
    bits = min(60, max(6, math.ceil(math.log2(max(2, rows))) + SPARE_BITS))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    matrix = np.asarray(vectors, np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def unit_groups(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    flat, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(bounds)
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        yield mine, unit_vectors(flat[bounds[mine][:, None] + np.arange(dim)])


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def keys_of(units: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) 64-bit keys; table, dimension and signs all enter a key."""
    dim = units.shape[1]
    out = np.empty((len(units), tables), np.int64)
    place = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for t in range(tables):
        planes = np.random.default_rng([seed, dim, t]).standard_normal((dim, bits))
        signs = ((units @ planes) >= 0).astype(np.uint64) @ place
        offset = (t * 1_000_003 + dim + 1) * 0x9E3779B97F4A7C15 % 2**64
        mixed = (signs + np.uint64(offset)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        out[:, t] = (mixed * np.uint64(0x94D049BB133111EB)).view(np.int64)
    return out


def lead(ids: np.ndarray, units: np.ndarray, threshold: float) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Leaders among vectors that share a key, members that differ from their leader, and the verified (leader, member) links."""
    left, leaders, members, links = np.arange(len(ids)), [], [], []
    while len(left):
        head, rest = left[0], left[1:]
        leaders.append(int(head))
        close = units[rest] @ units[head] >= threshold
        links += [(int(ids[head]), int(i)) for i in ids[rest[close]]]
        members += rest[close][(units[rest[close]] != units[head]).any(axis=1)].tolist()
        left = rest[~close]
    return leaders, members, links


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, k1, k2): one valid vector per id, with the hashes that name it."""
    kind = vectors.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids are integers, not {kind}")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.filter(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    one = fine.groupBy("id").agg(F.min("v").alias("v"))
    return one.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"))


def distinct_vectors(valid: DataFrame) -> DataFrame:
    """(k1, k2, id, copies, v): one row per distinct vector, with the smallest id that has it."""
    return valid.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("v").alias("v"))


def find_links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b): verified links that connect all near-duplicates found; not all pairs of a group."""
    total = vectors.count()
    bits, tables = table_shape(total, threshold, recall)
    spark = vectors.sparkSession
    small_batches(spark)

    def hash_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BATCH_ROWS):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for mine, units in unit_groups(batch.column(1)):
                own, keys = ids[mine], keys_of(units, bits, tables)
                links: set[tuple[int, int]] = set()
                for t in range(tables):
                    order = np.lexsort((own, keys[:, t]))
                    column = keys[order, t]
                    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
                    ends = np.r_[starts[1:], len(column)]
                    travels, leads = np.ones(len(order), bool), np.ones(len(order), bool)
                    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                        group = order[s:e]
                        leaders, members, found = lead(own[group], units[group], threshold)
                        links.update(found)
                        travels[s:e] = leads[s:e] = False
                        travels[s + np.array(leaders + members)] = True
                        leads[s + np.array(leaders)] = True
                    yield pa.RecordBatch.from_arrays([pa.array(column[travels]), pa.array(own[order][travels]), pa.nulls(int(travels.sum()), pa.int64()), pa.array(leads[travels])], names=["key", "id", "b", "leads"])
                if links:
                    pairs = np.array(sorted(links), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.bool_())], names=["key", "id", "b", "leads"])

    hashed = materialize(vectors.mapInArrow(hash_batch, "key bigint, id bigint, b bigint, leads boolean"))
    local = hashed.filter("key IS NULL").select(F.col("id").alias("a"), "b")
    leaders = hashed.filter("leads").select("key", "id")
    large = materialize(leaders.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first")).filter(F.col("size") > BUCKET_ALL))
    keys = F.broadcast(large.select("key")) if large.count() <= BROADCAST_KEYS else large.select("key")
    everyone = F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x AS a, y AS b))))"))
    few = leaders.join(keys, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter("size(ids) > 1")  # at most BUCKET_ALL in a list
    first = join_hot(leaders, large, ["key"], "size", large.agg(F.sum("size")).first()[0] or 0).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = few.select(everyone.alias("p")).select("p.*").unionByName(first).distinct()
    links = materialize(local.unionByName(verify(pairs, vectors, threshold)).distinct())
    return links.unionByName(cross_links(hashed.filter("key IS NOT NULL").select("key", "id", "leads"), links, vectors, threshold)).distinct()


def cross_links(rows: DataFrame, links: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between the components of ``links`` that share a key, at least one where two components have any."""
    unsettled = materialize(rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if("leads").alias("n")).filter((F.col("size") > F.col("n")) | (F.col("n") > BUCKET_ALL)).select("key", "size"))
    total = unsettled.agg(F.sum("size")).first()[0]
    if not total:
        return links.limit(0)
    held = join_hot(rows.select("key", "id"), unsettled, ["key"], "size", total).select("key", "id")
    held = materialize(held.join(connected_components(links), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    groups = held.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key", "size")
    held = materialize(join_hot(held, groups, ["key"], "size", total))
    other = "transform(filter(slice(ids, i + 2, size(ids)), y -> y.component <> x.component), y -> struct(x.id AS a, y.id AS b))"
    few = held.filter(F.col("size") <= BUCKET_ALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "component"))).alias("ids"))
    few = few.select(F.explode(F.expr(f"flatten(transform(ids, (x, i) -> {other}))")).alias("p")).select("p.*").distinct()
    return verify(few, vectors, threshold).unionByName(block_links(held.filter(F.col("size") > BUCKET_ALL), vectors, threshold))


def block_links(held: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Links that join the components of every key in ``held`` (key, id, component, size), compared in blocks."""
    placed = held.withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(vectors, "id")
    dealt = placed.select("key", "id", "v", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "id", "v", "component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        component, places = np.unique(group.column("component").to_numpy(), return_inverse=True)
        found = []
        if len(component) > 1:
            near = np.zeros((len(component), len(component)), bool)
            for mine, units in unit_groups(group.column("v").combine_chunks()):
                i, j = np.nonzero(units @ units.T >= threshold)
                near[places[mine[i]], places[mine[j]]] = True
            left = np.ones(len(component), bool)
            while left.any():  # one tree of links per set of components that meet
                head = int(np.argmax(left))
                left[head] = False
                queue = [head]
                while queue:
                    more = np.flatnonzero(near[queue.pop()] & left)
                    left[more] = False
                    queue += more.tolist()
                    found += [(int(component[head]), int(component[k])) for k in more]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("key", "p", "q").applyInArrow(link, "a bigint, b bigint")


def verify(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact cosine meets the threshold."""
    left, right = vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").filter(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (mine, x), (_, y) in zip(unit_groups(batch.column(2)), unit_groups(batch.column(3)), strict=True):  # sizes agree row by row
                close = mine[np.einsum("ij,ij->i", x, y) >= threshold]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(close)), batch.column(1).take(pa.array(close))], names=["a", "b"])

    return both.mapInArrow(check, "a bigint, b bigint")


def count_links(members: DataFrame, total: int, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links) of ``members`` (id, copies, component, v): the copies of other vectors linked with each, all pairs within a component compared in blocks."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    placed = join_hot(members, sizes, ["component"], "size", total).withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.select("id", "copies", "v", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("id", "copies", "v", "component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block")

    def count(key: tuple, group: pa.Table) -> pa.Table:
        _, p, q = (k.as_py() for k in key)
        group = group.combine_chunks()
        ids, block, copies = (group.column(c).to_numpy() for c in ("id", "block", "copies"))
        found = np.zeros(len(ids), np.int64)
        for mine, units in unit_groups(group.column("v").combine_chunks()):
            if p == q:
                found[mine] = (units @ units.T >= threshold) @ copies[mine] - copies[mine]
            else:
                first, second = block[mine] == p, block[mine] == q
                close = units[first] @ units[second].T >= threshold
                found[mine[first]], found[mine[second]] = close @ copies[mine[second]], copies[mine[first]] @ close
        return pa.table({"id": ids, "n": found})

    return dealt.groupBy("component", "p", "q").applyInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n_links"))


def dedup_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    with workspace(vectors.sparkSession) as finish:
        valid = materialize(usable(vectors, id_col, vector_col))
        nodes = materialize(distinct_vectors(valid))
        components = materialize(connected_components(find_links(nodes.select("id", "v"), threshold, recall)))
        members = materialize(nodes.join(components, "id").select("id", "copies", "component", "v"))
        links = count_links(members, members.count(), threshold)
        of_node = nodes.select("k1", "k2", "id", "copies").join(components, "id", "left").join(links, "id", "left")
        of_node = materialize(of_node.select("k1", "k2", "copies", F.coalesce("component", "id").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        answers = join_hot(valid.select("id", "k1", "k2"), of_node, ["k1", "k2"], "copies", valid.count()).select("id", "n_links", "component")
        out = vectors.select(F.col(id_col).alias("id")).join(answers, "id", "left")
        out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id"))
        return finish(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def oracle() -> str:
    """DuckDB: all pairs by brute force, components by a recursive closure."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(DISTINCT b) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id)::BIGINT AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""
