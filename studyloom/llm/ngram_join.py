"""N-gram Jaccard join: exact near-duplicate classes by set-relation skipping.

A text's set holds its distinct five-word shingles as 64-bit hashes.  Two sets link when
``100 * |x & y| >= 75 * |x | y|``.  The result is the class of every text under the links; no list of
all pairs of a group is ever built, yet no link between different texts is lost:

* Nodes: texts with equal sets (128-bit fingerprints) are one node, found by a grouped minimum, so a
  group of copies costs one row whatever its size; one text of each node is kept for what follows.
* Order: shingles that many nodes hold come last, the rest first, each part by hash.  Every shingle of
  every node is counted exactly through a shuffle of four bytes per shingle, and one bit per shingle
  goes back to the group of texts that it came from; nothing about shingles reaches the driver or a
  task closure, and the least count of a frequent shingle is the same at every size.
* Index: only the prefix of a set, its first ``n - ceil(3n / 4) + 1`` shingles, enters the inverted
  lists.
* Skipping: a list knows each set's size and how many shingles follow the shared one.  Pairs whose
  sizes or remaining shingles cannot reach the needed overlap are skipped, block by block where a
  list is long.
* Set relations: in a long list every set is first compared with the list's first set and with its
  neighbours only.  A set that links takes over the answers of the set it links to: pairs inside a class
  that is already connected are not compared again, lists of one class are dropped, and only pairs
  of different classes remain for later rounds.  There a list is dealt as pairs of blocks, so no task
  holds more than two blocks of it, parity sketches reject pairs before they are emitted, and a set sends
  its nearest candidates only.  What links joins classes; the others follow in further rounds, each with
  more candidates a set, until no task holds one back.  So a large group emits rows in proportion to its
  sets and its pairs are never all written.
* Verification: the sketch bounds the symmetric difference from below and rejects most pairs; what is
  left is intersected exactly.

Defined cases: null, empty and blank texts have an empty set that links with nothing; with fewer
words than a shingle the whole sequence is the one shingle; rows that share an id are one node with
several sets; a row with a null id gets a null class and links with nothing; repeated rows give one
row each; ids are integers, other types raise TypeError; a tie at the threshold links; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from studyloom.llm.common import materialize, release_memory, small_batches, workspace
from studyloom.llm.graph import connected_components, join_hot

SHINGLE = 5
#: Link when LINK_TOP * intersection >= LINK_LOW * union.
LINK_TOP, LINK_LOW = 100, 75
#: A shingle is frequent when so many different sets hold it.
FREQUENT_LEAST = 16
#: Bytes of text in one group, whose shingles are dealt out and flagged together, and for one part of the inverted lists.
GROUP_BYTES, PART_BYTES = 8 << 20, 2 << 20
#: Texts travel as zstd frames of this level: shuffles and tables pack the bytes of one text less well.
PACK_LEVEL = 1
#: Marks that a task remembers to send each text once.
MARKS_HELD = 1_000_000
#: Lists up to this length pair all their sets at once.
SHORT_LIST = 8
#: Sets that follow a set in a long list and are compared with it in the first round.
NEIGHBOURS = 2
#: Sets compared at a time in a long list, and sets in a block of one task.
BLOCK, TASK_BLOCK = 256, 4096
#: Candidates of a set that a task emits in the first of the later rounds, and the factor from round to round.
NEAREST, NEAREST_STEP = 1, 8
#: Candidate pairs that a task holds before it keeps the nearest only.
KEPT_PAIRS = 2_000_000
#: Candidate pairs whose sketches are compared at a time.
SKETCH_PAIRS = 100_000
#: The most parts of the inverted lists there may be.
MOST_PARTS = 1 << 20
#: Nodes up to this count may be broadcast to select the texts that need exact verification.
BROADCAST_IDS = 500_000

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
ENTRY = np.dtype([("token", "<u4"), ("node", "<i8"), ("size", "<u4"), ("rest", "<u2")])


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed += hashes[k : k + len(mixed)] * MULTIPLIERS[k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection of linked sets of these sizes."""
    total = (a.astype(np.int64) + b) * LINK_LOW
    return -(-total // (LINK_TOP + LINK_LOW))


def sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.int64), np.asarray(b, np.int64)
    return np.minimum(a, b) * LINK_TOP >= np.maximum(a, b) * LINK_LOW


def prefix_length(size: int) -> int:
    return size + (-LINK_LOW * size // LINK_TOP) + 1


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2**k cells, about two cells per shingle."""
    cells = 64
    while cells < 2 * len(shingles):
        cells *= 2
    parity = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference; the longer sketch folds onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def place_of(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, 32-bit token) of shingles; together they name a shingle's inverted list."""
    return ((shingles & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32), (shingles >> np.uint64(32)).astype("<u4")


def packed_parts(part: np.ndarray, values: np.ndarray, kind: str) -> pa.RecordBatch:
    """One row per part with its values as bytes."""
    order = np.argsort(part, kind="stable")
    part, values = part[order], values[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    return rows_of(kind=kind, part=part[starts].astype(np.int32), blob=[values[s:e].tobytes() for s, e in zip(starts, ends, strict=True)])


def ordered_sets(group: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct nodes among a group's rows with a text, in the order of their marks, and their sets."""
    texts = {}
    for mark, text in zip(group.column("mark").to_pylist(), group.column("text").to_pylist(), strict=True):
        if text is not None:
            texts.setdefault(mark, text)
    marks, unpack = sorted(texts), zstandard.ZstdDecompressor().decompress
    return marks, [shingle_set(unpack(texts[m])) for m in marks]


def profiled(texts: DataFrame) -> DataFrame:
    """(id, n, mark, text, bytes) of every row of (id, text); the text rides along, packed, where its set is the task's first of that mark."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL).compress
        for batch in batches:
            sizes, marks, carried, lengths = [], [], [], []
            ids = batch.column(0).to_pylist()
            for doc, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = shingle_set(text)
                mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                fresh = doc is not None and len(found) and mark not in known
                if fresh:
                    known.add(mark)
                sizes.append(len(found))
                marks.append(mark)
                carried.append(pack(text) if fresh else None)
                lengths.append(len(text) if fresh else 0)
            if len(known) > MARKS_HELD:
                known = set()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(carried, pa.binary()), pa.array(lengths, pa.int64())], names=["id", "n", "mark", "text", "bytes"])
        known = set()
        release_memory()

    return texts.mapInArrow(profile, "id bigint, n bigint, mark binary, text binary, bytes bigint")


def frequent_flags(carried: DataFrame, parts: int) -> DataFrame:
    """(grp, part, blob): for each group of texts and part, a bit per shingle in dealt order that says whether FREQUENT_LEAST sets or more hold it."""

    def deal(group: pa.Table) -> pa.Table:
        grp = group.column("grp")[0].as_py()
        sets = ordered_sets(group)[1]
        out = pa.Table.from_batches([packed_parts(*place_of(np.concatenate(sets), parts), "tokens")], ROWS)
        return out.set_column(2, "a", pa.array(np.full(out.num_rows, grp), pa.int64()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            for part, grp, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(6), strict=True):
                held.setdefault(part, []).append((grp, np.frombuffer(blob.as_buffer(), "<u4").copy()))
        for part in sorted(held):
            blobs = held.pop(part)
            values, counts = np.unique(np.concatenate([b for _, b in blobs]), return_counts=True)
            often = values[counts >= FREQUENT_LEAST]
            if not len(often):
                continue
            rows = []
            for grp, blob in blobs:
                bits = often[np.minimum(np.searchsorted(often, blob), len(often) - 1)] == blob
                if bits.any():
                    rows.append((grp, np.packbits(bits).tobytes()))
            if rows:
                grps, bits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(grps, pa.int32()), pa.array([part] * len(grps), pa.int32()), pa.array(bits, pa.binary())], names=["grp", "part", "blob"])

    dealt = carried.select("grp", "mark", "text").groupBy("grp").applyInArrow(deal, ROWS_DDL).select("kind", "part", "a", "b", "n", "mark", "blob")
    return dealt.repartition(max(16, parts // 4), "part").mapInArrow(count, "grp int, part int, blob binary")


def indexed(carried: DataFrame, nodes: DataFrame, flags: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by ``part``: profiles (a: node, n, sketch) of all nodes and packed index entries."""

    def deal(group: pa.Table) -> pa.Table:
        marks, sets = ordered_sets(group)
        named = {m: node for m, node in zip(group.column("mark").to_pylist(), group.column("node").to_pylist(), strict=True) if node is not None}
        every = np.concatenate(sets)
        part, token = place_of(every, parts)
        order = np.argsort(part, kind="stable")
        often, dealt = np.zeros(len(every), bool), part[order]
        for p, blob in zip(group.column("part").to_pylist(), group.column("blob").to_pylist(), strict=True):
            if blob is not None:
                start, end = np.searchsorted(dealt, [p, p + 1])
                often[order[start:end]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=end - start).astype(bool)
        entries, places, profiles, start = [], [], [], 0
        for mark, found in zip(marks, sets, strict=True):
            end, node = start + len(found), named[mark]
            rare = ~often[start:end]
            prefix = np.concatenate([np.flatnonzero(rare), np.flatnonzero(~rare)])[: prefix_length(len(found))]
            entry = np.empty(len(prefix), ENTRY)
            entry["token"], entry["node"], entry["size"] = token[start:end][prefix], node, len(found)
            rest = len(found) - 1 - np.arange(len(prefix))
            entry["rest"] = -(-rest * 65535 // len(found))  # share of the set that follows, rounded up
            entries.append(entry)
            places.append(part[start:end][prefix])
            profiles.append((node, len(found), sketch_of(found)))
            start = end
        node, n, sketch = zip(*profiles, strict=True)
        return pa.Table.from_batches([rows_of(kind="profile", part=np.array([k % parts for k in node], np.int32), a=node, n=n, blob=sketch), packed_parts(np.concatenate(places), np.concatenate(entries), "entries")], ROWS)

    null = lambda kind: F.lit(None).cast(kind)
    rows = carried.select("grp", "mark", "text", null("long").alias("node"), null("int").alias("part"), null("binary").alias("blob"))
    rows = rows.unionByName(nodes.select("grp", "mark", null("binary").alias("text"), "node", null("int").alias("part"), null("binary").alias("blob")))
    rows = rows.unionByName(flags.select("grp", null("binary").alias("mark"), null("binary").alias("text"), null("long").alias("node"), "part", "blob"))
    return rows.groupBy("grp").applyInArrow(deal, ROWS_DDL)


ROWS_DDL = "kind string, part int, a bigint, b bigint, n bigint, mark binary, blob binary"
ROWS = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("blob", pa.binary())])


def rows_of(kind: str, **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([kind] * rows) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in ROWS], schema=ROWS)


def may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size and position filters of two entries of one list."""
    rest = np.minimum(np.ceil(x["rest"] / 65535 * x["size"]), np.ceil(y["rest"] / 65535 * y["size"]))
    return (x["node"] != y["node"]) & sizes_fit(x["size"], y["size"]) & (rest + 1 >= needed(x["size"], y["size"]))


def list_pairs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one part's entries: candidate pairs (a, b) of short lists, of long lists those with the first set and between neighbours, and the long lists."""
    entries = entries[np.lexsort((entries["node"], entries["token"]))]
    fresh = np.r_[True, (entries["token"][1:] != entries["token"][:-1]) | (entries["node"][1:] != entries["node"][:-1])]
    entries = entries[fresh]
    starts = np.flatnonzero(np.r_[True, entries["token"][1:] != entries["token"][:-1]])
    lengths = np.diff(np.r_[starts, len(entries)])
    of_list = np.repeat(np.arange(len(starts)), lengths)
    spot = np.arange(len(entries)) - starts[of_list]
    left, right = [], []
    for gap in range(1, SHORT_LIST):  # every pair of a short list, by distance
        ahead = np.flatnonzero((spot + gap < lengths[of_list]) & ((lengths[of_list] <= SHORT_LIST) | (gap <= NEIGHBOURS)))
        if not len(ahead):
            break
        fit = may_link(entries[ahead], entries[ahead + gap])
        left.append(ahead[fit])
        right.append(ahead[fit] + gap)
    later = np.flatnonzero((lengths[of_list] > SHORT_LIST) & (spot > 0))
    fit = may_link(entries[starts[of_list[later]]], entries[later])
    left.append(starts[of_list[later]][fit])
    right.append(later[fit])
    a, b = entries["node"][np.concatenate(left)], entries["node"][np.concatenate(right)]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    long = np.flatnonzero(lengths > SHORT_LIST)
    return pairs[:, 0], pairs[:, 1], [entries[starts[k] : starts[k] + lengths[k]] for k in long]


def join_lists(dealt: DataFrame) -> DataFrame:
    """The inverted lists of each partition turned into candidate pairs and long lists; other rows pass."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist())
            packed = np.flatnonzero(kinds == "entries")
            for k in packed:
                held.setdefault(batch.column(1)[k].as_py(), []).append(np.frombuffer(batch.column(6)[k].as_buffer(), ENTRY).copy())
            if len(packed) < len(kinds):
                yield batch.filter(pa.array(kinds != "entries"))
        for part in sorted(held):
            a, b, long = list_pairs(np.concatenate(held.pop(part)))
            if len(a):
                yield rows_of(kind="pair", part=np.full(len(a), part, np.int32), a=a, b=b)
            for entries in long:
                for k in range(0, len(entries), 50_000):
                    piece = entries[k : k + 50_000]
                    yield rows_of(kind="list", part=np.full(len(piece), part, np.int32), a=piece["node"], b=piece["token"].astype(np.int64), n=piece["size"].astype(np.int64) << 16 | piece["rest"])

    return dealt.mapInArrow(join, ROWS_DDL)


def sketch_room(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """What the candidate pairs (x[i], y[j]) have left after their sketches' differences, below 0 where they cannot link; sketches of one width are compared at a time."""
    widths = [np.array([len(b) for b in side]) for side in (left, right)]
    tables = [{w: np.frombuffer(b"".join(b for b in side if len(b) == w), np.uint8).reshape(-1, w) for w in set(at.tolist())} for side, at in zip((left, right), widths, strict=True)]
    rows = [np.zeros(len(at), np.int64) for at in widths]
    for at, row in zip(widths, rows, strict=True):
        for w in np.unique(at):
            row[at == w] = np.arange((at == w).sum())
    n, m = x["size"][i].astype(np.int64), y["size"][j].astype(np.int64)
    most = n + m - 2 * needed(n, m)
    room = np.zeros(len(i), np.int64)
    for w in np.unique(widths[0][i]):
        for v in np.unique(widths[1][j]):
            both = np.flatnonzero((widths[0][i] == w) & (widths[1][j] == v))
            least = min(w, v)
            for at in range(0, len(both), SKETCH_PAIRS):
                some = both[at : at + SKETCH_PAIRS]
                a, b = tables[0][w][rows[0][i[some]]], tables[1][v][rows[1][j[some]]]
                a, b = (np.bitwise_xor.reduce(t.reshape(len(t), -1, least), axis=1) for t in (a, b))
                room[some] = most[some] - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return room


def nearest(found: np.ndarray, most: int) -> np.ndarray:
    """Of rows (i, j, room), those that are among the ``most`` with the most room of either end."""
    kept = np.zeros(len(found), bool)
    for side, other in ((0, 1), (1, 0)):
        order = np.lexsort((found[:, other], -found[:, 2], found[:, side]))
        ends = found[order, side]
        starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        kept[order[rank < most]] = True
    return found[kept]


def cross_pairs(lists: DataFrame, components: DataFrame, profiles: DataFrame, most: int) -> DataFrame | None:
    """(a, b): candidates of long lists between sets of different classes, those with the first set left out; None without any.

    A task emits a set's ``most`` nearest candidates by their sketches; a row of nulls says that it held others back.
    """
    placed = materialize(lists.select("part", F.col("b").alias("token"), F.col("a").alias("id"), "n").join(components, "id", "left").withColumn("component", F.coalesce("component", "id")))
    groups = placed.groupBy("part", "token").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.min("component").alias("least"), F.max("component").alias("most"))
    groups = materialize(groups.filter("least < most").select("part", "token", "size", "first"))
    total = groups.agg(F.sum("size")).first()[0]
    if not total:
        return None
    mixed = join_hot(placed, groups, ["part", "token"], "size", total).filter("id <> first").withColumn("blocks", F.ceil(F.col("size") / TASK_BLOCK).cast("int"))
    mixed = mixed.join(profiles.select(F.col("a").alias("id"), F.col("blob").alias("sketch")), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = mixed.select("part", "token", "id", "n", "component", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("part", "token", "id", "n", "component", "sketch", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def cross(key: tuple, group: pa.Table) -> pa.Table:
        _, _, p, q = (k.as_py() for k in key)
        node, component, n, block = (group.column(c).to_numpy() for c in ("id", "component", "n", "block"))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if (component == component[0]).all():
            return empty
        entries = np.empty(len(node), ENTRY)
        entries["token"], entries["node"], entries["size"], entries["rest"] = 0, node, n >> 16, n & 0xFFFF
        order = np.lexsort((-entries["rest"].astype(np.int64), entries["size"]))
        entries, component, block = entries[order], component[order], block[order]
        sketch = group.column("sketch").combine_chunks().take(pa.array(order)).to_pylist()
        out, size, held_back = [np.empty((0, 3), np.int64)], 0, False
        for s in range(0, len(entries), BLOCK):
            x = entries[s : s + BLOCK]
            if size > KEPT_PAIRS:
                every = np.concatenate(out)
                out = [nearest(every, most)]
                held_back |= len(out[0]) < len(every)
                size = len(out[0])
            for t in range(s, len(entries), BLOCK):
                y = entries[t : t + BLOCK]
                if int(y["size"][0]) * LINK_LOW > int(x["size"][-1]) * LINK_TOP:
                    break  # sorted by size: all later blocks are too large
                reach = 1 + min(np.ceil(x["rest"] / 65535 * x["size"]).max(), np.ceil(y["rest"] / 65535 * y["size"]).max())
                if reach < needed(x["size"][:1], y["size"][:1])[0]:
                    continue  # no set of the block has enough shingles left
                fit = (component[s : s + BLOCK, None] != component[None, t : t + BLOCK]) & may_link(x[:, None], y[None, :])
                if p != q:  # pairs inside a block belong to the task of that block alone
                    fit &= block[s : s + BLOCK, None] != block[None, t : t + BLOCK]
                i, j = np.nonzero(fit)
                if s == t:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    room = sketch_room(x, y, i, j, sketch[s : s + BLOCK], sketch[t : t + BLOCK])
                    kept = room >= 0
                    out.append(np.stack([i[kept] + s, j[kept] + t, room[kept]], axis=1))
                    size += len(out[-1])
        every = np.concatenate(out)
        pairs = nearest(every, most)
        held_back |= len(pairs) < len(every)
        a, b = entries["node"][pairs[:, 0]], entries["node"][pairs[:, 1]]
        last = [None] if held_back else []
        return pa.table({"a": pa.array([*np.minimum(a, b).tolist(), *last], pa.int64()), "b": pa.array([*np.maximum(a, b).tolist(), *last], pa.int64())})

    return dealt.groupBy("part", "token", "p", "q").applyInArrow(cross, "a bigint, b bigint").distinct()


def verify(pairs: DataFrame, profiles: DataFrame, carried: DataFrame, nodes: DataFrame) -> DataFrame:
    """The linked ones of candidate ``pairs`` (a, b) of nodes."""
    side = lambda c: profiles.select(F.col("a").alias(c), F.struct("n", "blob").alias(f"{c}_"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_.*", F.col("b_.n").alias("m"), F.col("b_.blob").alias("blob2"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most = n + m - 2 * needed(n, m)
            kept = [k for k, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)) if sketch_distance(a, b) <= most[k]]
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    sifted = materialize(known.mapInArrow(sift, "a bigint, b bigint"))
    ids = sifted.select(F.col("a").alias("node")).unionByName(sifted.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.select("node", "mark", F.col("tid").alias("id")).join(ids, "node"))
    few = wanted.count() <= BROADCAST_IDS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(unpack(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "held"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if LINK_TOP * both >= LINK_LOW * (len(x) + len(y) - both):
                    kept.append(k)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    sets = carried.join(F.broadcast(wanted) if few else wanted, ["mark", "id"]).select("node", "text").mapInArrow(gather, "node bigint, held binary")
    sets = materialize(sets)
    both = sifted.join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(intersect, "a bigint, b bigint").distinct()


def same_id_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between the nodes of ids that have several sets."""
    groups = rows.groupBy("id").agg(F.min("mark").alias("least"), F.max("mark").alias("most"), F.count("*").alias("rows")).filter("least <> most").select("id", "least", "rows")
    groups = materialize(groups)
    total = groups.agg(F.sum("rows")).first()[0]
    if not total:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    marks = join_hot(rows.select("id", "mark"), groups, ["id"], "rows", total).select("mark", "least").filter("mark <> least").distinct()
    return marks.join(nodes.select("mark", F.col("node").alias("a")), "mark").join(nodes.select(F.col("mark").alias("least"), F.col("node").alias("b")), "least").select("a", "b")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of every row; the ids are integers."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"ids are integers, not {kind}")
    small_batches(df.sparkSession)
    with workspace(df.sparkSession) as finish:
        return finish(classes_of(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).withColumnRenamed("id", id_col))


def classes_of(texts: DataFrame) -> DataFrame:
    rows = materialize(profiled(texts))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    groups, parts = max(16, total // GROUP_BYTES), min(MOST_PARTS, max(64, total // PART_BYTES))
    placed = rows.filter("id IS NOT NULL AND n > 0").withColumn("grp", F.pmod(F.xxhash64("mark"), F.lit(groups)).cast("int"))
    nodes = placed.groupBy("mark", "grp").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min(F.when(F.col("text").isNotNull(), F.col("id"))).alias("tid"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    carried = placed.filter("text IS NOT NULL").select("grp", "mark", "id", "text")
    flags = materialize(frequent_flags(carried, parts))
    joined = materialize(join_lists(indexed(carried, nodes, flags, parts).repartition(max(16, parts // 4), "part")))
    profiles = joined.filter("kind = 'profile'").select("a", "n", "blob")
    pairs = joined.filter("kind = 'pair'").select("a", "b").distinct()
    links = materialize(same_id_links(placed.select("id", "mark"), nodes).unionByName(verify(pairs, profiles, carried, nodes)).distinct())
    components = materialize(connected_components(links))
    lists, seen, most = joined.filter("kind = 'list'"), materialize(pairs), NEAREST
    while (found := cross_pairs(lists, components, profiles, most)) is not None:  # ends when no task holds a pair back, at 2 * TASK_BLOCK at the latest
        found = materialize(found)
        fresh = materialize(found.filter("a IS NOT NULL").join(seen, ["a", "b"], "left_anti"))
        links = materialize(verify(fresh, profiles, carried, nodes))
        if not links.isEmpty():
            components = materialize(connected_components(components.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)))
        if found.filter("a IS NULL").isEmpty():
            break
        seen, most = seen.unionByName(fresh), most * NEAREST_STEP
    of_node = nodes.select("mark", "copies", "first", "node").join(components.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    of_node = materialize(join_hot(of_node, least, ["component"], "size", nodes.count()).select("mark", "copies", "component_id"))
    found = join_hot(placed.select("id", "n", "mark"), of_node, ["mark"], "copies", placed.count()).select("id", "n", "component_id")
    alone = rows.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    empty = alone.join(found.groupBy("id").agg(F.min("component_id").alias("other")), "id", "left").select("id", "n", F.coalesce("other", "component_id").alias("component_id"))
    return found.unionByName(empty).withColumnRenamed("n", "n_shingles")


def oracle() -> str:
    """DuckDB: exact sets, all pairs that share a shingle, components by a recursive closure."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({fold}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c WHERE {LINK_TOP} * k >= {LINK_LOW} * (na + nb - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT s.doc_id, any_value(len(sh))::BIGINT AS n_shingles, min(reach.b)::BIGINT AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id
"""
