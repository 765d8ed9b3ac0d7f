"""BPE encoding and decoding of whole texts by tree concatenation.

A text longer than a leaf is cut in halves, again and again, at arbitrary characters.  All leaves are
encoded on their own; a join then re-encodes a window around the cut that grows until both sides
agree with it, and keeps the left tokens before the window, the window's tokens and the right tokens
behind it.

Why a join is exact.  (1) The pre-tokenizer cannot match across certain places whatever stands around
them: from a non-space to a space, and between letters, digits and other signs except from a sign to
a letter (contractions).  A window edge at such a place needs no agreement.  (2) Inside one run of
letters, digits, signs or spaces, a sequence of BPE tokens is the encoding of its text exactly when
every adjacent pair is; so an edge there is right when the window's outermost token equals the
side's token at that edge.  (3) A window that covers both sides entirely is the encoding itself.

Texts above ``task_chars`` are dealt as pieces over all tasks, so their halves are encoded in parallel and
no task encodes a very long text alone.  Pieces are never cut inside a special string; a special token is
one token with hard edges, so the joins hold across it.  The pieces' joins re-encode only windows; they
run pairwise where the document's token ids meet, which a hash over the whole id sequence needs in any
case.

Defined cases: null is the empty text; special strings in a text become their special token, as the
library does by default; repeated rows and null ids give one row each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import release_memory, small_batches
from studyloom.llm.token_counts import byte_alphabet

#: Characters in one leaf of the tree, in one library call, and in a text that one task encodes alone.
LEAF_CHARS, CALL_CHARS, TASK_CHARS = 16_384, 200_000, 131_072
FIRST_WINDOW = 8


def char_class(c: str) -> str:
    """L, N, S or O as the pre-tokenizer sees it; empty where engines differ, so never trusted as an edge."""
    if "\x1c" <= c <= "\x1f" or c in "\x85᠎​":
        return ""
    if c.isspace():
        return "S"
    kind = unicodedata.category(c)
    return "" if kind in ("Cn", "Cs") else kind[0] if kind[0] in "LN" else "O"


def free_edge(before: str, after: str) -> bool:
    """No pre-token can hold both characters, whatever stands around them."""
    return bool(before and after) and before != after and before != "S" and (before, after) != ("O", "L")


class Codec:
    """Leaf encoder, id tables and the tree join of one byte-level vocabulary."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
        self.pieces: list[bytes] = [b""] * size
        for piece, number in spec["model"]["vocab"].items():
            self.pieces[number] = piece.encode() if piece in special else bytes(alphabet[c] for c in piece)
        for piece, number in special.items():
            self.pieces[number] = piece.encode()
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.special = special

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def leaf_ids(self, leaves: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        run: list[str] = []
        size = 0
        for k, leaf in enumerate(leaves):
            run.append(leaf)
            size += len(leaf)
            if size >= CALL_CHARS or k == len(leaves) - 1:
                out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
                run, size = [], 0
        return out

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """The encoding of two neighbouring texts from their own encodings."""
        (a, ids_a), (b, ids_b) = left, right
        if not len(ids_a) or not len(ids_b):
            return a + b, np.concatenate([ids_a, ids_b])
        width = FIRST_WINDOW
        while True:
            i, cut_a = self._edge(a, ids_a, width, last=True)
            j, cut_b = self._edge(b, ids_b, width, last=False)
            window = np.array(self.tokenizer.encode(a[cut_a:] + b[:cut_b], add_special_tokens=False).ids, np.uint32)
            if self._agrees(a, cut_a, window[:1], ids_a[i : i + 1]) and self._agrees(b, cut_b, window[-1:], ids_b[j - 1 : j], right=True):
                return a + b, np.concatenate([ids_a[:i], window, ids_b[j:]])
            width *= 2

    def _edge(self, text: str, ids: np.ndarray, width: int, last: bool) -> tuple[int, int]:
        """A token boundary ``width`` tokens from the join that is a character boundary: (token index, character index)."""
        while width < len(ids):
            side = ids[-width:] if last else ids[:width]
            raw = b"".join([self.pieces[t] for t in side])
            try:
                chars = len(raw.decode())
            except UnicodeDecodeError:
                width += 1
                continue
            return (len(ids) - width, len(text) - chars) if last else (width, chars)
        return (0, 0) if last else (len(ids), len(text))

    @staticmethod
    def _agrees(text: str, cut: int, of_window: np.ndarray, of_side: np.ndarray, right: bool = False) -> bool:
        if cut == (len(text) if right else 0):
            return True
        before, after = char_class(text[cut - 1]), char_class(text[cut])
        return free_edge(before, after) or before == after != "" and np.array_equal(of_window, of_side)

    def plain_parts(self, text: str) -> list[str | int]:
        """The text between special strings, and their ids in place."""
        parts: list[str | int] = [text]
        for piece, number in self.special.items():
            if piece in text:
                out: list[str | int] = []
                for part in parts:
                    if isinstance(part, int):
                        out.append(part)
                        continue
                    for k, between in enumerate(part.split(piece)):
                        out += ([number] if k else []) + ([between] if between else [])
                parts = out
        return parts

    def pieces_of(self, text: str, size: int) -> list[str]:
        """The text in pieces of about so many characters, no special string cut."""
        out, start = [], 0
        while start < len(text):
            end = min(len(text), start + size)
            moved = True
            while moved and end < len(text):  # a cut inside a special string moves behind it
                moved = False
                for piece in self.special:
                    at = text.find(piece, max(start, end - len(piece) + 1), end + len(piece) - 1)
                    if at >= 0 and at < end < at + len(piece):
                        end, moved = at + len(piece), True
            out.append(text[start:end])
            start = end
        return out

    def encode_all(self, texts: list[str], leaf_chars: int = LEAF_CHARS) -> list[np.ndarray]:
        """Ids of every text; the leaves of all texts are encoded together, then joined as trees."""
        leaves: list[str] = []
        plans = []
        for text in texts:
            plan: list[int | list[int]] = []
            for part in self.plain_parts(text):
                if isinstance(part, int):
                    plan.append(part)
                    continue
                count = 1
                while len(part) > leaf_chars * count:
                    count *= 2
                cuts = [len(part) * k // count for k in range(count + 1)]
                plan.append(list(range(len(leaves), len(leaves) + count)))
                leaves += [part[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            plans.append(plan)
        encoded = self.leaf_ids(leaves)
        out = []
        for plan in plans:
            runs = [np.array([step], np.uint32) if isinstance(step, int) else self.fold([(leaves[k], encoded[k]) for k in step])[1] for step in plan]
            out.append(runs[0] if len(runs) == 1 else np.concatenate(runs) if runs else np.empty(0, np.uint32))
        return out

    def fold(self, nodes: list[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
        while len(nodes) > 1:
            nodes = [self.join(nodes[k], nodes[k + 1]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_texts(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", ids: bool = True, leaf_chars: int = LEAF_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256, same): the ids as little-endian 32-bit words, their hash, the decoded text's hash, and whether decoding gave the text back.

    ``ids=False`` leaves the id bytes out, for callers that need only the digests.
    """
    small_batches(df.sparkSession)

    def row(codec: Codec, text: str, found: np.ndarray) -> tuple:
        raw = found.astype("<u4").tobytes()
        decoded = codec.decode(found)
        return len(found), raw if ids else None, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text

    def out(ids_column: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([ids_column, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_()), strict=True))], names=["id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "same"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):  # bound what the library holds at once
                end, size = start, 0
                while end < len(texts) and (size < CALL_CHARS or end == start):
                    size += len(texts[end])
                    end += 1
                found = codec.encode_all(texts[start:end], leaf_chars)
                yield out(batch.column(0).slice(start, end - start), [row(codec, t, f) for t, f in zip(texts[start:end], found, strict=True)])
                start = end
        release_memory()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer_path)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                for part, text in enumerate(codec.pieces_of(row.column(2)[0].as_py(), task_chars)):
                    yield pa.RecordBatch.from_arrays([*row.columns[:2], pa.array([part], pa.int32()), pa.array([text])], names=["id", "key", "part", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer_path)
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                found = codec.encode_all([part.column(3)[0].as_py()], leaf_chars)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([found[0].astype("<u4").tobytes()], pa.binary())], names=["id", "key", "part", "text", "ids"])

    def gather(group: pa.Table) -> pa.Table:
        codec = Codec.of(tokenizer_path)
        group = group.sort_by("part")
        text, found = codec.fold([(t, np.frombuffer(i, "<u4").astype(np.uint32)) for t, i in zip(group.column("text").to_pylist(), group.column("ids").to_pylist(), strict=True)])
        return pa.Table.from_batches([out(group.column("id").combine_chunks().slice(0, 1), [row(codec, text, found)])])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string, same boolean"
    short = source.filter(F.coalesce(F.length("text"), F.lit(0)) <= task_chars).mapInArrow(whole, schema)
    cut = source.filter(F.length("text") > task_chars).withColumn("key", F.monotonically_increasing_id())
    dealt = cut.select("id", "key", "text").mapInArrow(deal, f"id {id_type}, key bigint, part int, text string").repartition("key", "part")
    long = dealt.mapInArrow(pieces, f"id {id_type}, key bigint, part int, text string, ids binary").groupBy("key").applyInArrow(gather, schema)
    return short.unionByName(long).withColumnRenamed("id", id_col)
