"""Token counts: a linear longest-match automaton that counts word pieces without building them.

The vocabulary is two-sided like word-piece vocabularies: some pieces may start a word, others
continue one.  A trie holds the start pieces from one root and the continuation pieces from another.
Every node carries a failure link and the number of pieces that the link pops, both fixed in one
breadth-first pass, so that a word of n bytes takes at most 2n steps whatever the longest piece.  A
word that greedy longest match cannot finish counts as one unknown piece.

Words are split at ASCII white space and read as UTF-8 bytes.  Per task a bounded memo keeps the
counts of words already seen; it saves time and never changes a count.

Defined cases: null and empty texts have no words and no tokens; repeated rows and null ids give one
row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import small_batches

#: Words remembered in one Python worker.
MEMO_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: kept bytes stand for themselves, the rest follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in kept}
    table.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(kept))})
    return table


def load_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(start pieces, continuation pieces) of a byte-level vocabulary file: a leading space marks a word's start."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    start, inner = [], []
    for piece in vocabulary:
        if all(c in alphabet for c in piece):
            raw = bytes(alphabet[c] for c in piece)
            if raw[:1] == b" " and len(raw) > 1:
                start.append(raw[1:])
            else:
                inner.append(raw)
    return start, inner


class Automaton:
    """Trie with failure links and popped-piece counts; nodes are integers, edges ``node << 8 | byte``."""

    def __init__(self, start: list[bytes], inner: list[bytes]):
        self.edges: dict[int, int] = {}
        self.nodes = 2  # 0: start of a word, 1: inside a word
        final: set[int] = set()
        children: dict[int, list[tuple[int, int]]] = {}
        for root, pieces in ((0, start), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.edges:
                        self.edges[key] = self.nodes
                        children.setdefault(node, []).append((byte, self.nodes))
                        self.nodes += 1
                    node = self.edges[key]
                if node != root:
                    final.add(node)
        self.fail = [-1] * self.nodes
        self.pops = [0] * self.nodes
        queue: deque[int] = deque((0, 1))
        while queue:
            node = queue.popleft()
            for byte, child in children.get(node, ()):
                queue.append(child)
                if child in final:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                back, popped = self.fail[node], self.pops[node]
                while back != -1 and (back << 8 | byte) not in self.edges:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back != -1:
                    self.fail[child], self.pops[child] = self.edges[back << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of one word; 0 when greedy longest match cannot finish it."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, total = 0, 0
        for byte in word:
            while (following := edges.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node == -1:
                    return 0
            node = following
        while node != 1:  # pop what is left; the word ends at the inner root
            total += pops[node]
            node = fail[node]
            if node == -1:
                return 0
        return total


def count_tokens(df: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of every row; an unknown word counts as one token."""
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*load_pieces(vocabulary_path))
        memo: dict[bytes, int] = {}
        for batch in batches:
            words_n, tokens_n, unknown_n = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                if len(memo) > MEMO_WORDS:
                    memo = {}
                for word in set(words):
                    if word not in memo:
                        memo[word] = automaton.count(word)
                counts = list(map(memo.__getitem__, words))
                unknown = counts.count(0)
                words_n.append(len(words))
                tokens_n.append(sum(counts) + unknown)
                unknown_n.append(unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_n, pa.int64()), pa.array(tokens_n, pa.int64()), pa.array(unknown_n, pa.int64())], names=["id", "n_words", "n_tokens", "n_unknown"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {id_type}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)
