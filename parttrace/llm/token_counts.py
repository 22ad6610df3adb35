"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; each node has a failure link and the number of tokens that following it pops, both computed
once, so a word's greedy longest-match pieces are counted in one walk over its characters, without making the pieces.
Pieces with the word mark at their front start a word, all others go on with it. A word with a part that no piece
matches counts as one unknown token.

Words are runs of [^\\x20\\x09-\\x0D]. Null and empty texts count 0. A worker remembers the counts of up to ``KEPT``
distinct words. Repeated rows get equal counts; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEPT = 300_000
#: Fixed value: the mark that starts a word in the piece vocabulary.
MARK = "▁"


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a piece model of fixed size, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


class Automaton:
    """Node 0 starts a word, node 1 goes on with it; ``fail`` -1: no piece matches here."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail, self.pops = [-1, -1], [0, 0]
        ends: set[int] = set()
        for piece in pieces:
            node = 0 if piece.startswith(MARK) else 1
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            if piece:
                ends.add(node)
        self.fail += [-1] * (len(self.next) - 2)
        self.pops += [0] * (len(self.next) - 2)
        level = [0, 1]
        while level:  # by depth: a link leads to a shorter string
            below = []
            for parent in level:
                for c, node in self.next[parent].items():
                    below.append(node)
                    if node in ends:
                        self.fail[node], self.pops[node] = 1, 1
                        continue
                    to, count = self.fail[parent], self.pops[parent]
                    while to >= 0 and c not in self.next[to]:
                        count += self.pops[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[node], self.pops[node] = self.next[to][c], count
            level = below

    def count(self, word: str) -> int:
        node, n = 0, 0
        for c in MARK + word:
            while c not in self.next[node]:
                n += self.pops[node]
                node = self.fail[node]
                if node < 0:
                    return 1
            node = self.next[node][c]
        while node != 1:
            n += self.pops[node]
            node = self.fail[node]
            if node < 0:
                return 1
        return n


_known: dict[str, dict[bytes, int]] = {}


def counts(automaton: Automaton, column, known: dict[bytes, int]) -> np.ndarray:
    raw, at = C.text_bytes(column)
    _, first, start, end = C.word_hashes(column, spans=True)
    if not len(start):
        return np.zeros(len(at) - 1, np.int64)
    words, inverse = C.distinct_spans(raw, start, end)
    for w in words:
        if w not in known:
            known[w] = automaton.count(w.decode())
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, words), np.int64, len(words))[inverse])])
    return total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, n_tokens."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    automaton = spark.sparkContext.broadcast(Automaton(load_pieces(path)))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            known = _known.setdefault(path, {})
            if len(known) > KEPT:
                known.clear()
            n = [counts(automaton.value, batch.column(1).slice(k, 256), known) for k in range(0, len(batch), 256)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], [id_column, "n_tokens"])
        C.trim_memory()

    return docs.select(id_column, F.col("text").cast("string")).mapInArrow(rows, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens long")
