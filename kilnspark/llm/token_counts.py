"""Greedy word-piece lengths by a longest-match automaton, without building pieces.

The vocabulary is a trie. A node's failure link leads to where matching goes on after
the pieces that its string is bound to give up are popped; how many pieces that are is
computed once with the link. A word is then read left to right, each byte moving down
the trie or along failure links, and the popped counts add up to the number of pieces
that greedy longest match would give, in time linear in the word.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .pretokens import pieces, read_ranks

MEMO = 400_000


class LongestMatch:
    """The automaton of a vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends, size = [False], 1
        for token in vocabulary:
            node = 0
            for byte in token:
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = size
                    ends.append(False)
                    size += 1
                node = after
            ends[node] = node != 0
        self.fail, self.popped = [-1] * size, [0] * size
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in below.get(parent, ()):
                queue.append(node)
                if ends[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 8 | byte) not in self.child:
                    popped, at = popped + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.child[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match; -1 when some part of the word is no piece."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for byte in word:
            after = child.get(node << 8 | byte)
            while after is None:
                total, node = total + popped[node], fail[node]
                if node < 0:
                    return -1
                after = child.get(node << 8 | byte)
            node = after
        while node > 0:
            total, node = total + popped[node], fail[node]
        return total if node == 0 else -1


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_tokens, n_unknown.

    Words are the matches of the pre-tokenizer's pattern; each has the number of pieces
    that greedy longest match over the vocabulary's bytes gives. A word that cannot be
    matched counts as one token and one unknown. Null texts count as empty: no words.
    Rows are counted apart, repeated or not; other columns are not looked at; no rows
    give no rows. The vocabulary file is read on the executors.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = LongestMatch(read_ranks(vocabulary_path)), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few, rows = batch.slice(at, 512), []
                for text in few.column(1).to_pylist():
                    words = pieces(text or "")
                    for w in words:
                        if w not in memo:
                            memo[w] = automaton.count(w.encode())
                    counts = list(map(memo.__getitem__, words))
                    unknown = counts.count(-1)
                    rows.append((len(counts), sum(counts) + 2 * unknown, unknown))
                    if len(memo) > MEMO:
                        memo.clear()
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([few.column(0), *columns], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
