"""Bounded-space online packing of tokenized documents into fixed windows.

Every partition keeps a fixed number of open windows. A document's ids go to the
open window with the least sufficient room; when none fits, the fullest window is
topped up (if its room is worth a cut) and emitted, and a new one is opened. What is
still open at the end of a partition is merged in rounds over groups of partitions,
each round leaving at most one window for each group, until one group is left. No
text is shuffled, and a task holds OPEN windows whatever the size of its partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, table

WINDOW, OPEN, MIN_CUT, MERGE = 4096, 32, 32, 64
END_ID = 2
#: Words remembered by a worker; the memory is emptied when it is full.
MEMO = 250_000

#: Characters below U+0180 by class, as the tokenizer's pattern sees them; other texts take its own code.
_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = r"0-9²³¹¼-¾"
_SPACE = r"\t-\r \u0085 "
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_OTHER = re.compile(r"[^\x00-įı-ſ]")
#: Bytes without a visible letter in Latin-1 are spelled by letters from U+0100 on, in order.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean, ids binary"


class WordTokens:
    """Little-endian 32-bit ids of a text by a tokenizers file, remembered by word.

    The pre-tokenizer cuts a text into words that are encoded apart from each other,
    so a text's ids are its words' ids in order. Texts that hold a special token's name
    or characters beyond the pattern's own classes go to the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What special tokens' names have in common: a text without it holds none.
        self.marks = [os.path.commonprefix(names)] if os.path.commonprefix(names) else names
        self.end = end_id.to_bytes(4, "little")
        self.memo: dict[str, bytes] = {}

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def word(self, word: str) -> bytes:
        """Ids of one word: its bytes as the byte-level step spells them, given straight to the merges."""
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return self.bytes_of([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        lower = text.lower()
        if _OTHER.search(text) or any(mark in lower for mark in self.marks):
            return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        words, memo = _WORD.findall(lower), self.memo
        try:
            return b"".join(map(memo.__getitem__, words)) + self.end
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            new = [w for w in dict.fromkeys(words) if w not in memo]
            for word in new:
                memo[word] = self.word(word)
            return b"".join(map(memo.__getitem__, words)) + self.end


class Packer:
    """Windows of one task; add() returns the pieces whose window is settled."""

    def __init__(self, part: int, first_sequence: int, window: int = WINDOW, open_windows: int = OPEN, min_cut: int = MIN_CUT):
        self.part, self.next, self.window, self.most, self.min_cut = part, first_sequence, window, open_windows, min_cut
        self.open: list[tuple[int, list[tuple]]] = []  # (used, pieces)

    def settle(self, pieces: list[tuple], is_open: bool = False) -> list[tuple]:
        out, offset, sequence = [], 0, self.next
        self.next += 1
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), tokens, sequence, offset, self.part, is_open, ids))
            offset += n
        return out

    def add(self, doc_id, start: int, ids: bytes, tokens: int) -> list[tuple]:
        out, full = [], self.window * 4
        while len(ids) >= full:
            out += self.settle([(doc_id, start, ids[:full], tokens)])
            start, ids = start + self.window, ids[full:]
        n = len(ids) // 4
        if not n:
            return out
        fits = [i for i, (used, _) in enumerate(self.open) if used + n <= self.window]
        if fits:
            i = max(fits, key=lambda i: self.open[i][0])
            used, pieces = self.open[i]
            pieces.append((doc_id, start, ids, tokens))
            if used + n == self.window:
                del self.open[i]
                return out + self.settle(pieces)
            self.open[i] = (used + n, pieces)
            return out
        if len(self.open) >= self.most:
            i = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(i)
            room = self.window - used
            if room >= self.min_cut:
                pieces.append((doc_id, start, ids[: room * 4], tokens))
                start, ids, n = start + room, ids[room * 4 :], n - room
            out += self.settle(pieces)
        self.open.append((n, [(doc_id, start, ids, tokens)]))
        return out

    def leftovers(self) -> list[tuple]:
        out = []
        for _, pieces in self.open:
            out += self.settle(pieces, True)
        self.open = []
        return out


def concatenated(pieces: Iterator[tuple], part: int, first_sequence: int, window: int, last: bool) -> list[tuple]:
    """Full windows of the pieces one after the other; the rest stays open, or, at the very last, goes to windows of a power of two each."""
    packer, run, used, out = Packer(part, first_sequence, window), [], 0, []
    for doc_id, start, ids, tokens in pieces:
        while ids:
            n = min(len(ids) // 4, window - used)
            run.append((doc_id, start, ids[: n * 4], tokens))
            start, ids, used = start + n, ids[n * 4 :], used + n
            if used == window:
                out += packer.settle(run)
                run, used = [], 0
    if not last:
        return out + (packer.settle(run, True) if run else [])
    while used:
        size, taken, rest = 1 << (used.bit_length() - 1), [], []
        room = size
        for doc_id, start, ids, tokens in run:
            n = min(room, len(ids) // 4)
            if n:
                taken.append((doc_id, start, ids[: n * 4], tokens))
            if n < len(ids) // 4:
                rest.append((doc_id, start + n, ids[n * 4 :], tokens))
            room -= n
        out += packer.settle(taken)
        run, used = rest, used - size
    return out


def _batches(rows: list[tuple], schema: pa.Schema, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = list(zip(*rows, strict=True))
        columns[9] = [x if with_ids or o else None for x, o in zip(columns[9], columns[8], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN, min_cut: int = MIN_CUT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and end_id; a null or empty text is end_id alone. Every id
    lies in exactly one piece. Rows that share an id are packed apart. Columns other
    than id_col and text_col are not looked at; no rows give no pieces. Documents of
    any length are cut at windows. The tokenizer file is read on the executors, where
    its library is installed.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(PIECE.format(id=id_type))
    schema = to_arrow_schema(spark_schema)

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, tokens = Packer(part, part << 32, window, open_windows, min_cut), WordTokens(tokenizer_path, end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few, rows = batch.slice(at, 512), []
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    ids = tokens.encode(text)
                    rows += packer.add(doc_id, 0, ids, len(ids) // 4)
                yield from _batches(rows, schema, with_ids)
        yield from _batches(packer.leftovers(), schema, with_ids)

    def merger(base: int, last: bool):
        def merge(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            pieces = zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
            group = key[0].as_py()
            return pa.Table.from_batches(_batches(concatenated(pieces, group, base + (group << 24), window, last), schema, with_ids), schema)

        return merge

    done = materialize(map_batches(source, by_partition, spark_schema), "packed")
    closed, left, round_no = [done.where("not open")], done.where("open"), 0
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups, round_no = -(-groups // MERGE), round_no + 1
        last = groups == 1

        merged = materialize(left.groupBy((F.col("part") / MERGE).cast("long").alias("g")).applyInArrow(merger((1 << 62) + (round_no << 52), last), spark_schema), "merged")
        closed.append(merged.where("not open"))
        left = merged.where("open")
        if last:
            break
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("part", "open") if with_ids else out.drop("part", "open", "ids")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
