"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers of code points are numbered by occurrence, so equal k-mers differ. For
each of the sketches a hash function picks the TUPLE k-mers of least hash; these are
put back into text order and hashed together. Two fingerprints agree in a sketch when
the same k-mers were picked and stand in the same order.

For documents in doc_id order, every document also meets its successor: rows are dealt
to ranges of doc_id (cut points from a bounded sample of ids), the first row of each
range is sent along to the range before, and a task walks its ranges in order holding
two texts at a time. Texts are shuffled once, compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

K, SKETCHES, TUPLE = 8, 64, 2
SEED = 7
#: Documents in a range, the most ranges that the driver keeps cut points for, and ranges that a task walks.
RANGE_ROWS, RANGES, WALK = 1024, 50_000, 4


class OrderMinHash:
    def __init__(self, k: int = K, sketches: int = SKETCHES, tuple_size: int = TUPLE):
        rng = np.random.default_rng(SEED)
        self.k, self.sketches, self.size = k, sketches, tuple_size
        self.step = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd = (rng.integers(0, 1 << 31, sketches, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.add = rng.integers(0, 1 << 32, sketches, dtype=np.uint32)[:, None]

    def kmers(self, points: np.ndarray) -> np.ndarray:
        """64-bit hashes of the k-mers, each with its occurrence number mixed in; a shorter text is one k-mer."""
        if not len(points):
            return np.empty(0, np.uint64)
        k, wide = min(self.k, len(points)), points.astype(np.uint64)
        h = np.full(len(wide) - k + 1, k, np.uint64)
        for i in range(k):
            h += wide[i : len(wide) - k + 1 + i] * self.step[i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ordered = np.sort(h)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            again = again[np.concatenate([[True], again[1:] != again[:-1]])]
            slot = np.minimum(np.searchsorted(again, h), len(again) - 1)
            where = np.flatnonzero(again[slot] == h)
            order = np.argsort(slot[where], kind="stable")
            where, group = where[order], slot[where][order]
            starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
            number = np.arange(len(where)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(where)]])))
            h[where] += number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def sketch(self, points: np.ndarray) -> np.ndarray:
        """One 32-bit value for each sketch."""
        h = self.kmers(points)
        if not len(h):
            return np.zeros(self.sketches, np.uint32)
        small = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        picked = np.empty((self.sketches, min(self.size, len(h))), np.int64)
        block = max(1, min(self.sketches, (1 << 18) // len(small)))
        for at in range(0, self.sketches, block):
            ranks = small[None, :] * self.odd[at : at + block] + self.add[at : at + block]
            ranks ^= ranks >> np.uint32(15)
            ranks *= np.uint32(0x2C1B3C6D)
            rows = np.arange(len(ranks))
            for i in range(picked.shape[1]):
                best = ranks.argmin(axis=1)
                picked[at : at + block, i] = best
                ranks[rows, best] = np.uint32(0xFFFFFFFF)
        picked.sort(axis=1)
        out = np.full(self.sketches, 0x9E3779B97F4A7C15, np.uint64)
        for i in range(picked.shape[1]):
            out = (out ^ h[picked[:, i]]) * np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(30)
        return (out >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def text_of(sketch: np.ndarray) -> str:
        return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited_points(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last half (rounded down) replaced by as many first code points of the following text, or all it has."""
    half = len(points) // 2
    return np.concatenate([points[: len(points) - half], following[:half]])


def range_cuts(docs: DataFrame, id_col: str) -> list[int]:
    """Ascending cut points of about equal ranges, from about 20 sampled ids for each range; an id counts once, however often it is repeated."""
    n = docs.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    if ranges == 1:
        return []
    every = max(1, n // (20 * ranges))
    sample = sorted(r[0] for r in docs.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)).select(id_col).distinct().collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, tuple_size: int = TUPLE) -> DataFrame:
    """One row for each input row: doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next.

    doc_id is integral. Null texts count as empty, and all empty texts have the
    fingerprint of zeros. A null doc_id comes first; rows that share a doc_id follow each
    other in order of their texts' hashes; the last document is followed by the first,
    and a single one by itself. Other columns are not looked at; no rows give no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = np.array(range_cuts(source, "doc_id"), np.int64)

    def place(ids: pa.Array) -> np.ndarray:
        at = np.searchsorted(cuts, np.array(ids.fill_null(0)), "right")
        return np.where(np.array(ids.is_null()), 0, at)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int | None] = {}
        for batch in batches:
            for spot, i in zip(place(batch.column(0)).tolist(), batch.column(0).to_pylist(), strict=True):
                if spot not in found or (found[spot] is not None and (i is None or i < found[spot])):
                    found[spot] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["spot", "doc_id"])

    firsts: dict[int, int | None] = {}  # as many as there are ranges
    for r in map_batches(source.select("doc_id"), least, "spot long, doc_id long").groupBy("spot").agg(F.when(F.count("*") == F.count("doc_id"), F.min("doc_id")).alias("first")).collect():
        firsts[r["spot"]] = r["first"]
    filled = sorted(firsts)
    previous = dict(zip(filled, filled[-1:] + filled[:-1], strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                ids, spots = few.column(0).to_pylist(), place(few.column(0)).tolist()
                rows = []
                for i, spot, text in zip(ids, spots, few.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    tie, packed = xxhash.xxh3_64_intdigest(raw) >> 1, squeeze(raw)
                    rows.append((spot, False, i, tie, packed))
                    if firsts[spot] == i:
                        rows.append((previous[spot], True, i, tie, packed))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["spot", "guest", "doc_id", "tie", "packed"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sketcher, unpack = OrderMinHash(k, sketches, tuple_size), zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, ended = None, None  # held: (spot, doc_id, points, sketch) that waits for its successor
        for batch in batches:
            rows = []
            for spot, guest, i, packed in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if guest and ended == spot:
                    continue  # of several rows with a range's first id, the first is the successor
                points = code_points(unpack(packed).decode("utf-8", "surrogatepass"))
                sketch = sketcher.sketch(points)
                if held is not None and held[0] == spot:
                    _, before, own, own_sketch = held
                    edited = edited_points(own, points)
                    edited_sketch = sketcher.sketch(edited)
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((before, len(own), sketcher.text_of(own_sketch), sha, sketcher.text_of(edited_sketch), likeness(own_sketch, edited_sketch), likeness(own_sketch, sketch)))
                held, ended = (None, spot) if guest else ((spot, i, points, sketch), None)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = map_batches(source, deal, "spot long, guest boolean, doc_id long, tie long, packed binary")
    in_order = dealt.repartition(max(1, -(-len(filled) // WALK)), "spot").sortWithinPartitions("spot", "guest", F.asc_nulls_first("doc_id"), "tie").select("spot", "guest", "doc_id", "packed")
    return map_batches(in_order, walk, "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
