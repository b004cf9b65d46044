"""Vector retrieval, exact and by inverted lists, diversified results and thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kilnspark.functions.tables import materialize

#: Queries and vectors in a block; a task holds one block of each.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096


def unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, np.float64) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _unit_rows(rows: pa.Array) -> np.ndarray:
    """A list array of vectors as unit rows: its values are one buffer."""
    return unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))


#: Vectors whose distances to all cells a task holds at once.
ASSIGNED_AT_ONCE = 512


def _nearest_cells(cosines: np.ndarray, most: int) -> np.ndarray:
    """The columns of the largest cosines of each row, largest first, ties to the lower one."""
    if most == 1:
        return np.argmax(cosines, axis=1)[:, None]
    return np.argsort(-cosines, axis=1, kind="stable")[:, :most]


def _usable(rows: DataFrame, *more: str) -> DataFrame:
    return rows.where("embedding IS NOT NULL").select("chunk", "embedding", *more)


def _blocks(rows: DataFrame, size: int, name: str, keys: list[str]) -> DataFrame:
    """keys, block, {name}_ids, {name}_rows: rows of equal keys in blocks of about size rows, by a hash of their id."""
    if keys:  # most keys fit in one block
        counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("blocks")).where("blocks > 1")
        placed, blocks = rows.join(counts, keys, "left"), F.coalesce("blocks", F.lit(1))
    else:
        placed, blocks = rows, F.lit(max(1, -(-rows.count() // size)))
    block = F.pmod(F.xxhash64("chunk"), blocks).cast("int").alias("block")
    return placed.groupBy(*keys, block).agg(F.collect_list("chunk").alias(f"{name}_ids"), F.collect_list("embedding").alias(f"{name}_rows"))


def _best_of(pairs: DataFrame, k: int, query_kind: str, chunk_kind: str) -> DataFrame:
    """query, chunk, cosine, place from pairs of blocks: at most k rows of a pair for each query, then the best of all."""

    asked_kind, held_kind = (to_arrow_type(pairs.schema[c].dataType.elementType) for c in ("q_ids", "v_ids"))
    schema = pa.schema([("query", asked_kind), ("chunk", held_kind), ("cosine", pa.float64())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one pair of blocks; the others stay Arrow buffers
                ids, rows, chunk, theirs = (batch.column(c)[at].values for c in range(4))
                chunk, found = np.asarray(chunk.to_pylist()), []
                for i, row in zip(ids.to_pylist(), _unit_rows(rows) @ _unit_rows(theirs).T, strict=True):
                    rounded = np.where(chunk == i, -2.0, np.round(row, 6))
                    best = np.lexsort((chunk, -rounded))[:k]
                    found += [(i, c, s) for c, s in zip(chunk[best].tolist(), rounded[best].tolist(), strict=True) if s > -2]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(x, field.type) for x, field in zip(columns, schema, strict=True)], schema=schema)

    found = pairs.select("q_ids", "q_rows", "v_ids", "v_rows").mapInArrow(nearest, f"query {query_kind}, chunk {chunk_kind}, cosine double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "chunk"))), 1, k)
    return found.groupBy("query").agg(best.alias("best")).select("query", F.posexplode("best").alias("at", "b")).select("query", F.col("b.chunk").alias("chunk"), (-F.col("b.far")).alias("cosine"), (F.col("at") + 1).alias("place"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 8, match: tuple[str, ...] = ()) -> DataFrame:
    """query, chunk, cosine, place: the k vectors nearest to each query, itself left out.

    A stated set of queries meets all vectors block by block: each pair of blocks is one
    matrix product and gives at most k rows for each query, and an aggregation keeps the
    best k of those. Nothing is sent to the driver. With columns to match, a query meets
    the vectors that are equal to it in all of them (a null matches nothing).
    """
    keys = list(match)
    asked = _blocks(_usable(queries, *keys), QUERY_BLOCK, "q", keys)
    held = _blocks(_usable(vectors, *keys), VECTOR_BLOCK, "v", keys)
    if keys:
        pairs = held.join(asked.withColumnRenamed("block", "q"), keys)
    else:  # a stated set of queries against all rows, in blocks
        n = max(1, -(-_usable(queries).count() // QUERY_BLOCK))
        pairs = held.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(asked.withColumnRenamed("block", "q"), "q")
    return _best_of(pairs, k, queries.schema["chunk"].dataType.simpleString(), vectors.schema["chunk"].dataType.simpleString())


#: Rows that cells are fitted on at most, bytes they may take, steps of fitting, cells at most.
SAMPLE_ROWS, SAMPLE_BYTES, FIT_STEPS, MOST_CELLS = 16_384, 64 << 20, 8, 4096


class InvertedLists:
    """An approximate index: every vector in the list of its nearest cell, lists cut into blocks.

    Cells are fitted by Lloyd steps (spherical: by cosine) on a bounded sample, the rows
    with the smallest hashes of their ids: at most SAMPLE_ROWS rows of SAMPLE_BYTES in all.
    Every row is then assigned, and the lists are written as blocks of VECTOR_BLOCK rows,
    so that a cell with a third of all rows is many blocks. A search assigns each query to
    its `probes` nearest cells and meets only their blocks: a vector is sent once for every
    QUERY_BLOCK queries that probe its cell, and not at all where none does.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
        rows = _usable(vectors)
        self.kind = rows.schema["chunk"].dataType.simpleString()
        total, width = (lambda r: (r["n"], r["w"] or 1))(rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("w")).first())
        cells = cells or max(1, min(MOST_CELLS, round(total**0.5)))
        held = min(sample_rows, max(cells, SAMPLE_BYTES // (8 * width)))
        sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("chunk"), "chunk").limit(held).select("embedding").collect()]
        self.centres = self._fit(unit(sample), cells) if sample else np.zeros((0, width))
        lists = self._assigned(rows, 1)
        self.lists = materialize(_blocks(lists, VECTOR_BLOCK, "v", ["cell"]), "inverted-lists")

    @staticmethod
    def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
        centres = sample[: min(cells, len(sample))].copy()
        for _ in range(FIT_STEPS):
            nearest = np.argmax(sample @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, sample)
            used = np.bincount(nearest, minlength=len(centres)) > 0
            centres[used] = unit(sums[used])
        return centres

    def _assigned(self, rows: DataFrame, probes: int) -> DataFrame:
        """chunk, embedding, cell for each of a vector's nearest cells."""
        centres, most = self.centres, min(probes, len(self.centres))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch) if most else 0, ASSIGNED_AT_ONCE):  # distances to all cells of these rows only
                    some = batch.iloc[at : at + ASSIGNED_AT_ONCE]
                    near = _nearest_cells(unit(some.embedding) @ centres.T, most)
                    yield some.iloc[np.repeat(np.arange(len(some)), most)].assign(cell=near.ravel().astype("int32"))

        kind = rows.schema["embedding"].dataType.simpleString()
        return rows.mapInPandas(assign, f"chunk {rows.schema['chunk'].dataType.simpleString()}, embedding {kind}, cell int")

    def search(self, queries: DataFrame, k: int = 8, probes: int = 8) -> DataFrame:
        """query, chunk, cosine, place as cosine_topk gives them, out of the probed cells. Null vectors ask for nothing."""
        asked = _blocks(self._assigned(_usable(queries), probes), QUERY_BLOCK, "q", ["cell"])
        return _best_of(self.lists.join(asked.drop("block"), "cell"), k, queries.schema["chunk"].dataType.simpleString(), self.kind)

    def tuned_probes(self, vectors: DataFrame, queries: DataFrame, k: int = 8, recall: float = 0.95, most: int = QUERY_BLOCK) -> int:
        """The fewest probes, doubled from 1, that reach the recall against exact search for a bounded set of queries (the `most` with the smallest hashes)."""
        some = materialize(_usable(queries).orderBy(F.xxhash64("chunk"), "chunk").limit(most), "tuning")
        exact = materialize(cosine_topk(vectors, some, k).select("query", "chunk"), "tuning")
        probes, wanted = 1, exact.count()
        while probes < len(self.centres) and self.search(some, k, probes).join(exact, ["query", "chunk"], "left_semi").count() < recall * wanted:
            probes *= 2
        return min(probes, len(self.centres))


def marginal_relevance(candidates: DataFrame, vectors: DataFrame, k: int = 8, weight: float = 0.7) -> DataFrame:
    """query, chunk, score, place: k candidates of each query, each chosen for weight * its relevance less
    (1 - weight) * its largest cosine with those chosen before; the first for its relevance alone.

    candidates(query, chunk, cosine) are a bounded number for each query, as cosine_topk
    gives them; they meet their vectors by id. Scores are rounded to 6 places; ties go to
    the smaller id. A candidate without a vector is not chosen.
    """
    rows = candidates.select("query", "chunk", "cosine").join(_usable(vectors), "chunk")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", ignore_index=True)
        vectors_of, left, out = unit(group.embedding), list(range(len(group))), []
        same = np.round(vectors_of @ vectors_of.T, 6)
        worst = np.zeros(len(group))
        while left and len(out) < k:
            score = group.cosine.to_numpy() if not out else np.round(weight * group.cosine.to_numpy() - (1 - weight) * worst, 6)
            best = max(left, key=lambda i: (score[i], -i))
            worst = same[best] if not out else np.maximum(worst, same[best])
            left.remove(best)
            out.append((group["query"][best], group.chunk[best], float(score[best]), len(out) + 1))
        return pd.DataFrame(out, columns=["query", "chunk", "score", "place"])

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return rows.groupBy("query").applyInPandas(choose, f"query {kinds['query']}, chunk {kinds['chunk']}, score double, place int")


def retrieve(vectors: DataFrame, queries: DataFrame, k: int = 8, least: float = 0.15, widen: int = 3, most: int = 20) -> DataFrame:
    """query, chunk, similarity, place: of the `widen` * k nearest (at most `most`) those similar enough, the first k.

    Similarity is max(0, 1 - d / 2), d being the cosine distance.
    """
    near = cosine_topk(vectors, queries, min(most, widen * k)).withColumn("s", F.greatest(F.lit(0.0), 1 - (1 - F.col("cosine")) / 2))
    kept = near.where((F.col("s") >= least) & (F.col("place") <= k))  # the order is that of similarity, so what is kept has no gaps
    return kept.select("query", "chunk", F.round("s", 4).alias("similarity"), "place")


def similarity_to(vectors: DataFrame, query: list[float], least: float = 0.15) -> DataFrame:
    """Vectors whose similarity max(0, 1 - d / 2), d being the cosine distance, is at least the threshold."""
    lit = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding")
    cosine = dot(e, lit) / F.greatest(F.sqrt(dot(e, e)) * F.sqrt(dot(lit, lit)), F.lit(1e-12))
    rows = vectors.select("chunk", F.greatest(F.lit(0.0), 1 - (1 - cosine) / 2).alias("similarity"))
    return rows.where(F.col("similarity") >= least).select("chunk", F.round("similarity", 4).alias("similarity"))


def group_stats(vectors: DataFrame) -> DataFrame:
    """Vectors, mean norm and squared norm of the mean vector by label."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    by_place = vectors.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("m"))
    centre = by_place.groupBy("label").agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("centre_norm2"))
    return vectors.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(norm), 6).alias("avg_norm")).join(centre, "label")
