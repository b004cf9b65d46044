"""Vector code compression: product codes over integer vectors, nearest entries by screening.

A vector is cut into equal parts, and each part is replaced by the index of the nearest
entry of that part position's codebook. Entries are found in two steps. A float32 matrix
product gives every squared distance up to a rounding error, which is bounded by
gamma(d + 2) |a| |c| (d products and their sums, in any order, and two operands rounded to
float32), so that each distance lies in a known interval. Every entry whose interval
overlaps that of the best one is then measured again in 64-bit integers, and ties go to the
lower index. The codes are those of an exact search, whatever order the product sums in.

Codebooks are fitted by rounds over all rows. A task sums what it assigns, entry by entry,
and Spark adds the tasks' sums: a round shuffles entries x dimension numbers for each task,
whatever its rows. Codebooks have entries x dimension numbers, a bound set by parameters,
so they may pass through the driver and travel to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_batches, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows screened at once, and pairs of a row and an entry measured at once.
SCREEN_ROWS, EXACT_PAIRS = 1024, 1 << 16
#: A label with over one in so many of the rows is a hot one; there are at most so many of them.
HOT_SHARE = 20_000


def largest(dimension: int) -> int:
    """Integers below this have squared distances, summed over a vector, that fit in 62 bits."""
    return int(2**30 / max(1, dimension) ** 0.5)


def screened(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and entries of all pairs whose interval overlaps that of the row's best entry; in order."""
    a, c = parts.astype(np.float64), book.astype(np.float64)
    product = (parts.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    size_a, size_c = np.sqrt((a * a).sum(1)), np.sqrt((c * c).sum(1))
    terms = parts.shape[1] + 2
    gamma = terms * 2.0**-24 / (1 - terms * 2.0**-24)
    square = (c * c).sum(1)
    near = square[None, :] - 2 * product
    # The norms, their product and the sum above are rounded in float64; 2**-40 of each is more than enough.
    slack = (2 * gamma + 2.0**-40) * size_a[:, None] * size_c[None, :] + 2.0**-40 * (square[None, :] + 2 * np.abs(product))
    return np.nonzero(near - slack <= (near + slack).min(1, keepdims=True))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry, ties to the lower, and its squared distance, both exact."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), SCREEN_ROWS):
        block = parts[at : at + SCREEN_ROWS]
        rows, entries = screened(block, book)
        exact = np.empty(len(rows), np.int64)
        step = max(1, EXACT_PAIRS * 16 // max(16, parts.shape[1]))
        for i in range(0, len(rows), step):
            apart = block[rows[i : i + step]] - book[entries[i : i + step]]
            exact[i : i + step] = np.einsum("ij,ij->i", apart, apart)
        starts = np.searchsorted(rows, np.arange(len(block)))
        best = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == best[rows])
        first = hits[np.searchsorted(rows[hits], np.arange(len(block)))]
        index[at : at + len(block)], error[at : at + len(block)] = entries[first], best
    return index, error


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dimension)


def _positions(vectors: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    width = books.shape[2]
    for p in range(len(books)):
        yield p, vectors[:, p * width : (p + 1) * width], books[p]


def round_sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, at, total, n: what one round assigns to each used entry, summed by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("ints"), books.shape[0] * books.shape[2])
            for p, parts, book in _positions(vectors, books):
                index, _ = nearest(parts, book)
                np.add.at(sums[p], index, parts)
                counts[p] += np.bincount(index, minlength=len(book))
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(list(sums[p][used]), pa.list_(pa.int64())), pa.array(counts[p][used])], names=["part", "entry", "sums", "n"])

    tasks = map_batches(kept.select("ints"), run, "part int, entry int, sums array<bigint>, n bigint")
    return tasks.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("s").alias("total"), F.sum("n").alias("n"))


def first_books(kept: DataFrame, parts: int, entries: int, dimension: int) -> np.ndarray:
    """Codebooks of the rows with the smallest ids (null ids last, ties by vector)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    vectors = np.array([r["ints"] for r in rows], np.int64).reshape(len(rows), parts, dimension // parts)
    return np.ascontiguousarray(vectors.transpose(1, 0, 2))


def fit(kept: DataFrame, parts: int, entries: int, rounds: int, dimension: int) -> np.ndarray:
    """Codebooks as an array by part, entry and position, after the rounds."""
    books = first_books(kept, parts, entries, dimension)
    for _ in range(rounds):
        following = books.copy()
        for r in round_sums(kept, books).collect():
            following[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        books = following
    return books


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, ints, peak: floor(scale * x) of vectors without null or non-finite components, and the largest size of one."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(1 << 60)), F.lit(-(1 << 60))))
    out = vectors.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), held.alias("ints"))
    return out.withColumn("peak", F.coalesce(F.greatest(F.array_max("ints"), -F.array_min("ints")), F.lit(0)))


def _dimension(rows: DataFrame) -> int | None:
    """The most frequent length (ties: the longest)."""
    found = rows.groupBy(F.size("ints").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return None if found is None else found["d"]


def _fits(dimension: int) -> Column:
    return (F.size("ints") == dimension) & (F.col("peak") < largest(dimension))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks); rows are vec_id, label, code (binary, one byte or two for each part), error.

    Vectors that are null or hold a null, NaN or infinite component are left out. The
    dimension is the most frequent length of the others. A vector of another length, or
    with a component that 64-bit distances cannot hold (from 2**30 / sqrt(dimension) on,
    scaled), keeps its row with code and error null and takes no part in fitting. Repeated
    rows count as often as they occur; null ids come after all others where the first
    codebooks are taken. Fewer rows than entries give as many entries as rows; no rows give
    no rows and codebooks without entries. Other columns are not looked at.
    """
    if not 1 <= entries <= 1 << 16:
        raise ValueError("a codebook has from 1 to 65536 entries")
    rows = materialize(integer_vectors(vectors, id_col, vector_col, label_col, scale), "integer-vectors")
    dimension = _dimension(rows)
    if dimension is None:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error")), np.zeros((parts, 0, 0), np.int64)
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    kept = rows.where(_fits(dimension)).select("vec_id", "label", "ints")
    books = fit(kept, parts, entries, rounds, dimension)
    size = np.uint8 if entries <= 256 else np.dtype(">u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(p, book) for _, p, book in _positions(_matrix(batch.column("ints"), dimension), books)]
            codes = np.stack([index for index, _ in found], 1).astype(size)
            error = np.sum([e for _, e in found], 0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error bigint"
    others = rows.where(~_fits(dimension)).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return map_batches(kept, run, schema).union(others), books


def with_group_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows, a written table, with the sum of value over all rows of an equal key (nulls together).

    The sums of hot keys are broadcast, at most HOT_SHARE of them whatever the rows; the
    rest meet in a shuffled join, which then has no hot key.
    """
    k, n, s = (fresh(rows, c) for c in ("sum_key", "sum_rows", "sum_value"))
    sums = materialize(rows.groupBy(F.col(key).alias(k)).agg(F.count("*").alias(n), F.sum(value).alias(s)), "group-sums")
    total = sums.agg(F.sum(n)).first()[0] or 0
    hot, rest = F.broadcast(sums.where(F.col(n) * HOT_SHARE >= total)), sums.where(F.col(n) * HOT_SHARE < total)
    own = [*(F.col(c) for c in rows.columns), F.col(s).alias(name)]
    same = rows[key].eqNullSafe(F.col(k))
    return rows.join(hot, same).select(*own).union(rows.join(hot, same, "left_anti").join(rest, same).select(*own))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    rows = with_group_sum(materialize(rows, "vector-codes"), "label", "error", "label_error")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by plain search over all entries, rounds unrolled."""
    cut = "(SELECT uid, unnest(range(d)) AS i, unnest(ints) AS x FROM kept)"
    out = f"""
WITH scaled AS (
  SELECT row_number() OVER () AS uid, vec_id, label, len(embedding) AS d, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS place FROM scaled
), comps AS MATERIALIZED (
  SELECT c.uid, k.place, (c.i // (k.d // {PARTS}))::INT AS part, (c.i % (k.d // {PARTS}))::INT AS pos, c.x FROM {cut} c JOIN kept k USING (uid)
), book0 AS MATERIALIZED (SELECT part, place AS entry, pos, x FROM comps WHERE place < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        out += f""", near{r} AS MATERIALIZED (
  SELECT uid, part, min((dist, entry)) AS best FROM (
    SELECT c.uid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS dist FROM comps c JOIN book{r} b USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)"""
        if r < ROUNDS:
            out += f""", sums{r} AS (
  SELECT c.part, n.best[2] AS entry, c.pos, sum(c.x)::BIGINT AS s, count(*) AS n FROM comps c JOIN near{r} n USING (uid, part) GROUP BY ALL
), book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, CASE WHEN s IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM book{r} b LEFT JOIN sums{r} USING (part, entry, pos))"""
    return out + f""", codes AS (
  SELECT uid, string_agg(lower(printf('%02x', best[2]::INT)), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY uid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN codes USING (uid)
"""


ORACLE_SQL = _oracle()
