"""Helpers shared by the training-data operators: table access and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.functions.tables import forget, materialize, shared_dir  # noqa: F401

#: ASCII white space as the contracts list it.
SPACE_CLASS = r"[\x20\x09-\x0D]"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case so that the ASCII letters of words come out as A-Z lower-cased.

    lower() also folds other letters; that never turns a letter outside ASCII into
    a whole ASCII word, but for the Kelvin sign, which is set aside first.
    """
    return F.lower(F.replace(text, F.lit("K"), F.lit("Ω")))


#: Bytes of a side that may be broadcast; above it the join shuffles.
BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows: its strings and binaries as long as they are, 16 for each value."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return df.agg(F.sum(sum(long, F.lit(16 * len(df.columns)))).alias("bytes")).first()["bytes"] or 0


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast a materialized side whose measured bytes are within the limit, else leave the join to shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, null counting as empty; with the doc_id it tells rows apart whose ids are null or repeated."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digested(docs: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """doc_id and text, and the text's digest where it is asked for."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([text_digest(text).alias("digest")] if digests else []))


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose doc_id and text are not those of a row of gone(doc_id, digest), with all their columns."""
    gone = materialize(gone.select("doc_id", "digest").distinct(), name)
    key, digest, own = (fresh(docs, c) for c in ("gone_id", "gone_digest", "own_digest"))
    gone = broadcast_if_small(gone.toDF(key, digest))
    marked = docs.withColumn(own, text_digest(docs["text"]))
    return marked.join(gone, marked["doc_id"].eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left_anti").select(*docs.columns)


#: Rows of whole texts that go to a Python worker at once, where nobody has set their number.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release_memory() -> None:
    """Give back to the system what a task has freed, as a worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over small batches, memory released at the end of each task."""
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(_BATCH_SETTING):
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_ROWS))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(bounded, schema)
