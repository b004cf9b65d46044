"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its own content says (at punctuation, 256
to 4096 code points apart), so equal texts are cut alike. Only digests of chunks are
shuffled: a dictionary groups them by a 64-bit key and verifies each key by the
SHA-256 of the chunks that have it; keys that stand for several digests get one
identifier for each digest. Two texts are equal when their ordered lists of verified
identifiers are. The texts themselves are read once and never moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, broadcast_if_small, fresh, materialize, table

MIN_CHUNK, MAX_CHUNK = 256, 4096


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    return rf"(?s).{{{least},{most - 1}}}?[.!?,;:|]|.{{1,{most}}}"


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """uid, doc_id, n_chars, text_sha256, chunks: array of (key, digest), in text order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, SPACE_CLASS + "+", "").alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0))
    digests = F.transform(cut, lambda c: F.struct(F.xxhash64(c).alias("key"), F.unhex(F.sha2(c, 256)).alias("digest")))
    return norm.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), digests.alias("chunks"))


def clashing_keys(chunks: DataFrame) -> DataFrame:
    """key of each 64-bit key that stands for several digests; counted before it is shuffled, so a hot chunk is one row of each task."""
    used = chunks.select(F.explode("chunks").alias("chunk")).groupBy(F.col("chunk.key").alias("key")).agg(F.min("chunk.digest").alias("lo"), F.max("chunk.digest").alias("hi"))
    return materialize(used.where("lo <> hi").select("key"), "clashes")


def recipes(chunks: DataFrame) -> DataFrame:
    """uid, doc_id, n_chars, text_sha256, recipe: the ordered verified identifiers.

    The dictionary verifies every key against the digests of all chunks that have it. A
    key that passes is the chunk's identifier, made within the row; texts with one that
    does not (about one key in 2^64 / chunks) take key and digest there.
    """
    clashes = clashing_keys(chunks)
    if clashes.isEmpty():
        return chunks.select("uid", "doc_id", "n_chars", "text_sha256", F.transform("chunks", lambda c: F.hex(c["key"])).alias("recipe"))
    marks = chunks.select("uid", F.explode("chunks.key").alias("key")).join(broadcast_if_small(clashes), "key").groupBy("uid").agg(F.collect_set("key").alias("clashing"))
    joined = chunks.join(broadcast_if_small(materialize(marks, "clashing")), "uid", "left")
    ident = lambda c: F.when(F.array_contains("clashing", c["key"]), F.concat(F.hex(c["key"]), F.lit(":"), F.hex(c["digest"]))).otherwise(F.hex(c["key"]))
    return joined.select("uid", "doc_id", "n_chars", "text_sha256", F.transform("chunks", ident).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row for each input row: uid, doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical without ASCII white space; null counts as empty,
    and all empty texts are equal. Of equal texts the longest original stays, then the
    smallest doc_id (null last), then the first row read, so repeated rows leave one.
    Columns other than id_col and text_col are not looked at. No rows give no rows.

    Lists of identifiers are grouped and joined by their SHA-256; only groups of several
    rows come back to the rows, by broadcast while they are small.
    """
    found = recipes(materialize(chunk_table(docs, id_col, text_col, least, most), "chunks"))
    found = found.select("uid", "doc_id", "n_chars", "text_sha256", F.size("recipe").cast("long").alias("n_chunks"), F.unhex(F.sha2(F.array_join("recipe", ","), 256)).alias("rid"))
    order = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid")
    groups = found.groupBy("rid").agg(F.count("*").alias("size"), F.min(order).alias("best")).where("size > 1").select("rid", "size", F.col("best.doc_id").alias("best_id"), F.col("best.uid").alias("best_uid"))
    alone = F.col("size").isNull()
    return found.join(broadcast_if_small(materialize(groups, "groups")), "rid", "left").select(
        "uid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"),
        (alone | (F.col("uid") == F.col("best_uid"))).alias("kept"), "text_sha256", "n_chunks",
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows are known by doc_id and the digest of their text. Where rows that share both
    are repeated, the longest original of them stays; of equally long ones that differ in
    other columns, the one whose columns hash highest.
    """
    key, digest, stays = (fresh(docs, name) for name in ("row_id", "row_sha", "stays"))
    sha = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), SPACE_CLASS + "+", ""), 256)
    states = (
        exact_dedup(docs)
        .where("group_size > 1")
        .groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest))
        .agg(F.max("kept").alias(stays), F.count("*").alias("rows"))
        .where(~F.col(stays) | (F.col("rows") > 1))
        .drop("rows")
    )
    states = materialize(states, "dropped")
    states = broadcast_if_small(states)
    seen = docs.join(states, docs["doc_id"].eqNullSafe(F.col(key)) & (sha == F.col(digest)), "left")
    once = seen.where(F.col(stays).isNull()).select(*docs.columns)
    whole = F.struct(*docs.columns)
    repeated = seen.where(F.col(stays)).groupBy(key, digest).agg(F.max_by(whole, F.struct(F.length(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns))).alias("row")).select("row.*")
    return once.unionByName(repeated)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM w
"""
