"""From raw documents to packed training sequences, five stages one after the other.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and is
written and read again before the next. A stage learns and decides on what its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilnspark.llm import exact_dedup, language_id, near_dedup, packing, quality
from kilnspark.llm.common import materialize, table

#: Documents below this quality score go; lower than the operator's own mark, to keep clean documents.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.survivors(docs, table(spark, sf_dir, "labels"), threshold=LEAST_QUALITY)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, most of its words agreeing."""
    return language_id.survivors(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, 0.8)."""
    return near_dedup.survivors(docs, k=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("packing", packing_stage),
]

#: The stages learn, hash and tokenize; SQL cannot express them. Tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
