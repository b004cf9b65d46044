"""Relations of a code corpus as views over the tables at hand.

Each function gives a relation under the names that operators use, so that an operator
never sees where its rows came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, author, day, message."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("message"))


#: Changes that one task sorts or counts pairs of.
CHANGES_A_TASK = 500_000


def change_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for all changes, as many as the session has or more, so that a task's memory does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-load(spark, sf_dir, "lineitem").count() // CHANGES_A_TASK))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, path, additions, deletions, position within the commit."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = load(spark, sf_dir, "lineitem").repartition(change_tasks(spark, sf_dir), "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"), F.row_number().over(order).alias("position"))


def plain_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without positions, which cost a sort."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))


def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author and day of each line."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("day"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, language, project, size."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("project"), F.col("n_chars").alias("size"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, user_id, endpoint, duration_ms (whole), status."""
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("endpoint"), F.col("value").cast("long").alias("duration_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, turn, role, content."""
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", F.col("text").alias("content"))
