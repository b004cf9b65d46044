"""Tables that end a lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of our own in local mode and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (context.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-kiln-")
    return _own_dir[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Lineage ends at files which every executor can read, so a lost executor costs
    the tasks it ran and no earlier step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kiln_path = path
    return out


def materialize_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The written table, and sums (0 over no rows) that the writing job takes along; what loops ask of each step costs no job of its own."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count("*").alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()]), name)
    return out, seen.get


def materialize_by(df: DataFrame, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """The written table in buckets of key, so that joins on it move the other side only. dealt: df comes from a join on key and is written where it lies."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{table}"
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._kiln_path, out._kiln_table = path, table
    return out


def forget(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_kiln_path", None)
    if path is None:
        return
    if getattr(df, "_kiln_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._kiln_table}")
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
