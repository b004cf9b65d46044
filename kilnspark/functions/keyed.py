"""A table that is kept up to date by key: upserts, deletions and counters over a partitioned parquet folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import forget, materialize

BATCH = "applied_batch"


class KeyedTable:
    """Rows with unique keys in a folder partitioned by one column; `applied_batch` is the batch that last changed a row.

    A change reads and rewrites only the partitions that hold its keys, old or new: rows of
    those that it leaves alone meet the new ones in an anti-join, and the union replaces
    the partitions, each at once. What a batch has changed is not changed by it again nor
    by an earlier one, so a batch that comes twice, as foreachBatch may send it after a
    failure, leaves the table as it is. The partition column is a function of the row; keys
    with a null are kept like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], partition: str) -> None:
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), keys, partition
        self.columns = schema.fieldNames()
        self.schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])

    def _folder(self, name: str | None = None):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path if name is None else f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """The table's rows; none where nothing was written."""
        where, system = self._folder()
        if not system.exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.fieldNames())

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & left[k].eqNullSafe(right[k])
        return out

    def _replace(self, touched: DataFrame, rows: DataFrame) -> list:
        """Put rows in place of the touched partitions; gives their values."""
        rows = materialize(rows.select(*self.schema.fieldNames()), "merged")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.path)
        # a partition that all rows have left has nothing to be replaced by
        left = touched.join(rows.select(self.partition).distinct(), touched[self.partition].eqNullSafe(rows[self.partition]), "left_anti")
        named = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for r in left.collect():  # partitions are folders, which the driver lists in any case
            where, system = self._folder(named.getPartitionPathString(self.partition, None if r[0] is None else str(r[0])))
            system.delete(where, True)
        changed = [r[0] for r in touched.collect()]
        forget(rows)
        return changed

    def _touched(self, old: DataFrame, new: DataFrame) -> DataFrame:
        held = old.select(self.partition, *self.keys)
        held = held.join(new.select(*self.keys), self._same(held, new), "left_semi")
        return materialize(held.select(self.partition).union(new.select(self.partition)).distinct(), "touched")

    def _of(self, rows: DataFrame, touched: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(touched), rows[self.partition].eqNullSafe(touched[self.partition]), "left_semi")

    def upsert(self, rows: DataFrame, batch: int, order: list[str] | None = None) -> list:
        """Insert or replace rows by key, of rows with one key the last in the order; the values of rewritten partitions."""
        last = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc_nulls_last() for c in order or self.columns])
        new = rows.select(*self.columns).withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place").withColumn(BATCH, F.lit(batch).cast("long"))
        old = self.read()
        done = old.where(F.col(BATCH) >= batch)
        new = materialize(new.join(done, self._same(new, done), "left_anti"), "changes")
        if new.isEmpty():
            return []
        touched = self._touched(old, new)
        kept = self._of(old, touched)
        return self._replace(touched, kept.join(new, self._same(kept, new), "left_anti").unionByName(new))

    def add(self, counts: DataFrame, batch: int, counters: list[str]) -> list:
        """Add to counters by key, in new rows where there is none; counts has the table's columns."""
        first = [F.first(c, ignorenulls=True).alias(c) for c in self.columns if c not in self.keys and c not in counters]
        new = counts.groupBy(*self.keys).agg(*first, *[F.sum(c).cast(self.schema[c].dataType).alias(c) for c in counters])
        old = self.read()
        done = old.where(F.col(BATCH) >= batch)
        new = materialize(new.join(done, self._same(new, done), "left_anti"), "changes")
        if new.isEmpty():
            return []
        touched = self._touched(old, new)
        both = self._of(old, touched).withColumn("_batch", F.col(BATCH)).unionByName(new.withColumn(BATCH, F.lit(batch).cast("long")).withColumn("_batch", F.lit(None).cast("long")), allowMissingColumns=True)
        # old rows keep their other columns
        value = lambda c: F.coalesce(F.first(F.when(F.col("_batch").isNotNull(), F.col(c)), ignorenulls=True), F.first(c, ignorenulls=True)).alias(c)
        merged = both.groupBy(*self.keys).agg(*[F.sum(c).cast(self.schema[c].dataType).alias(c) if c in counters else value(c) for c in self.columns if c not in self.keys], F.max(BATCH).alias(BATCH))
        return self._replace(touched, merged)

    def delete(self, keys: DataFrame) -> list:
        """Take out the rows of these keys; the values of rewritten partitions."""
        old = self.read()
        gone = materialize(old.join(keys, self._same(old, keys), "left_semi"), "gone")
        if gone.isEmpty():
            return []
        touched = materialize(gone.select(self.partition).distinct(), "touched")
        kept = self._of(old, touched)
        return self._replace(touched, kept.join(gone, self._same(kept, gone), "left_anti"))

    def each_batch(self, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of rows."""
        return lambda rows, batch: self.upsert(rows, batch, order) and None
