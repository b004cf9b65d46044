from __future__ import annotations

import glob
import os
import tempfile

from pyspark.sql import types as T

from kilnspark.functions.keyed import KeyedTable
from kilnspark.operators import lifecycle

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("part", T.StringType()), T.StructField("v", T.StringType()), T.StructField("n", T.LongType())])


def table(spark, path=None):
    return KeyedTable(spark, "file://" + (path or tempfile.mkdtemp(prefix="spark-keyed-") + "/t"), SCHEMA, ["k"], "part")


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def held(t):
    return sorted((tuple(r) for r in t.read().collect()), key=str)


def files(t):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(t.path.removeprefix("file://") + "/part=*/*.parquet")}


def test_a_batch_twice_changes_nothing_and_other_partitions_stay(spark):
    t = table(spark)
    assert held(t) == []
    assert sorted(t.upsert(rows(spark, (1, "a", "x", 1), (2, "a", "y", 1), (3, "b", "z", 1), (3, "b", "zz", 2), (None, "c d/e", "null key", 1)), 1, ["n"])) == ["a", "b", "c d/e"]
    first = held(t)
    assert first == sorted([(1, "a", "x", 1, 1), (2, "a", "y", 1, 1), (3, "b", "zz", 2, 1), (None, "c d/e", "null key", 1, 1)], key=str)
    before = files(t)
    assert t.upsert(rows(spark, (1, "a", "again", 9)), 1) == [] and files(t) == before
    assert t.upsert(rows(spark, (2, "a", "new", 5)), 2) == ["a"]
    assert {f for f in before if "part=a" not in f} <= set(files(t)) and not any("part=a" in f for f in set(before) & set(files(t)))
    assert t.upsert(rows(spark, (2, "a", "stale", 5)), 1) == []
    assert (2, "a", "new", 5, 2) in held(t) and len(held(t)) == 4


def test_rows_move_and_leave(spark):
    t = table(spark)
    t.upsert(rows(spark, (1, "a", "x", 1), (2, "b", "y", 1)), 1)
    assert sorted(t.upsert(rows(spark, (1, "b", "moved", 1)), 2)) == ["a", "b"]
    assert held(t) == [(1, "b", "moved", 1, 2), (2, "b", "y", 1, 1)] and not any("part=a" in f for f in files(t))
    assert t.delete(rows(spark, (2, None, None, None), (77, None, None, None)).select("k")) == ["b"]
    assert held(t) == [(1, "b", "moved", 1, 2)]
    assert t.delete(rows(spark, (1, None, None, None)).select("k")) == ["b"] and held(t) == [] and t.delete(rows(spark, (1, None, None, None)).select("k")) == []


def test_counters_count_a_batch_once(spark):
    t = table(spark)
    t.upsert(rows(spark, (1, "a", "x", 5)), 0)
    for batch in (1, 1, 2, 1):
        t.add(rows(spark, (1, "a", None, 1), (1, "a", None, 1), (4, "c", "new", 3)), batch, ["n"])
    assert held(t) == [(1, "a", "x", 9, 2), (4, "c", "new", 6, 2)]


def test_a_stream_of_batches(spark):
    t, where = table(spark), tempfile.mkdtemp(prefix="spark-keyed-")
    for given in ([(1, "a", "x", 1), (2, "b", "y", 1)], [(1, "a", "z", 2)]):
        rows(spark, *given).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{where}/in")
        stream.writeStream.foreachBatch(t.each_batch()).option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start().awaitTermination()
    assert [r[:4] for r in held(t)] == [(1, "a", "z", 2), (2, "b", "y", 1)]


def test_task_states_and_what_they_were(spark):
    log = spark.createDataFrame([(1, 1, 10, "PENDING", None), (1, 2, 20, "RUNNING", 0.2), (1, 3, 30, "RUNNING", 0.1), (1, 4, 40, "COMPLETED", None), (1, 5, 50, "RUNNING", 0.5), (2, 1, 10, "RUNNING", None), (2, 2, 15, "FAILED", None), (2, 3, 16, "PENDING", None), (None, 1, 1, "PENDING", None)], "task long, seq long, us long, wanted string, progress double")
    states = lifecycle.lifecycles(log)
    got = {(r.task, r.seq): (r.status, r.fault, r.progress, r.started_us, r.ended_us) for r in states.collect()}
    assert got == {
        (1, 1): ("PENDING", None, 0.0, None, None), (1, 2): ("RUNNING", None, 0.2, 20, None), (1, 3): ("RUNNING", None, 0.2, 20, None), (1, 4): ("COMPLETED", None, 1.0, 20, 40), (1, 5): ("COMPLETED", "COMPLETED>RUNNING", 1.0, 20, 40),
        (2, 1): ("PENDING", "NEW>RUNNING", 0.0, None, None), (2, 2): ("FAILED", None, 0.0, None, 15), (2, 3): ("PENDING", None, 0.0, None, None),
    }
    asked = spark.createDataFrame([("a", 1, 9), ("b", 1, 10), ("c", 1, 35), ("d", 1, 99), ("e", 5, 1)], "question string, task long, us long")
    assert {r.question: (r.status, r.progress) for r in lifecycle.as_of(asked, states).collect()} == {"a": ("UNKNOWN", 0.0), "b": ("PENDING", 0.0), "c": ("RUNNING", 0.2), "d": ("COMPLETED", 1.0), "e": ("UNKNOWN", 0.0)}
    assert lifecycle.lifecycles(log.limit(0)).collect() == []
