"""Queries over tables kept up to date by key and over logs of tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnspark.functions.keyed import KeyedTable
from kilnspark.functions.tables import materialize, shared_dir
from kilnspark.operators import lifecycle
from kilnspark.sources import corpus as c

_ROW = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("last_endpoint", T.StringType()), T.StructField("requests", T.LongType())])
#: Batches as they come, one of them twice and one again after a later one.
_BATCHES = [0, 1, 1, 2, 0, 3]


def _rows(spark, sf_dir):
    return c.requests(spark, sf_dir).select("user_id", (F.col("user_id") % 16).alias("shard"), F.col("id").alias("last_id"), F.col("endpoint").alias("last_endpoint"), F.lit(1).cast("long").alias("requests"), (F.col("id") % 4).alias("batch"))


def _table(spark, name):
    return KeyedTable(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}", _ROW, ["user_id"], "shard")


def _upserts(spark, sf_dir):
    """The last request of each user in the last batch that has one."""
    rows, table = materialize(_rows(spark, sf_dir), "rows"), _table(spark, "upserts")
    for batch in _BATCHES:
        table.upsert(rows.where(F.col("batch") == batch), batch, ["last_id"])
    return table.read().select("user_id", "last_id", "last_endpoint", "applied_batch")


def _counters(spark, sf_dir):
    """Requests of each user over all batches, each counted once."""
    rows, table = materialize(_rows(spark, sf_dir), "rows"), _table(spark, "counters")
    for batch in _BATCHES:
        table.add(rows.where(F.col("batch") == batch), batch, ["requests"])
    return table.read().select("user_id", "requests")


_WANTED = ["PENDING", "RUNNING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]


def _log(spark, sf_dir):
    """An order is a task; its lines ask for states, by ship date."""
    li = c.load(spark, sf_dir, "lineitem")
    wanted = F.element_at(F.array(*map(F.lit, _WANTED)), (F.col("l_partkey") % len(_WANTED)).cast("int") + 1)
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("task"), seq.alias("s"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), wanted.alias("wanted"), (F.col("l_quantity") / 100).alias("progress"))


def _states(spark, sf_dir):
    """Lines of a day are taken in the order of their columns."""
    rows = _log(spark, sf_dir)
    number = F.expr("row_number() OVER (PARTITION BY task ORDER BY us, s)").cast("long")
    return lifecycle.lifecycles(rows.withColumn("seq", number).select("task", "seq", "us", "wanted", "progress"))


def _questions(spark, sf_dir):
    """What was each order 1500 days after it was placed?"""
    us = F.unix_micros(F.expr("CAST(o_orderdate AS timestamp) + INTERVAL 1500 DAYS"))
    return c.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderkey").alias("task"), us.alias("us"))


QUERIES = {
    "keyed_upserts": _upserts,
    "keyed_counters": _counters,
    "task_lifecycles": _states,
    "task_status_as_of": lambda s, d: lifecycle.as_of(_questions(s, d), _states(s, d)),
}

_MAY = " OR ".join(f"(w.status = '{a}' AND o.wanted IN ({', '.join(repr(x) for x in b)}))" for a, b in lifecycle.NEXT.items() if b)
_LIFE = f"""o AS MATERIALIZED (SELECT l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, epoch_us(l_shipdate) AS us, ({_WANTED})[l_partkey % {len(_WANTED)} + 1] AS wanted, l_quantity / 100 AS part FROM lineitem),
w AS (SELECT task, seq, us, 'PENDING' AS status, CASE WHEN wanted <> 'PENDING' THEN 'NEW>' || wanted END AS fault, 0.0::DOUBLE AS progress, NULL::BIGINT AS started_us, NULL::BIGINT AS ended_us FROM o WHERE seq = 1
  UNION ALL
  SELECT o.task, o.seq, o.us, CASE WHEN {_MAY} THEN o.wanted ELSE w.status END, CASE WHEN {_MAY} THEN NULL ELSE w.status || '>' || o.wanted END,
    CASE WHEN NOT ({_MAY}) THEN w.progress WHEN o.wanted = 'PENDING' THEN 0 WHEN o.wanted = 'RUNNING' THEN greatest(w.progress, o.part) WHEN o.wanted = 'COMPLETED' THEN 1 ELSE w.progress END,
    CASE WHEN NOT ({_MAY}) THEN w.started_us WHEN o.wanted = 'PENDING' THEN NULL WHEN o.wanted = 'RUNNING' THEN coalesce(w.started_us, o.us) ELSE w.started_us END,
    CASE WHEN NOT ({_MAY}) THEN w.ended_us WHEN o.wanted IN ('PENDING', 'RUNNING') THEN NULL ELSE o.us END
  FROM w JOIN o ON o.task = w.task AND o.seq = w.seq + 1)"""

ORACLE = {
    "keyed_upserts": "SELECT user_id, event_id AS last_id, event_type AS last_endpoint, event_id % 4 AS applied_batch FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) = 1",
    "keyed_counters": "SELECT user_id, count(*) AS requests FROM events GROUP BY user_id",
    "task_lifecycles": f"WITH RECURSIVE {_LIFE} SELECT * FROM w",
    "task_status_as_of": f"""WITH RECURSIVE {_LIFE}, q AS (SELECT o_orderkey AS task, epoch_us(o_orderdate + INTERVAL 1500 DAYS) AS us FROM orders),
a AS (SELECT q.task, q.us, max_by(struct_pack(status := w.status, progress := w.progress), w.seq) AS s FROM q LEFT JOIN w ON w.task = q.task AND w.us <= q.us GROUP BY 1, 2)
SELECT task AS question, task, us, coalesce(s.status, 'UNKNOWN') AS status, coalesce(s.progress, 0.0) AS progress FROM a""",
}
