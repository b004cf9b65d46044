"""Request telemetry: endpoint totals, percentiles, windows, rate limits, progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def endpoint_stats(requests: DataFrame) -> DataFrame:
    """Hits, errors and mean latency (whole milliseconds) by endpoint."""
    return requests.groupBy("endpoint").agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("status") >= 400).alias("errors"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.round(F.count_if(F.col("status") >= 400) * 100 / F.count("*"), 2).alias("error_rate"))


def latency_percentiles(requests: DataFrame, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Lower nearest-rank percentiles: the value at place max(1, floor(n p / 100)).

    Values are first counted by endpoint and value, so the cumulative window runs over
    distinct values and not over requests.
    """
    counts = requests.groupBy("endpoint", "duration_ms").agg(F.count("*").alias("n"))
    up = Window.partitionBy("endpoint").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("endpoint", "duration_ms", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy("endpoint")).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("total") * p / 100)), F.col("duration_ms"))).alias(f"p{p}")
    return ranked.groupBy("endpoint").agg(F.max("total").alias("requests"), *map(at, percents))


def status_families(requests: DataFrame) -> DataFrame:
    """Requests by hundred of the status."""
    return requests.groupBy(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("family")).agg(F.count("*").alias("requests"))


def tumbling(requests: DataFrame, unit: str) -> DataFrame:
    """Totals by hour or day."""
    return requests.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.countDistinct("user_id").alias("users"))


def rate_window_usage(requests: DataFrame, seconds: int) -> DataFrame:
    """For each request, the user's requests in the trailing window, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    trailing = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("at", at).select("id", "user_id", F.count("*").over(trailing).alias("used"))


def rate_limit_decisions(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Accept or reject each request by a sliding window over accepted ones.

    Whether a request counts depends on the decisions before it, which no window
    expresses; each user's times are folded in order, holding at most `limit` of them.
    Rows arrive sorted in partitions dealt by user, so no user is ever held in memory. A
    user's requests are one task, however many: the rule is sequential in them.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    dealt = requests.select("id", "user_id", at.alias("at")).repartition("user_id").sortWithinPartitions("user_id", "at", "id")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        user, recent = None, deque()
        for batch in batches:
            accepted, used = [], []
            for u, t in zip(batch.user_id, batch["at"], strict=True):
                if u != user:
                    user, recent = u, deque()
                while recent and recent[0] <= t - seconds * 1_000_000:
                    recent.popleft()
                allow = len(recent) < limit
                if allow:
                    recent.append(t)
                accepted.append(allow)
                used.append(len(recent))
            yield pd.DataFrame({"id": batch.id, "user_id": batch.user_id, "allowed": accepted, "used": used})

    kind = lambda c: requests.schema[c].dataType.simpleString()
    return dealt.mapInPandas(decide, f"id {kind('id')}, user_id {kind('user_id')}, allowed boolean, used long")


def idle_sessions(requests: DataFrame, gap: str) -> DataFrame:
    """Bursts of each user's requests that lie no more than the gap apart."""
    rows = requests.select("user_id", F.col("ts").cast("timestamp").alias("t"))
    out = rows.groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("requests"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first_ts"), F.col("last").cast("timestamp_ntz").alias("last_ts"), "requests")


def latest_progress(requests: DataFrame) -> DataFrame:
    """The newest request of each user, and how many there were."""
    return requests.groupBy("user_id").agg(F.count("*").alias("updates"), F.max_by(F.struct("id", "endpoint", "duration_ms"), F.struct("ts", "id")).alias("last")).select("user_id", "updates", "last.id", "last.endpoint", "last.duration_ms")


def change_only(requests: DataFrame) -> DataFrame:
    """Requests whose endpoint differs from the user's one before."""
    before = F.lag("endpoint").over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return requests.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("endpoint"))).select("id", "user_id", "endpoint", "before")


def top_users(requests: DataFrame, each: int = 5) -> DataFrame:
    """The users with most requests for each endpoint, counted before they are ranked."""
    counts = requests.groupBy("endpoint", "user_id").agg(F.count("*").alias("requests"))
    r = F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("requests"), "user_id"))
    return counts.withColumn("place", r).where(F.col("place") <= each)


def hourly_log(requests: DataFrame, each: int = 100) -> DataFrame:
    """The newest requests of each hour, newest first, at most `each`."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    place = F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("ts"), F.desc("id")))
    return requests.select("id", "ts", hour.alias("hour"), "endpoint", "status").withColumn("place", place).where(F.col("place") <= each).select("hour", "place", "id", "endpoint", "status")


def recent_errors(requests: DataFrame, most: int = 50) -> DataFrame:
    """The newest failed requests."""
    return requests.where("status >= 400").orderBy(F.desc("ts"), F.desc("id")).limit(most).select("id", "user_id", "endpoint", "status")
