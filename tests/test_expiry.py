from __future__ import annotations

import random
import tempfile
from datetime import datetime, timedelta

import pytest

from kilnspark.operators import expiry
from kilnspark.streaming import requests as stream

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows_of(seconds):
    """(user, seconds) in the order in which they arrive."""
    return [(i, START + timedelta(seconds=s), u, "view", 1.0, None) for i, (u, s) in enumerate(seconds)]


def arrivals():
    """Requests of three users, up to five minutes out of order, one user busy, a pause of two hours, and one that closes all."""
    rng = random.Random(4)
    at = sorted([(s, u) for u, n in ((1, 120), (2, 25), (3, 6)) for s in [rng.randrange(0, 7200) if rng.random() < 0.7 else rng.randrange(14400, 18000) for _ in range(n)]])
    late = sorted(at, key=lambda r: r[0] + rng.randrange(0, 300))
    return rows_of([(u, s) for s, u in late])


def requests(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("event_id AS id", "ts", "user_id", "event_type AS endpoint")


def streamed(spark, query, rows, runs):
    """The rows that a stream says, in several runs over one checkpoint, files of 20 rows each, after a row that moves the watermark past all."""
    where, out = tempfile.mkdtemp(prefix="spark-stream-"), []
    rows = rows + [(10**6, START + timedelta(days=300), 99, "view", 1.0, None), (10**6 + 1, START + timedelta(days=600), 99, "view", 1.0, None)]
    files = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    step = -(-len(files) // runs)
    for run in range(runs):
        for part in files[run * step : (run + 1) * step]:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in")
        df = query(stream.read_requests(spark, f"{where}/in", 1))
        # each run is a new query that starts from the checkpoint
        q = df.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    found = spark.read.parquet(f"{where}/out").where("user_id <> 99")
    return sorted(tuple(r) for r in found.select(*sorted(found.columns)).collect())


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["rate", "mail", "touched", "fixed"])
def test_streams_decide_as_batches_over_pauses_restarts_and_late_rows(spark, name):
    rows = arrivals()
    keyed = expiry.keyed_requests(requests(spark, rows))
    fold, query = {
        "rate": (expiry.sliding_limit(4, 600), lambda df: stream.rate_limits(df, 4, 600)),
        "mail": (expiry.mail_cap(3, 900), lambda df: stream.mail_caps(df, 3, 900)),
        "touched": (expiry.session(300), lambda df: stream.sessions(df, 300)),
        "fixed": (expiry.session(300, False), lambda df: stream.sessions(df, 300, False)),
    }[name]
    want = sorted_rows(expiry.in_order(keyed, fold).withColumnRenamed("key", "user_id"))
    assert streamed(spark, query, rows, 3) == want


def test_rows_later_than_the_watermark_are_dropped(spark):
    rows = rows_of([(1, 0)] * 1 + [(2, 5000)] * 19 + [(2, 9000)] * 20 + [(1, 10)] * 20)
    got = streamed(spark, lambda df: stream.rate_limits(df, 1, 60), rows, 1)
    assert [g for g in got if g[2] == 1] == [(True, 0, 1)]


def plain_misses(times, ttl):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1] + ttl:
            out.append(t)
    return out


def test_cache_misses_by_pointers(spark):
    rng = random.Random(5)
    sets = {"busy": [rng.randrange(0, 5000) for _ in range(700)], "rare": [i * 977 for i in range(20)], "one": [7], "same": [3] * 5, "edge": [0, 10, 20, 29, 30, 40, 60], "old": [-5, -1, 0, 4, 9, 15, 16]}
    points = spark.createDataFrame([("k", key, 10, t) for key, times in sets.items() for t in times], "kind string, key string, ttl long, us long")
    got = {}
    for r in expiry.misses(points).collect():
        got.setdefault(r.key, []).append(r.us)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_misses(v, 10) for k, v in sets.items()}


def test_no_requests_and_null_keys(spark):
    empty = requests(spark, rows_of([(1, 1)])).where("false")
    assert expiry.cache_replay(empty).collect() == expiry.mail_caps(empty).collect() == expiry.sessions(empty).collect() == []
    some = requests(spark, [(1, START, None, None, 1.0, None), (2, START, None, "view", 1.0, None), (3, START, 5, "view", 1.0, None)])
    assert sorted((r.kind, r.requests, r.misses) for r in expiry.cache_replay(some).collect()) == [("answer", 2, 1), ("list", 2, 1), ("stats", 2, 1)]
    assert sorted((str(r.user_id), r.remaining) for r in expiry.mail_caps(some, 3).collect()) == [("5", 2), ("None", 1), ("None", 2)]


def test_mail_counter_lives_on_with_each_mail(spark):
    """Ten an hour, but the hour starts again with each mail: one at minute 50 keeps the count until minute 110."""
    rows = rows_of([(1, 0), (1, 3000), (1, 5400), (1, 6000), (1, 9700)])
    got = [r.allowed for r in sorted(expiry.mail_caps(requests(spark, rows), 2, 3600).collect(), key=lambda r: r.id)]
    assert got == [True, True, False, False, True]


def test_cache_misses_take_fewer_rows_at_each_level(spark, monkeypatch):
    """A busy key over many spans, one with long gaps and one with a single time: each level holds about half the pointers of the one before."""
    held, write = [], expiry.materialize
    monkeypatch.setattr(expiry, "materialize", lambda df, name: (out := write(df, name), name in ("jump", "jumps") and held.append(out.count()))[0])
    rng = random.Random(8)
    sets = {"busy": {rng.randrange(1000) for _ in range(600)}, "gaps": {rng.randrange(20) * 900 + rng.randrange(30) for _ in range(80)}, "one": {5}}
    points = spark.createDataFrame([("k", k, 10, t) for k, v in sets.items() for t in v], "kind string, key string, ttl long, us long")
    got: dict[str, list[int]] = {}
    for r in expiry.misses(points).collect():
        got.setdefault(r.key, []).append(r.us)
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_misses(v, 10) for k, v in sets.items()}
    assert sum(held) < 3 * sum(map(len, sets.values())), held
