"""Structured Streaming forms of the telemetry operators."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kilnspark.operators.expiry import Fold, mail_cap, session, sliding_limit, walk

REQUEST = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_requests(spark: SparkSession, path: str, files_each: int = 16) -> DataFrame:
    """id, ts (TIMESTAMP, as watermarks need), user_id, endpoint, duration_ms, status from parquet files as they arrive."""
    rows = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_each).parquet(path)
    return rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("endpoint"), F.col("value").cast("long").alias("duration_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def tumbling(requests: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Totals by endpoint of each window, out once the watermark passes its end; later rows are dropped."""
    out = requests.withWatermark("ts", late).groupBy(F.window("ts", width), "endpoint").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("duration_ms").alias("total_ms"))
    return out.select(F.col("window.start").alias("bucket"), "endpoint", "requests", "errors", "total_ms")


def idle_sessions(requests: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of each user's requests, closed by a gap."""
    out = requests.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return out.select("user_id", F.col("w.start").alias("first_ts"), "requests")


def latest_progress(requests: DataFrame) -> DataFrame:
    """The newest request of each user so far (update mode)."""
    return requests.groupBy("user_id").agg(F.count("*").alias("updates"), F.max_by(F.struct("id", "endpoint"), F.struct("ts", "id")).alias("last")).select("user_id", "updates", "last.id", "last.endpoint")


def in_order(requests: DataFrame, fold: Fold, late: str = "10 minutes") -> DataFrame:
    """The folds of operators/expiry.py over a stream, in order of event time: user_id, id and what is said of each request, or user_id and a row for each session.

    Requests wait in state until the watermark passes them, so rows that come out of
    order within `late` are decided as a batch over all of them would; later ones are
    dropped. State of a user is what waits, and the fold's own; event-time timers empty it
    when it means nothing any more, and give the rows of sessions. A pause of the stream,
    a replay or a restart changes no decision, as no clock but the rows' own is read.
    """
    closes = fold.closes is not None
    names = ["user_id"] + ([] if closes else ["id"]) + [c.split()[0] for c in fold.columns.split(", ")]

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, kept = ([int(x) for x in held] for held in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for batch in batches:
                times += batch.us.tolist()
                ids += batch["id"].tolist()
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        waiting = sorted(zip(times, ids, strict=True))
        ready = bisect_right(waiting, passed, key=lambda r: r[0])
        for us, i in waiting[:ready]:
            kept, closed, said = walk(fold, kept, us)
            out += [(key[0], *row) for row in closed] if closes else [(key[0], i, *said)]
        waiting = waiting[ready:]
        if kept and fold.ends(kept) <= passed:
            out += [(key[0], *fold.closes(kept))] if closes else []
            kept = []
        if waiting or kept:
            state.update(([t for t, _ in waiting], [i for _, i in waiting], kept))
            moments = [t for t, _ in waiting[:1]] + ([fold.ends(kept)] if kept else [])
            state.setTimeoutTimestamp(max(min(moments), passed) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    rows = requests.withWatermark("ts", late).select("ts", "id", "user_id", F.unix_micros("ts").alias("us"))
    schema = "user_id long, " + ("" if closes else "id long, ") + fold.columns
    return rows.groupBy("user_id").applyInPandasWithState(decide, schema, "times array<long>, ids array<long>, kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limits(requests: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """user_id, id, allowed: a sliding window over accepted requests, by event time."""
    return in_order(requests, sliding_limit(limit, seconds), late)


def mail_caps(requests: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """user_id, id, allowed, remaining of each request taken as a mail to its user."""
    return in_order(requests, mail_cap(limit, seconds), late)


def sessions(requests: DataFrame, seconds: int, touch: bool = True, late: str = "10 minutes") -> DataFrame:
    """user_id, first_us, last_us, requests of each session once it has expired."""
    return in_order(requests, session(seconds, touch), late)


def token_text(chunks: DataFrame, minutes: int = 20, late: str = "10 minutes") -> DataFrame:
    """stream, first_seq, text, repeats: from chunks(stream, seq, token, ts), the text that became whole in a batch, each part once and in order.

    Chunks behind a gap wait in state; one that was said or waits already is a repeat. A
    stream that is silent for so long, by event time, is forgotten with what waits.
    """

    def put(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        following, seqs, tokens = state.get if state.exists else (0, [], [])
        newest = state.getCurrentWatermarkMs()
        waiting, first, repeats, said = dict(zip(map(int, seqs), tokens, strict=True)), int(following), 0, []
        for batch in batches:
            newest = max(newest, int(batch.ms.max()))
            for seq, token in sorted(zip(batch.seq.tolist(), batch.token.tolist(), strict=True), key=lambda r: (r[0], r[1] or "")):
                if seq < first or seq in waiting:
                    repeats += 1
                else:
                    waiting[seq] = token or ""
        following = first
        while following in waiting:
            said.append(waiting.pop(following))
            following += 1
        left = sorted(waiting)
        state.update((following, left, [waiting[s] for s in left]))
        state.setTimeoutTimestamp(newest + minutes * 60_000)
        yield pd.DataFrame({"stream": [key[0]], "first_seq": [first], "text": ["".join(said)], "repeats": [repeats]})

    rows = chunks.withWatermark("ts", late).where("stream is not null and seq >= 0").select("ts", "stream", F.col("seq").cast("long").alias("seq"), "token", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("stream").applyInPandasWithState(put, "stream long, first_seq long, text string, repeats long", "following long, seqs array<long>, tokens array<string>", "append", GroupStateTimeout.EventTimeTimeout)
