"""Keyed state that expires: caches that are filled on a miss, sessions, mail caps and rate windows.

The rules are small folds over one key's times in order (`Fold`); batches run them over
sorted rows, streams over state (`streaming/requests.py`). A cache needs no fold: its
misses are found by pointers from each time to the first one after expiry, so that a
busy key is cut into spans of one lifetime.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.tables import materialize

SECOND = 1_000_000
#: Lifetimes of cached answers, lists and statistics in seconds; mails that a user may get in an hour: fixed values.
CACHE_SECONDS = {"answer": 3600, "list": 300, "stats": 120}
MAILS, MAIL_SECONDS = 10, 3600
SESSION_SECONDS = 7 * 86_400


@dataclass(frozen=True)
class Fold:
    """One key's state as a list of numbers, moved by each time (microseconds) in order.

    step(kept, us) gives the new state and what is said of the time; ends(kept) the moment
    from which the state means nothing, and closes(kept) the row that its end gives, if any.
    """

    columns: str
    step: Callable[[list[int], int], tuple[list[int], tuple]]
    ends: Callable[[list[int]], int]
    closes: Callable[[list[int]], tuple] | None = None


def sliding_limit(limit: int, seconds: int) -> Fold:
    """Whether a request is accepted: fewer than `limit` accepted ones in the trailing window. State: their times."""
    width = seconds * SECOND

    def step(kept: list[int], us: int) -> tuple[list[int], tuple]:
        recent = [t for t in kept if t > us - width]
        allowed = len(recent) < limit
        return recent + [us] * allowed, (allowed,)

    return Fold("allowed boolean", step, lambda kept: (kept[-1] if kept else 0) + width)


def mail_cap(limit: int = MAILS, seconds: int = MAIL_SECONDS) -> Fold:
    """Whether a mail is sent: a counter that each sent mail raises and keeps for the whole time again. State: count, last sent."""
    width = seconds * SECOND

    def step(kept: list[int], us: int) -> tuple[list[int], tuple]:
        count, last = kept if kept and us < kept[1] + width else (0, us)
        allowed = count < limit
        now = [count + 1, us] if allowed else [count, last]
        return now, (allowed, limit - now[0])

    return Fold("allowed boolean, remaining int", step, lambda kept: kept[1] + width)


def session(seconds: int = SESSION_SECONDS, touch: bool = True) -> Fold:
    """Sessions that end a lifetime after they began, or, touched, after the last request. State: first, last, requests.

    Nothing is said of a request; a session's row comes when it ends.
    """
    width = seconds * SECOND

    def step(kept: list[int], us: int) -> tuple[list[int], tuple]:
        return ([kept[0], us, kept[2] + 1] if kept else [us, us, 1]), ()

    return Fold("first_us long, last_us long, requests long", step, lambda kept: kept[1 if touch else 0] + width, tuple)


def walk(fold: Fold, kept: list[int], us: int) -> tuple[list[int], list[tuple], tuple]:
    """State after a time, rows of sessions that ended before it, and what is said of the time."""
    closed = []
    if kept and us >= fold.ends(kept):
        closed = [fold.closes(kept)] if fold.closes else []
        kept = []
    kept, said = fold.step(kept, us)
    return kept, closed, said


def in_order(rows: DataFrame, fold: Fold) -> DataFrame:
    """rows(key, id, us) folded key by key: key, id and what is said of each time; or key and a row for each session.

    Keys are dealt to tasks and come sorted, so a task holds one key's state and a batch
    of rows. A key's times are one task, as the rules are sequential in them; null keys
    are one key.
    """
    closes = fold.closes is not None
    names = ["key"] + ([] if closes else ["id"]) + [c.split()[0] for c in fold.columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept, started = None, [], False
        for batch in batches:
            out = []
            batch_keys = batch.key.astype(object).where(batch.key.notna(), None)
            for k, i, us in zip(batch_keys, batch["id"], batch.us, strict=True):
                if not started or k != key:
                    if closes and kept:
                        out.append((key, *fold.closes(kept)))
                    key, kept, started = k, [], True
                kept, closed, said = walk(fold, kept, us)
                out += [(key, *row) for row in closed] if closes else [(key, i, *said)]
            yield pd.DataFrame(out, columns=names)
        if closes and kept:
            yield pd.DataFrame([(key, *fold.closes(kept))], columns=names)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = f"key {kind['key']}, " + ("" if closes else f"id {kind['id']}, ")
    return rows.select("key", "id", "us").repartition("key").sortWithinPartitions("key", "us", "id").mapInPandas(run, head + fold.columns)


def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def keyed_requests(requests: DataFrame) -> DataFrame:
    return requests.select(F.col("user_id").alias("key"), "id", micros().alias("us"))


def mail_caps(requests: DataFrame, limit: int = MAILS, seconds: int = MAIL_SECONDS) -> DataFrame:
    """id, user_id, allowed, remaining of each mail, for each request a mail to its user."""
    return in_order(keyed_requests(requests), mail_cap(limit, seconds)).withColumnRenamed("key", "user_id")


def sessions(requests: DataFrame, seconds: int = SESSION_SECONDS, touch: bool = True) -> DataFrame:
    """user_id, first_ts, last_ts, requests of each session that expires `seconds` after its start, or after its last request."""
    out = in_order(keyed_requests(requests), session(seconds, touch))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select(F.col("key").alias("user_id"), at("first_us").alias("first_ts"), at("last_us").alias("last_ts"), "requests")


#: Levels of blocks that one job goes down.
LEVELS_A_JOB = 4


def misses(points: DataFrame) -> DataFrame:
    """kind, key, us of the times that fill a cache, from points(kind, key, ttl, us), ttl in microseconds and one for each kind.

    A time is a miss if it is its key's first or the first at or after the end of the
    entry that the miss before it made. Every time points to the first one a lifetime
    later: it lies in the next span of one lifetime, or else opens the next span that has
    times, so a key is looked at span by span. Spans are then put together by two and by
    two: of a block only the times that one before it leads to are kept, each with where it
    leads beyond the block, so that each level has half the rows of the one before. From
    the first time of all, the first miss of each half is found on the way back down.
    """
    key = ["kind", "key"]
    points = materialize(points.select(*key, "ttl", "us", F.expr("(us - pmod(us, ttl)) div ttl").alias("span")).distinct(), "points")
    event = points.select(*key, "span", F.col("us").alias("t"), F.col("us").alias("event"), F.lit(None).cast("long").alias("own"))
    probe = points.select(*key, (F.col("span") + 1).alias("span"), (F.col("us") + F.col("ttl")).alias("t"), F.lit(None).cast("long"), F.col("us"))
    # from the last time back: a frame that ends at the last row would be gone through anew for each row
    after = Window.partitionBy(*key, "span").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    near = event.union(probe).withColumn("near", F.min("event").over(after)).where("own is not null").select(*key, (F.col("span") - 1).alias("span"), F.col("own").alias("us"), "near")
    by_span = Window.partitionBy(*key).orderBy("span")
    spans = points.groupBy(*key, "span").agg(F.min("us").alias("first"))
    beside = F.lead("span").over(by_span) == F.col("span") + 1
    far = F.when(beside, F.struct(F.lead("first", 2).over(by_span).alias("us"), F.lit(2).alias("on"))).otherwise(F.struct(F.lead("first").over(by_span).alias("us"), F.lit(1).alias("on")))
    # a key's spans that have times are numbered from 0; a block of a level is so many of these
    spans = materialize(spans.select(*key, "span", "first", far.alias("far"), (F.row_number().over(by_span).cast("long") - 1).alias("at")), "spans")
    first, longest = spans.where("at = 0").select(*key, F.col("first").alias("us")), spans.agg(F.max("at")).first()[0] or 0
    to = F.when(F.col("near").isNotNull(), F.struct(F.col("near").alias("us"), F.lit(1).alias("on"))).otherwise(F.col("far"))
    pointers = near.join(spans, [*key, "span"]).select(*key, "us", "at", to.alias("to")).where("to.us is not null")
    jumps = [materialize(pointers.select(*key, "us", "at", F.col("to.us").alias("next"), (F.col("at") + F.col("to.on")).alias("next_at")), "jumps")]
    while longest >> len(jumps) > 0:
        low, over = jumps[-1], F.shiftright("next_at", len(jumps)) > F.shiftright("at", len(jumps))
        led = low.where(over).select(*key, F.col("next").alias("us")).union(first).distinct()
        kept = low.join(led, [*key, "us"], "left_semi")
        beyond = low.select(*key, F.col("us").alias("next"), F.col("next").alias("beyond"), F.col("next_at").alias("beyond_at"))
        on = kept.where(~over).join(beyond, [*key, "next"]).select(*key, "us", "at", F.col("beyond").alias("next"), F.col("beyond_at").alias("next_at"))
        jumps.append(materialize(kept.where(over).select(*on.columns).union(on), "jumps"))
    found = first
    for at, jump in enumerate(reversed(jumps)):
        found = found.union(found.join(jump, [*key, "us"]).select(*key, F.col("next").alias("us"))).distinct()
        if at % LEVELS_A_JOB == LEVELS_A_JOB - 1:
            found = materialize(found, "found")
    return found


def cache_replay(requests: DataFrame, seconds: dict[str, int] = CACHE_SECONDS) -> DataFrame:
    """kind, endpoint, requests, hits, misses, hit_rate of a cache for each kind of entry, filled on a miss and not refreshed by a hit.

    Several requests of one microsecond are one miss at most. Requests without an endpoint or time are left out.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s * SECOND).cast("long").alias("ttl")) for k, s in seconds.items()]))
    points = requests.select(F.col("endpoint").alias("key"), micros().alias("us"), kinds.alias("k")).select("k.*", "key", "us").where("key is not null and us is not null")
    total = points.groupBy("kind", "key").agg(F.count("*").alias("requests"))
    rows = total.join(misses(points).groupBy("kind", "key").agg(F.count("*").alias("misses")), ["kind", "key"])
    hits = F.col("requests") - F.col("misses")
    return rows.select("kind", F.col("key").alias("endpoint"), "requests", hits.alias("hits"), "misses", F.round(hits * 100 / F.col("requests"), 2).alias("hit_rate"))
