"""Tasks as logs of wanted states: what each entry makes of its task, and what a task was at a given time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States and those that may follow each; a task begins at the first.
NEXT = {
    "PENDING": ["RUNNING", "FAILED", "CANCELLED"],
    "RUNNING": ["RUNNING", "COMPLETED", "FAILED", "CANCELLED"],
    "COMPLETED": [],
    "FAILED": ["PENDING"],
    "CANCELLED": [],
}
COLUMNS = "status string, fault string, progress double, started_us long, ended_us long"


def apply(state: tuple | None, wanted: str, us: int, progress: float | None) -> tuple:
    """State (status, fault, progress, start, end) after an entry. A bad one is named and changes nothing else."""
    if state is None:
        return ("PENDING", None if wanted == "PENDING" else f"NEW>{wanted}", 0.0, None, None)
    status, _, done, start, end = state
    if wanted not in NEXT[status]:
        return (status, f"{status}>{wanted}", done, start, end)
    if wanted == "PENDING":  # tried again
        return (wanted, None, 0.0, None, None)
    if wanted == "RUNNING":
        return (wanted, None, max(done, progress or 0.0), us if start is None else start, None)
    return (wanted, None, 1.0 if wanted == "COMPLETED" else done, start, us)


def lifecycles(log: DataFrame) -> DataFrame:
    """task, seq, us, status, fault, progress, started_us, ended_us after each entry of log(task, seq, us, wanted, progress).

    A task's entries are applied by time, then seq. The first entry makes the task, whatever
    it wants. Progress never falls while a task runs; it is 1 once completed. Keys come
    sorted and dealt to tasks of Spark, so a long log is read, not held.
    """
    names = ["task", "seq", "us"] + [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = state = None
        for batch in batches:
            out = []
            progress = batch.progress.astype(object).where(batch.progress.notna(), None)
            for t, seq, us, wanted, part in zip(batch.task, batch.seq, batch.us, batch.wanted, progress, strict=True):
                state = apply(state if t == task else None, wanted, us, part)
                task = t
                out.append((t, seq, us, *state))
            yield pd.DataFrame(out, columns=names).astype({"started_us": "Int64", "ended_us": "Int64"})

    kind = {f.name: f.dataType.simpleString() for f in log.schema}
    rows = log.select("task", "seq", "us", "wanted", "progress").where("task is not null").repartition("task").sortWithinPartitions("task", "us", "seq")
    return rows.mapInPandas(run, f"task {kind['task']}, seq {kind['seq']}, us long, {COLUMNS}")


def as_of(questions: DataFrame, states: DataFrame) -> DataFrame:
    """question, task, us, status, progress: what a task was at the time of each question; UNKNOWN and 0 before its first entry.

    One sort by task and time of both together; of entries at a time the last counts, also for a question at that time.
    """
    held = F.struct("status", "progress")
    rows = states.select("task", "us", F.lit(0).alias("asks"), "seq", held.alias("held"), F.lit(None).cast(questions.schema["question"].dataType).alias("question"))
    asked = questions.select("task", "us", F.lit(1).alias("asks"), F.lit(None).cast(states.schema["seq"].dataType).alias("seq"), F.lit(None).cast("struct<status:string,progress:double>").alias("held"), "question")
    before = Window.partitionBy("task").orderBy("us", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.union(asked).withColumn("last", F.last("held", ignorenulls=True).over(before)).where("asks = 1")
    return out.select("question", "task", "us", F.coalesce("last.status", F.lit("UNKNOWN")).alias("status"), F.coalesce("last.progress", F.lit(0.0)).alias("progress"))
