"""Totals and derived figures of indexing, parsing, runs, connections, findings and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def indexing_stats(tasks: DataFrame, now: str) -> DataFrame:
    """task, success_pct, files_per_second, eta_s of tasks(task, total, indexed, failed, started); no rate before anything is done, no estimate once nothing is left."""
    done = F.col("indexed") + F.col("failed")
    elapsed = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(F.col("started").cast("timestamp")) / 1e6
    rate = F.when((done > 0) & (elapsed > 0), F.round(done / elapsed, 2)).otherwise(0.0)
    rows = tasks.select("task", F.round(F.col("indexed") / F.greatest(done, F.lit(1)) * 100, 1).alias("success_pct"), rate.alias("files_per_second"), (F.col("total") - done).alias("left"))
    return rows.select("task", "success_pct", "files_per_second", F.when((F.col("files_per_second") > 0) & (F.col("left") > 0), F.round(F.col("left") / F.col("files_per_second"), 0)).alias("eta_s"))


def indexing_totals(results: DataFrame) -> DataFrame:
    """Files of each task by status, their chunks, and FAILED only where all have failed."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = results.groupBy("task").agg(F.count("*").alias("files"), of("indexed"), of("skipped"), of("failed"), F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("chunks"))), F.lit(0)).alias("chunks"))
    return rows.withColumn("status", F.when(F.col("failed") == F.col("files"), "FAILED").otherwise("COMPLETED"))


def parse_summary(files: DataFrame) -> DataFrame:
    """Of each project: files, parsed and their share, chunks a file, and the method used most (the first by name of equals)."""
    by = files.groupBy("project", "method").agg(F.count("*").alias("n"), F.count_if("parsed").alias("parsed"), F.sum("chunks").alias("chunks"))
    return by.groupBy("project").agg(F.sum("n").alias("files"), F.sum("parsed").alias("parsed"), F.round(F.sum("parsed") * 100 / F.sum("n"), 1).alias("percent"), F.round(F.sum("chunks") / F.sum("n"), 2).alias("chunks_per_file"), F.min_by("method", F.struct((-F.col("n")).alias("o"), "method")).alias("main_method"))


def run_outcomes(runs: DataFrame) -> DataFrame:
    """Succeeded and failed runs of each group."""
    return runs.groupBy("group").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def connection_counts(connections: DataFrame) -> DataFrame:
    """Connections by channel, by user, and in all; what is summed over is "all"."""
    named = connections.select("channel", F.col("user_id").cast("string").alias("user"))
    rows = named.groupingSets([["channel"], ["user"], []], "channel", "user").agg(F.count("*").alias("connections"), F.countDistinct("user").alias("users"))
    return rows.select(F.coalesce("channel", F.lit("all")).alias("channel"), F.coalesce("user", F.lit("all")).alias("user"), "connections", "users")


def dashboard_totals(projects: DataFrame) -> DataFrame:
    """One row: projects, their files, those indexed, and different languages."""
    return projects.agg(F.count("*").alias("projects"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count_if("indexed").alias("indexed"), F.countDistinct("language").alias("languages"))


def tokens_per_second(streams: DataFrame) -> DataFrame:
    """Tokens of each stream over its seconds; 0 where no time has passed."""
    return streams.select("stream", F.coalesce(F.round(F.try_divide("tokens", "seconds"), 2), F.lit(0.0)).alias("tokens_per_second"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), severity), F.lit(len(SEVERITY_ORDER) + 1))


def ranked_findings(findings: DataFrame, most: int = 5) -> DataFrame:
    """The first findings of each file by severity, then line, then rule, with their place."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(severity_rank(F.col("severity")), "line_number", "rule"))
    return findings.withColumn("place", place).where(F.col("place") <= most)


def top_nodes(degrees: DataFrame, most: int = 10) -> DataFrame:
    """The nodes that most others depend on."""
    return degrees.orderBy(F.desc("in_degree"), "node").limit(most)


def history_summary(messages: DataFrame, width: int = 100, keep: int = 2) -> DataFrame:
    """For sessions of more than four messages: the first lines of the user's messages but the last two of all, numbered, and those last two."""
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("role"), F.desc("content")))
    rows = messages.withColumn("r", newest).withColumn("topic", F.substring(F.element_at(F.split("content", "\n"), 1), 1, width))
    ordered = lambda when, text: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct((-F.col("r")).alias("o"), text.alias("x"))))), lambda s: s["x"])
    told = rows.groupBy("session").agg(F.count("*").alias("messages"), ordered((F.col("r") > keep) & (F.col("role") == "user"), F.col("topic")).alias("topics"), ordered(F.col("r") <= keep, F.concat("role", F.lit(": "), "content")).alias("last"))
    numbered = F.transform("topics", lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t, F.lit("\n")))
    text = F.concat(F.lit("Previous topics discussed:\n"), F.array_join(numbered, ""), F.lit("\nMost recent exchange:\n"), F.array_join("last", "\n"))
    return told.where("messages > 4").select("session", "messages", text.alias("summary"))


#: Fields of a section of a written report and the pattern of each: fixed values.
REPORT_FIELDS = {
    "title": r"(?is)\*\*Title\*\*:\s*(.+?)(?=\n-|\n###|$)",
    "severity": r"(?is)\*\*Severity\*\*:\s*(critical|high|medium|low)",
    "category": r"(?is)\*\*Category\*\*:\s*(.+?)(?=\n-|\n###|$)",
    "description": r"(?is)\*\*Description\*\*:\s*(.+?)(?=\n-\s*\*\*|\n###|$)",
    "suggested_fix": r"(?is)\*\*Fix\*\*:\s*(.+?)(?=\n###|$)",
    "file": r"(?is)\*\*File\*\*:\s*(.+?)(?=\n-|\n###|$)",
}


def report_bugs(reports: DataFrame) -> DataFrame:
    """report, bug, title, severity, category, description, suggested_fix, file_path, line of each numbered section that has a title or a description.

    A section without a severity is medium; what follows the last colon of the file is
    its line, 0 if it holds no digit.
    """
    sections = F.slice(F.split(F.coalesce("content", F.lit("")), r"(?i)###\s*BUG-\d+"), 2, 1 << 20)
    rows = reports.select("report", F.posexplode(sections).alias("at", "s"))
    rows = rows.select("report", (F.col("at") + 1).alias("bug"), *[F.trim(F.regexp_extract("s", p, 1), F.lit(" \n\t\r")).alias(n) for n, p in REPORT_FIELDS.items()])
    rows = rows.where("title <> '' or description <> ''")
    has_line = F.contains("file", F.lit(":"))
    digits = F.regexp_replace(F.regexp_extract("file", r"(?s):([^:]*)$", 1), r"[^0-9]", "")
    path = F.when(has_line, F.trim(F.regexp_extract("file", r"(?s)^(.*):[^:]*$", 1))).otherwise(F.col("file"))
    return rows.select("report", "bug", "title", F.coalesce(F.nullif(F.lower("severity"), F.lit("")), F.lit("medium")).alias("severity"), "category", "description", "suggested_fix", path.alias("file_path"), F.coalesce(F.when(has_line, digits.try_cast("long")), F.lit(0)).alias("line"))


def report_summary(bugs: DataFrame) -> DataFrame:
    """Bugs of each report by severity, and a sentence that says so."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    rows = bugs.groupBy("report").agg(F.count("*").alias("bugs"), *counts)
    parts = F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in ("critical", "high", "medium", "low")]))
    return rows.withColumn("summary", F.concat(F.lit("Found "), F.col("bugs").cast("string"), F.lit(" bug(s): "), F.array_join(parts, ", "), F.lit(".")))
