"""Commit-history analytics: hotspots, contributors, co-change, velocity, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark a bug-fixing commit when they occur anywhere in its message: fixed values.
BUG_KEYWORDS = [
    "fix", "bug", "error", "crash", "issue", "defect",
    "broken", "revert", "hotfix", "patch", "repair",
    "regression", "fail", "failure", "incorrect", "wrong",
]


def bug_message(message: Column, keywords: list[str] | None = None) -> Column:
    return F.lower(message).rlike("|".join(BUG_KEYWORDS if keywords is None else keywords))


def hotspot_score(commits: Column, churn: Column, bugs: Column) -> Column:
    return F.round(F.log1p(commits) * 10 + F.log1p(churn) + bugs * 5, 2)


def week_key(day: Column) -> Column:
    """Calendar year and ISO week, as in 2024-W07."""
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def flagged(commits: DataFrame, keywords: list[str]) -> DataFrame:
    return commits.select("hash", "author", "day", bug_message(F.col("message"), keywords).alias("bug"))


def file_hotspots(commits: DataFrame, changes: DataFrame, keywords: list[str], first: int = 50, top: int = 20) -> DataFrame:
    """Files by score among the files with most commits.

    Churn and counts are summed in one pass; authors are counted distinct.
    """
    stats = (
        changes.join(flagged(commits, keywords), "hash")
        .groupBy("path")
        .agg(
            F.count("*").alias("commit_count"),
            F.sum("additions").alias("additions"),
            F.sum("deletions").alias("deletions"),
            F.countDistinct("author").alias("unique_authors"),
            F.count_if("bug").alias("bug_commits"),
        )
    )
    most = stats.orderBy(F.desc("commit_count"), "path").limit(first)
    churn = F.col("additions") + F.col("deletions")
    return (
        most.withColumn("churn", churn)
        .withColumn("bug_ratio", F.round(F.col("bug_commits") / F.col("commit_count"), 4))
        .withColumn("score", hotspot_score(F.col("commit_count"), churn, F.col("bug_commits")))
        .orderBy(F.desc("score"), "path")
        .limit(top)
    )


def contributor_stats(commits: DataFrame, changes: DataFrame, keywords: list[str]) -> DataFrame:
    """Commits, files, lines and bug fixes of each author."""
    flags = flagged(commits, keywords)
    by_commit = flags.groupBy("author").agg(F.count("*").alias("commits"), F.count_if("bug").alias("bug_commits"))
    by_file = changes.join(flags.select("hash", "author"), "hash").groupBy("author").agg(F.countDistinct("path").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return by_commit.join(by_file, "author", "left").select("author", "commits", zero("files"), zero("additions"), zero("deletions"), "bug_commits", F.round(F.col("bug_commits") / F.col("commits"), 4).alias("bug_ratio"))


def bug_prone_files(commits: DataFrame, changes: DataFrame, keywords: list[str], least: int = 2, top: int = 20) -> DataFrame:
    """Files by bug-fixing commits."""
    stats = changes.join(flagged(commits, keywords), "hash").groupBy("path").agg(F.count("*").alias("commits"), F.count_if("bug").alias("bug_commits"))
    return stats.where(F.col("bug_commits") >= least).withColumn("bug_ratio", F.round(F.col("bug_commits") / F.col("commits"), 4)).orderBy(F.desc("bug_commits"), "path").limit(top)


def co_change_pairs(changes: DataFrame, reach: int = 5, least: int = 2, top: int = 20, tasks: int | None = None) -> DataFrame:
    """Pairs of files that stand at most `reach` places apart in commits, by coupling.

    Partners come from lead() over the commit, one shuffle and no self-join. Most pairs
    occur once, so they are not counted before they are dealt, by `tasks` or as the session has it.
    """
    order = Window.partitionBy("hash").orderBy("position")
    partners = F.array_compact(F.array(*[F.lead("path", i).over(order) for i in range(1, reach + 1)]))
    pairs = changes.select("path", partners.alias("others")).select("path", F.explode("others").alias("other"))
    pairs = pairs.select(F.least("path", "other").alias("file_a"), F.greatest("path", "other").alias("file_b"))
    dealt = pairs.repartition("file_a", "file_b") if tasks is None else pairs.repartition(tasks, "file_a", "file_b")
    counted = dealt.groupBy("file_a", "file_b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    best = counted.orderBy(F.desc("together"), "file_a", "file_b").limit(top)
    commits = changes.groupBy("path").agg(F.count("*").alias("n"))
    joined = best.join(commits.select(F.col("path").alias("file_a"), F.col("n").alias("na")), "file_a").join(commits.select(F.col("path").alias("file_b"), F.col("n").alias("nb")), "file_b")
    return joined.select("file_a", "file_b", "together", F.round(F.col("together") / F.greatest("na", "nb"), 4).alias("coupling")).orderBy(F.desc("coupling"), "file_a", "file_b")


def weekly_velocity(commits: DataFrame, last: int = 52) -> DataFrame:
    """Commits of each of the last weeks."""
    weeks = commits.groupBy(week_key(F.col("day")).alias("week")).agg(F.count("*").alias("commits"))
    return weeks.orderBy(F.desc("week")).limit(last)


def git_summary(commits: DataFrame, changes: DataFrame, keywords: list[str]) -> DataFrame:
    """One row of totals; zero-filled when there is nothing."""
    totals = flagged(commits, keywords).agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.count_if("bug").alias("bug_commits"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    lines = changes.agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"))
    top_file = changes.groupBy("path").count().agg(F.min_by("path", F.struct((-F.col("count")).alias("c"), "path")).alias("most_active_file"))
    top_author = commits.groupBy("author").count().agg(F.min_by("author", F.struct((-F.col("count")).alias("c"), "author")).alias("most_active_author"))
    ratio = F.coalesce(F.round(F.try_divide("bug_commits", "commits"), 4), F.lit(0.0)).alias("bug_ratio")
    one = totals.withColumn("k", F.lit(1))
    for more in (lines, top_file, top_author):  # one row each
        one = one.join(F.broadcast(more.withColumn("k", F.lit(1))), "k")
    return one.select("commits", "authors", "files", "additions", "deletions", "bug_commits", ratio, "most_active_file", "most_active_author", "first_day", "last_day")


def file_history(commits: DataFrame, changes: DataFrame, last: int = 26) -> DataFrame:
    """Weekly churn of each file over its last weeks."""
    weekly = changes.join(commits.select("hash", "author", week_key(F.col("day")).alias("week")), "hash").groupBy("path", "week").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"))
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("week")))
    return weekly.withColumn("r", newest).where(F.col("r") <= last).drop("r")


def file_commits(commits: DataFrame, changes: DataFrame, most: int = 50) -> DataFrame:
    """path, place, hash, author, day, additions, deletions: the first commits of each file, at most `most`; commits is the number of all."""
    rows = changes.join(commits.select("hash", "author", "day"), "hash")
    order = ["day", "hash", "position"]
    place = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    total = changes.join(commits.select("hash"), "hash", "left_semi").groupBy("path").agg(F.count("*").alias("commits"))
    return first.join(total, "path").select("path", "place", "hash", "author", "day", "additions", "deletions", "commits")


def file_authors(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """path, author, commits, place: who changed each file, most first; counted before they are ranked."""
    counts = changes.join(commits.select("hash", "author"), "hash").groupBy("path", "author").agg(F.count("*").alias("commits"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("commits"), "author")))


def blame_ownership(lines: DataFrame, as_of: str, stale_days: int = 365) -> DataFrame:
    """Lines, share, age and staleness by author; a line without a day has age 0."""
    age = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col("day")), F.lit(0))
    stats = lines.select("author", age.alias("age")).groupBy("author").agg(F.count("*").alias("lines"), F.sum("age").alias("ages"), F.count_if(F.col("age") > stale_days).alias("stale_lines"))
    total = stats.agg(F.sum("lines").alias("total"))
    return stats.join(F.broadcast(total)).select("author", "lines", F.round(F.col("lines") * 100 / F.col("total"), 1).alias("percent"), F.round(F.col("ages") / F.col("lines"), 1).alias("avg_age_days"), "stale_lines", F.round(F.col("stale_lines") / F.col("lines"), 4).alias("stale_ratio"))
