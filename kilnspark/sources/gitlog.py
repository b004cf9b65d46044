"""Commits and file changes from the text of `git log --numstat`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A header is hash|email|name|date|subject; a change is additions, deletions and path between tabs.
HEADER, CHANGE = r"^[0-9a-f]{7,40}\|", r"^(\d+|-)\t(\d+|-)\t(.+)$"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """raw: the whole text of each log file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")


def renamed_path(path: Column) -> Column:
    """The new path of a rename, `a/{b => c}/d` or `b => c`."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), "/+", "/")


def parse_commits(logs: DataFrame) -> DataFrame:
    """hash, author_email, author_name, day, message, changes: array of (path, additions, deletions, is_rename).

    A log is cut in front of each header and each commit is parsed by itself; binary
    files have no counts and give 0. Lines that are neither header nor change are left out.
    """
    blocks = logs.select(F.explode(F.split(F.regexp_replace("raw", "\r", ""), r"\n(?=[0-9a-f]{7,40}\|)")).alias("block")).where(F.col("block").rlike(HEADER))
    rows = blocks.select(F.split("block", "\n").alias("lines")).select(F.split(F.element_at("lines", 1), r"\|", 5).alias("h"), F.filter("lines", lambda x: x.rlike(CHANGE)).alias("changes"))
    count = lambda x, i: F.coalesce(F.try_to_number(F.regexp_extract(x, CHANGE, i), F.lit("9999999999")), F.lit(0)).cast("long")
    one = lambda x: F.struct(renamed_path(F.regexp_extract(x, CHANGE, 3)).alias("path"), count(x, 1).alias("additions"), count(x, 2).alias("deletions"), F.contains(x, F.lit(" => ")).alias("is_rename"))
    return rows.select(F.get("h", 0).alias("hash"), F.get("h", 1).alias("author_email"), F.get("h", 2).alias("author_name"), F.try_to_timestamp(F.get("h", 3), F.lit("yyyy-MM-dd HH:mm:ss Z")).alias("day"), F.get("h", 4).alias("message"), F.transform("changes", one).alias("changes"))


def file_changes(commits: DataFrame) -> DataFrame:
    """hash, path, additions, deletions, position."""
    return commits.select("hash", F.posexplode("changes").alias("at", "c")).select("hash", "c.path", "c.additions", "c.deletions", (F.col("at") + 1).alias("position"))


#: Names under which callers send a commit's fields, the first that is not empty counts: fixed values.
ALIASES = {"hash": ["hash", "sha"], "author_email": ["author_email", "email"], "author_name": ["author_name", "author"], "date": ["date", "timestamp"], "message": ["message", "subject"]}


def from_aliases(rows: DataFrame) -> DataFrame:
    """Commits given under any of the names of ALIASES, as strings under the first of them, empty where none is there."""
    have = lambda names: [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
    return rows.select(*[F.coalesce(*have(names), F.lit("")).alias(to) for to, names in ALIASES.items()])
