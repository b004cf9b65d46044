"""Queries over commit history: orders stand in for commits, lineitem for file changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import history as h
from kilnspark.sources import corpus as c
from kilnspark.sources import gitlog

URGENT = ["1-urgent", "2-high"]

def _log(spark, sf_dir):
    """Log texts of 64 commits each at most: an order is a commit, its lines are changes, every fifth a rename, some of binary files."""
    li, orders = c.load(spark, sf_dir, "lineitem"), c.load(spark, sf_dir, "orders")
    count = lambda x: F.when(F.col("l_suppkey") % 17 == 0, "-").otherwise(x.cast("long").cast("string"))
    path = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("src/{old => new}/p"), F.col("l_partkey"), F.lit(".py"))).otherwise(F.concat(F.lit("src/p"), F.col("l_partkey"), F.lit(".py")))
    change = F.concat_ws("\t", count(F.col("l_quantity")), count(F.col("l_linenumber")), path)
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", change.alias("line"))
    changes = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").alias("changes"))
    head = F.concat_ws("|", F.lpad(F.lower(F.hex("o_orderkey")), 8, "0"), F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@x")), F.concat(F.lit("Customer "), F.col("o_custkey")), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")), F.concat(F.col("o_orderpriority"), F.lit("|fix")))
    commits = orders.join(changes, "o_orderkey", "left").select(F.expr("o_orderkey div 64").alias("log"), "o_orderkey", F.concat_ws("\n", head, "changes", F.lit("")).alias("block"))
    blocks = F.array_sort(F.collect_list(F.struct("o_orderkey", "block")))
    return commits.groupBy("log").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("raw")).select("raw")


QUERIES = {
    "git_log_changes": lambda s, d: gitlog.parse_commits(_log(s, d)).select("hash", "author_email", "message", F.posexplode("changes").alias("at", "x")).select("hash", "author_email", "message", "at", "x.path", "x.additions", "x.deletions", "x.is_rename"),
    "git_log_commits": lambda s, d: gitlog.parse_commits(_log(s, d)).select("hash", "author_name", F.unix_micros("day").alias("us"), F.size("changes").alias("files")),
    "file_hotspots": lambda s, d: h.file_hotspots(c.commits(s, d), c.plain_changes(s, d), URGENT),
    "contributor_stats": lambda s, d: h.contributor_stats(c.commits(s, d), c.plain_changes(s, d), URGENT),
    "bug_prone_files": lambda s, d: h.bug_prone_files(c.commits(s, d), c.plain_changes(s, d), URGENT),
    "co_change_pairs": lambda s, d: h.co_change_pairs(c.changes(s, d), tasks=c.change_tasks(s, d)),
    "weekly_velocity": lambda s, d: h.weekly_velocity(c.commits(s, d)),
    "git_summary": lambda s, d: h.git_summary(c.commits(s, d), c.plain_changes(s, d), URGENT),
    "file_history": lambda s, d: h.file_history(c.commits(s, d), c.plain_changes(s, d)),
    "file_commits": lambda s, d: h.file_commits(c.commits(s, d), c.changes(s, d)),
    "file_authors": lambda s, d: h.file_authors(c.commits(s, d), c.plain_changes(s, d)),
    "blame_ownership": lambda s, d: h.blame_ownership(c.blame_lines(s, d), "2002-01-01"),
}

_COMMITS = "c AS (SELECT o_orderkey AS hash, o_custkey AS author, o_orderdate AS day, o_orderpriority IN ('1-URGENT', '2-HIGH') AS bug, strftime(o_orderdate, '%Y-W%V') AS week FROM orders)"
_CHANGES = "f AS (SELECT l_orderkey AS hash, l_partkey AS path, l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions FROM lineitem)"
_BOTH = f"WITH {_COMMITS}, {_CHANGES}"

ORACLE = {
    "git_log_changes": """SELECT lpad(lower(to_hex(l_orderkey)), 8, '0') AS hash, 'c' || o_custkey || '@x' AS author_email, o_orderpriority || '|fix' AS message, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS at,
  'src/' || CASE WHEN l_partkey % 5 = 0 THEN 'new/' ELSE '' END || 'p' || l_partkey || '.py' AS path, CASE WHEN l_suppkey % 17 = 0 THEN 0 ELSE l_quantity::BIGINT END AS additions, CASE WHEN l_suppkey % 17 = 0 THEN 0 ELSE l_linenumber END AS deletions, l_partkey % 5 = 0 AS is_rename
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "git_log_commits": """SELECT lpad(lower(to_hex(o_orderkey)), 8, '0') AS hash, 'Customer ' || o_custkey AS author_name, epoch_us(date_trunc('second', o_orderdate)) AS us, count(l_orderkey)::INT AS files FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate""",
    "file_hotspots": f"""{_BOTH}, s AS (
  SELECT path, count(*) AS commit_count, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(DISTINCT author) AS unique_authors, count(*) FILTER (WHERE bug) AS bug_commits
  FROM f JOIN c USING (hash) GROUP BY path ORDER BY commit_count DESC, path LIMIT 50)
SELECT *, additions + deletions AS churn, round(bug_commits / commit_count, 4) AS bug_ratio,
  round(ln(1 + commit_count) * 10 + ln(1 + additions + deletions) + bug_commits * 5, 2) AS score
FROM s ORDER BY score DESC, path LIMIT 20""",
    "contributor_stats": f"""{_BOTH}, a AS (SELECT author, count(*) AS commits, count(*) FILTER (WHERE bug) AS bug_commits FROM c GROUP BY author),
b AS (SELECT author, count(DISTINCT path) AS files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM f JOIN c USING (hash) GROUP BY author)
SELECT author, commits, coalesce(files, 0) AS files, coalesce(additions, 0)::BIGINT AS additions, coalesce(deletions, 0)::BIGINT AS deletions, bug_commits, round(bug_commits / commits, 4) AS bug_ratio
FROM a LEFT JOIN b USING (author)""",
    "bug_prone_files": f"""{_BOTH}, s AS (SELECT path, count(*) AS commits, count(*) FILTER (WHERE bug) AS bug_commits FROM f JOIN c USING (hash) GROUP BY path)
SELECT *, round(bug_commits / commits, 4) AS bug_ratio FROM s WHERE bug_commits >= 2 ORDER BY bug_commits DESC, path LIMIT 20""",
    "co_change_pairs": """WITH f AS (
  SELECT l_orderkey AS hash, l_partkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem
), p AS (
  SELECT least(a.path, b.path) AS file_a, greatest(a.path, b.path) AS file_b, count(*) AS together
  FROM f a JOIN f b ON a.hash = b.hash AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 GROUP BY 1, 2
  HAVING count(*) >= 2 ORDER BY together DESC, file_a, file_b LIMIT 20
), n AS (SELECT path, count(*) AS n FROM f GROUP BY path)
SELECT file_a, file_b, together, round(together / greatest(x.n, y.n), 4) AS coupling FROM p JOIN n x ON x.path = file_a JOIN n y ON y.path = file_b""",
    "weekly_velocity": "SELECT strftime(o_orderdate, '%Y-W%V') AS week, count(*) AS commits FROM orders GROUP BY 1 ORDER BY week DESC LIMIT 52",
    "git_summary": f"""{_BOTH}
SELECT (SELECT count(*) FROM c) AS commits, (SELECT count(DISTINCT author) FROM c) AS authors, (SELECT count(DISTINCT path) FROM f) AS files,
  (SELECT sum(additions)::BIGINT FROM f) AS additions, (SELECT sum(deletions)::BIGINT FROM f) AS deletions,
  (SELECT count(*) FROM c WHERE bug) AS bug_commits, (SELECT round(count(*) FILTER (WHERE bug) / count(*), 4) FROM c) AS bug_ratio,
  (SELECT path FROM f GROUP BY path ORDER BY count(*) DESC, path LIMIT 1) AS most_active_file,
  (SELECT author FROM c GROUP BY author ORDER BY count(*) DESC, author LIMIT 1) AS most_active_author,
  (SELECT min(day) FROM c) AS first_day, (SELECT max(day) FROM c) AS last_day""",
    "file_history": f"""{_BOTH}, w AS (SELECT path, week, count(*) AS commits, count(DISTINCT author) AS authors, sum(additions + deletions)::BIGINT AS churn FROM f JOIN c USING (hash) GROUP BY path, week)
SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY path ORDER BY week DESC) <= 26""",
    "file_commits": """SELECT l_partkey AS path, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, pos)::INT AS place, l_orderkey AS hash, o_custkey AS author, o_orderdate AS day, l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions, count(*) OVER (PARTITION BY l_partkey) AS commits
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem) JOIN orders ON o_orderkey = l_orderkey QUALIFY place <= 50""",
    "file_authors": """WITH k AS (SELECT l_partkey AS path, o_custkey AS author, count(*) AS commits FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY path ORDER BY commits DESC, author)::INT AS place FROM k""",
    "blame_ownership": """WITH a AS (SELECT l_suppkey AS author, coalesce(date_diff('day', l_shipdate::DATE, DATE '2002-01-01'), 0) AS age FROM lineitem)
SELECT author, count(*) AS lines, round(count(*) * 100 / (SELECT count(*) FROM a), 1) AS percent, round(sum(age) / count(*), 1) AS avg_age_days,
  count(*) FILTER (WHERE age > 365) AS stale_lines, round(count(*) FILTER (WHERE age > 365) / count(*), 4) AS stale_ratio
FROM a GROUP BY author""",
}
