"""Queries that decide what is taken in and sum up what was done, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kilnspark.operators import checks, chunks, graph, similarity, summaries
from kilnspark.sources import corpus as c

from .code import _NORMAL, _SETS
from .paths import _ENDINGS, _EXT, _FOLDERS, _NAME, _list, _paths
from .structure import _DEG, _E, _edges

_QUERIES_OF_PAGES = ["a=1", "q=../x", "q=<SCRIPT>", "q=%00", "b=2"]
NOW = "2002-01-01 00:00:00"


def _requests(spark, sf_dir):
    number = F.col("page_id")
    query = F.element_at(F.array(*map(F.lit, _QUERIES_OF_PAGES)), (number % len(_QUERIES_OF_PAGES)).cast("int") + 1)
    more = c.load(spark, sf_dir, "pages").select(number.alias("id"), query.alias("query"), F.when(number % 7 == 0, "OPTIONS").otherwise("GET").alias("method"), F.when(number % 11 == 0, " \n").otherwise(F.col("html")).alias("content"))
    return _paths(spark, sf_dir).join(more, "id")


def _accounts(spark, sf_dir):
    name, number = F.replace("c_name", F.lit("#"), F.lit("_")), F.col("c_custkey")
    email = F.concat(F.when(number % 3 == 0, "").otherwise(name), F.lit("@shop."), F.when(number % 4 == 0, "x").otherwise("org"))
    password = F.substring(F.concat(F.lit("aB"), number.cast("string"), F.lit("-lower"), F.upper("c_mktsegment")), (number % 5).cast("int") + 1, F.lit(4) + (number % 9).cast("int"))
    return c.load(spark, sf_dir, "customer").select(number.alias("id"), email.alias("email"), F.when(number % 2 == 0, F.col("c_name")).otherwise(name).alias("username"), password.alias("password"))


def _tasks(spark, sf_dir):
    lines = c.load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("indexed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return c.load(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderkey").alias("task"), "total", "indexed", "failed", F.col("o_orderdate").alias("started"))


def _results(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "N", "indexed").when(F.col("l_returnflag") == "A", "skipped").otherwise("failed")
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), status.alias("status"), F.col("l_quantity").cast("long").alias("chunks"))


def _parsed(spark, sf_dir):
    marks = c.load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("parsed", F.lit(True))
    return c.load(spark, sf_dir, "documents").join(marks, "doc_id", "left").select(F.col("source").alias("project"), F.col("lang").alias("method"), F.coalesce("parsed", F.lit(False)).alias("parsed"), F.ceil(F.col("n_chars") / 1000).alias("chunks"))


def _projects(spark, sf_dir):
    return c.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("language"), F.col("p_size").cast("long").alias("files"), (F.col("p_retailprice") > 1000).alias("indexed"))


def _ranked(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    first = (F.col("l_partkey") % 60).cast("long")
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.row_number().over(order).alias("place"), (F.col("l_suppkey") % 2).alias("path"), first.alias("first"), (first + F.col("l_quantity")).cast("long").alias("last"))


def _batches(spark, sf_dir):
    return c.files(spark, sf_dir).withColumnRenamed("project", "batch")


QUERIES = {
    "batch_guards": lambda s, d: checks.batch_guards(_batches(s, d)),
    "request_checks": lambda s, d: checks.request_checks(_requests(s, d)),
    "account_checks": lambda s, d: checks.account_checks(_accounts(s, d)),
    "project_search": lambda s, d: checks.project_search(_projects(s, d), "Red", "Brand#17"),
    "indexing_stats": lambda s, d: summaries.indexing_stats(_tasks(s, d), NOW),
    "indexing_totals": lambda s, d: summaries.indexing_totals(_results(s, d)),
    "parse_summary": lambda s, d: summaries.parse_summary(_parsed(s, d)),
    "run_outcomes": lambda s, d: summaries.run_outcomes(c.load(s, d, "events").select(F.col("user_id").alias("group"), (F.col("event_type") != "error").alias("ok"))),
    "connection_counts": lambda s, d: summaries.connection_counts(c.load(s, d, "events").select(F.col("event_type").alias("channel"), "user_id")),
    "dashboard_totals": lambda s, d: summaries.dashboard_totals(_projects(s, d)),
    "tokens_per_second": lambda s, d: summaries.tokens_per_second(c.load(s, d, "events").select(F.col("event_id").alias("stream"), F.floor("value").alias("tokens"), (F.col("event_id") % 5).cast("double").alias("seconds"))),
    "top_dependencies": lambda s, d: summaries.top_nodes(graph.degrees(_edges(s, d))),
    "history_summary": lambda s, d: summaries.history_summary(c.messages(s, d)),
    "lsh_pairs": lambda s, d: similarity.lsh_pairs(c.files(s, d)),
    "compare_files": lambda s, d: similarity.compare_two(c.files(s, d), 1, 2),
    "chunk_overlaps": lambda s, d: chunks.without_overlaps(_ranked(s, d)),
}

_PAGES = f"""s AS (SELECT page_id AS id, ({_FOLDERS})[page_id % {len(_FOLDERS)} + 1] || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') || ({_ENDINGS})[page_id % {len(_ENDINGS)} + 1] AS path,
  ({_QUERIES_OF_PAGES})[page_id % {len(_QUERIES_OF_PAGES)} + 1] AS query, CASE WHEN page_id % 7 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method, CASE WHEN page_id % 11 = 0 THEN ' ' || chr(10) ELSE html END AS content FROM pages)"""
_ANY = lambda parts, text: "(" + " OR ".join("contains({}, '{}')".format(text, p.replace("'", "''")) for p in parts) + ")"

ORACLE = {
    "batch_guards": f"""SELECT source AS batch, count(*) AS files, sum(coalesce(strlen(text), 0))::BIGINT AS bytes, CASE WHEN count(*) > {checks.BATCH_FILES} THEN 'too many files' WHEN sum(strlen(text)) > {checks.BATCH_BYTES} THEN 'too many bytes' WHEN count(*) FILTER (WHERE doc_id IS NULL) > 0 THEN 'file without a path' END AS fault FROM documents GROUP BY source""",
    "request_checks": f"""WITH {_PAGES} SELECT id, lower({_NAME}) IN ({_list(checks.UPLOAD_NAMES)}) OR {_EXT} IN ({_list([*checks.LANGUAGE_OF_EXTENSION, "zip"])}) AS may_upload,
  CASE WHEN {_EXT} IN ({_list(checks.INDEX_SKIP_EXTENSIONS)}) THEN 'extension' WHEN trim(content, ' ' || chr(10) || chr(13) || chr(9)) = '' THEN 'empty' WHEN strlen(content) > {checks.INDEX_MOST_BYTES} THEN 'too large' WHEN {_ANY(checks.GENERATED_NAMES, f"lower({_NAME})")} THEN 'generated' END AS skip_reason,
  {" OR ".join(f"starts_with(path, '{x}')" for x in checks.BYPASS_PATHS)} OR method = 'OPTIONS' OR NOT starts_with(path, '/api/') AS bypasses, {_ANY(checks.BLOCKED_PARTS, "lower(path || '?' || query)")} AS blocked FROM s""",
    "account_checks": f"""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE replace(c_name, '#', '_') END || '@shop.' || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'org' END AS email,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE replace(c_name, '#', '_') END AS username, substr('aB' || c_custkey || '-lower' || upper(c_mktsegment), c_custkey % 5 + 1, 4 + c_custkey % 9) AS password FROM customer)
SELECT id, regexp_matches(lower(trim(email, ' ')), '{checks.EMAIL}') AS email_ok, regexp_matches(trim(username, ' '), '{checks.USERNAME}') AS username_ok,
  CASE {" ".join(f"WHEN NOT regexp_matches(password, '{p}') THEN '{w}'" for p, w in checks.PASSWORD_RULES)} END AS password_complaint FROM a""",
    "project_search": """SELECT p_partkey AS project, p_name AS name, p_type AS description, p_brand AS language, p_size::BIGINT AS files, p_retailprice > 1000 AS indexed FROM part
WHERE (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')) AND p_brand = 'Brand#17'""",
    "indexing_stats": f"""WITH l AS (SELECT l_orderkey AS task, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'N') AS indexed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1),
t AS (SELECT task, total, indexed, indexed + failed AS done, epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate) AS elapsed FROM l JOIN orders ON o_orderkey = task),
r AS (SELECT task, round(indexed / greatest(done, 1) * 100, 1) AS success_pct, CASE WHEN done > 0 AND elapsed > 0 THEN round(done / elapsed, 2) ELSE 0.0 END AS files_per_second, total - done AS rest FROM t)
SELECT task, success_pct, files_per_second, CASE WHEN files_per_second > 0 AND rest > 0 THEN round(rest / files_per_second, 0) END AS eta_s FROM r""",
    "indexing_totals": """WITH r AS (SELECT l_orderkey AS task, count(*) AS files, count(*) FILTER (WHERE l_returnflag = 'N') AS indexed, count(*) FILTER (WHERE l_returnflag = 'A') AS skipped, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
  coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_returnflag = 'N'), 0)::BIGINT AS chunks FROM lineitem GROUP BY 1) SELECT *, CASE WHEN failed = files THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM r""",
    "parse_summary": """WITH f AS (SELECT source AS project, lang AS method, doc_id IN (SELECT doc_id FROM labels) AS parsed, ceil(n_chars / 1000)::BIGINT AS chunks FROM documents),
m AS (SELECT project, method, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, method) AS r FROM f GROUP BY 1, 2)
SELECT f.project, count(*) AS files, count(*) FILTER (WHERE parsed) AS parsed, round(count(*) FILTER (WHERE parsed) * 100 / count(*), 1) AS percent, round(sum(chunks) / count(*), 2) AS chunks_per_file, any_value(m.method) AS main_method
FROM f JOIN m ON m.project = f.project AND r = 1 GROUP BY 1""",
    "run_outcomes": """SELECT user_id AS "group", count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1""",
    "connection_counts": "SELECT coalesce(event_type, 'all') AS channel, coalesce(user_id::VARCHAR, 'all') AS user, count(*) AS connections, count(DISTINCT user_id) AS users FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "dashboard_totals": "SELECT count(*) AS projects, sum(p_size)::BIGINT AS files, count(*) FILTER (WHERE p_retailprice > 1000) AS indexed, count(DISTINCT p_brand) AS languages FROM part",
    "tokens_per_second": "SELECT event_id AS stream, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(floor(value) / (event_id % 5), 2) END AS tokens_per_second FROM events",
    "top_dependencies": f"WITH {_E}, {_DEG} SELECT * FROM deg ORDER BY in_degree DESC, node LIMIT 10",
    "history_summary": """WITH m AS (SELECT conv_id AS session, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS messages FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY session, r > 2 AND role = 'user' ORDER BY r DESC) AS i FROM m WHERE messages > 4)
SELECT session, any_value(messages) AS messages, 'Previous topics discussed:' || chr(10) || coalesce(string_agg('  ' || i || '. ' || substr(split_part(text, chr(10), 1), 1, 100) || chr(10), '' ORDER BY r DESC) FILTER (WHERE r > 2 AND role = 'user'), '')
  || chr(10) || 'Most recent exchange:' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY r DESC) FILTER (WHERE r <= 2) AS summary FROM t GROUP BY session""",
    "compare_files": f"""WITH {_SETS}, d AS (SELECT doc_id AS path, md5({_NORMAL}) AS digest FROM documents), x AS (SELECT s.path, shingles, digest FROM s JOIN d ON d.path = s.path)
SELECT a.path AS path_a, b.path AS path_b, coalesce(round(len(list_intersect(a.shingles, b.shingles)) / nullif(len(list_distinct(list_concat(a.shingles, b.shingles))), 0), 4), 1.0) AS similarity, a.digest = b.digest AS identical
FROM x a JOIN x b ON a.path = 1 AND b.path = 2""",
}
