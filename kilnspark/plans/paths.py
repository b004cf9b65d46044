"""Queries over paths and keys, intervals, packed contexts and pages of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import graph as g
from kilnspark.operators import paths as p
from kilnspark.operators.web import SCHEME_HOST
from kilnspark.sources import corpus as c


_FOLDERS = ["", "/api/v1/auth", "/services/node_modules", "/models", "/api/v1/files", "/.github", "/build/utils", "/src/db"]
_ENDINGS = ["", ".py", "/Dockerfile", ".tar.gz", ".JS"]


def _paths(spark, sf_dir):
    """The path of a page's url, put below folders that mean something to the rules and given an extension, by the page's number."""
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), SCHEME_HOST, "")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int") + 1)
    return c.load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(pick(_FOLDERS), path, pick(_ENDINGS)).alias("path"))


def _intervals(spark, sf_dir):
    start = F.col("l_partkey") % 50
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), start.alias("first"), (start + F.col("l_linenumber")).cast("long").alias("last"))


def _chunks(spark, sf_dir):
    return c.messages(spark, sf_dir).select(F.col("session").alias("key"), F.struct("turn", "role", "content").alias("place"), F.length("content").cast("long").alias("chars"))


def _sessions(spark, sf_dir):
    return c.messages(spark, sf_dir).groupBy("session").agg(F.count("*").alias("messages"))


def _stored(spark, sf_dir):
    """What a store holds already: the labelled documents, and the items of the benchmark under their own numbers."""
    labelled = c.load(spark, sf_dir, "labels").select("doc_id").distinct()
    mine = c.load(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return mine.union(c.load(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "upload_actions": lambda s, d: p.upload_actions(c.files(s, d), _stored(s, d)),
    "path_facts": lambda s, d: p.path_facts(_paths(s, d)),
    "file_keys": lambda s, d: p.keys(c.files(s, d)),
    "language_by_content": lambda s, d: p.language_by_content(c.files(s, d)),
    "merged_intervals": lambda s, d: p.merged_intervals(_intervals(s, d)),
    "context_packing": lambda s, d: p.packed_context(_chunks(s, d), 1200),
    "session_page": lambda s, d: p.page(_sessions(s, d), [F.desc("messages"), "session"], 2, 20),
}


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return ", ".join(map(_lit, xs))


def _case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN '{then}'" for when, then in pairs) + f" ELSE '{other}' END"


_EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"


def _points() -> str:
    by: dict[str, list[str]] = {}
    for language, weight, pattern in p.CONTENT_SIGNS:
        by.setdefault(language, []).append(f"least(len(regexp_extract_all(t, {_lit(pattern)})), 3) * {weight}")
    return " UNION ALL ".join(f"SELECT path, {i} AS i, '{name}' AS language, ({' + '.join(x)})::BIGINT AS points FROM s" for i, (name, x) in enumerate(by.items()))


ORACLE = {
    "upload_actions": """WITH k AS (SELECT doc_id AS path, coalesce(text, '') AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT item_id, coalesce(text, '') FROM benchmark)
SELECT doc_id AS path, CASE WHEN (doc_id, coalesce(text, '')) IN (SELECT (path, t) FROM k) THEN 'unchanged' WHEN doc_id IN (SELECT path FROM k) THEN 'replace' WHEN coalesce(text, '') IN (SELECT t FROM k) THEN 'duplicate' ELSE 'add' END AS action FROM documents""",
    "path_facts": f"""WITH s AS (SELECT page_id AS id, ({_FOLDERS})[page_id % {len(_FOLDERS)} + 1] || regexp_replace(regexp_replace(url, '[?#].*$', ''), '{SCHEME_HOST}', '') || ({_ENDINGS})[page_id % {len(_ENDINGS)} + 1] AS path FROM pages)
SELECT id, {_NAME} AS name, {_EXT} AS extension, regexp_replace({_NAME}, '(.)\\.[^.]+$', '\\1') AS stem, regexp_replace(path, '/?[^/]*$', '') AS parent,
  CASE WHEN regexp_extract(path, '^/*([^/]+)/', 1) = '' THEN 'root' ELSE regexp_extract(path, '^/*([^/]+)/', 1) END AS package,
  {_case([(f"{_EXT} = '{e}'", name) for e, name in p.LANGUAGE_OF_EXTENSION.items()], 'unknown')} AS language,
  {_case([(f"regexp_matches(lower(path), '{'|'.join(words)}')", layer) for layer, words in g.LAYERS.items()], 'other')} AS layer,
  {_case([(f"starts_with(path, '{a}')", b) for a, b in p.TIERS], 'api_default')} AS tier,
  len(list_filter(string_split(path, '/'), lambda x: x IN ({_list(p.SKIP_FOLDERS)}) OR (starts_with(x, '.') AND x NOT IN ({_list(p.SHOWN_HIDDEN)})))) > 0 OR {_EXT} IN ({_list(p.SKIP_EXTENSIONS)}) OR length(path) > 500 AS skipped
FROM s""",
    "file_keys": """SELECT doc_id AS path, md5(source || ':' || doc_id || ':0') AS chunk_id, sha256(source || '::' || doc_id || '::' || lang) AS cache_key,
  substr(regexp_replace(source || '/' || doc_id, '[^a-zA-Z0-9_.-]', '_', 'g'), 1, 60) AS safe_name, 'project_' || substr(replace(source, '-', ''), 1, 40) AS collection FROM documents""",
    "language_by_content": f"""WITH s AS (SELECT doc_id AS path, substr(text, 1, 3000) AS t FROM documents), a AS ({_points()}),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY points DESC, i) = 1)
SELECT path, CASE WHEN points > 0 THEN language ELSE 'unknown' END AS language, points, CASE WHEN points >= 10 THEN 'high' WHEN points >= 4 THEN 'medium' WHEN points >= 2 THEN 'low' ELSE 'none' END AS confidence FROM b""",
    "merged_intervals": """WITH r AS (SELECT l_orderkey AS key, l_partkey % 50 AS f, (l_partkey % 50 + l_linenumber)::BIGINT AS l FROM lineitem),
b AS (SELECT *, max(l) OVER (PARTITION BY key ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT *, sum(CASE WHEN f <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT key, min(f) AS first, max(l) AS last, count(*) AS merged FROM i GROUP BY key, island""",
    "context_packing": """WITH RECURSIVE o AS (SELECT conv_id AS key, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
w AS (SELECT key, i, CASE WHEN chars <= 1200 THEN chars ELSE 0 END AS used, (chars <= 1200)::BIGINT AS n FROM o WHERE i = 1
  UNION ALL SELECT o.key, o.i, w.used + CASE WHEN w.used + o.chars <= 1200 THEN o.chars ELSE 0 END, w.n + (w.used + o.chars <= 1200)::BIGINT FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
SELECT key, max(n) AS included, max(i) - max(n) AS skipped, max(used) AS used FROM w GROUP BY key""",
    "session_page": """WITH s AS (SELECT conv_id AS session, count(*) AS messages FROM conversations GROUP BY conv_id), t AS (SELECT count(*) AS total FROM s)
SELECT session, messages, total, ceil(total / 20)::BIGINT AS pages, total > 40 AS has_more FROM s, t ORDER BY messages DESC, session LIMIT 20 OFFSET 20""",
}
