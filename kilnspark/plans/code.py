"""Queries over code text: duplicates, rules and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import pyast
from kilnspark.operators import rules as r
from kilnspark.operators import similarity as m
from kilnspark.operators import web as w
from kilnspark.sources import corpus as c


def _items(spark, sf_dir):
    return c.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), F.col("text").alias("content"))


def _pages(spark, sf_dir):
    return c.load(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"), "url")


QUERIES = {
    "shingle_counts": lambda s, d: m.shingle_counts(c.files(s, d)),
    "exact_duplicates": lambda s, d: m.exact_duplicates(c.files(s, d)),
    "jaccard_pairs": lambda s, d: m.jaccard_pairs(c.files(s, d)),
    "similar_pairs_top": lambda s, d: m.top_similar_pairs(c.files(s, d)),
    "similar_files_top": lambda s, d: m.top_similar_files(m.similar_pairs(c.files(s, d))),
    "lsh_similar": lambda s, d: m.lsh_pairs(c.files(s, d)).drop("estimate"),
    "jaccard_membership": lambda s, d: m.class_members(c.files(s, d)),
    "repeated_blocks": lambda s, d: m.repeated_blocks(c.files(s, d)),
    "duplicate_windows": lambda s, d: m.duplicate_windows(c.files(s, d)),
    "benchmark_overlap": lambda s, d: m.benchmark_overlap(c.files(s, d), _items(s, d)),
    "duplicate_report": lambda s, d: m.duplicate_report(c.files(s, d)),
    "security_findings": lambda s, d: r.findings(_pages(s, d), r.JS_SECURITY + r.PYTHON_SECURITY),
    "generic_security_findings": lambda s, d: r.findings(c.files(s, d), r.GENERIC_SECURITY),
    "generic_review_findings": lambda s, d: r.findings(c.files(s, d), r.GENERIC_REVIEW),
    "security_risk": lambda s, d: r.security_risk(_pages(s, d), r.JS_SECURITY),
    "security_risk_python": lambda s, d: r.security_risk(c.files(s, d), r.PYTHON_SECURITY),
    "review_findings": lambda s, d: r.findings(c.files(s, d), r.PYTHON_REVIEW),
    "review_quality": lambda s, d: r.review_quality(c.files(s, d), r.PYTHON_REVIEW),
    "review_quality_js": lambda s, d: r.review_quality(_pages(s, d), r.JS_REVIEW),
    "python_tree_findings": lambda s, d: pyast.tree_findings(c.files(s, d)),
    "url_normalize": lambda s, d: w.normalized_urls(_pages(s, d)),
    "html_to_text": lambda s, d: w.plain_text(_pages(s, d)),
}


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _fits(x: str, rule: r.Rule) -> str:
    found = f"regexp_matches({x}, {_lit(rule.pattern)})"
    if rule.exception:
        found = f"({found} AND len(regexp_extract_all({x}, {_lit(rule.pattern)})) > len(regexp_extract_all({x}, {_lit(rule.exception)})))"
    return f"({found} AND NOT contains({x}, 'http'))" if rule.id == "JS002" else found


def _findings(table: str, key: str, text: str, rules: list[r.Rule]) -> str:
    each = ", ".join(f"CASE WHEN {_fits('line', x)} THEN '{x.id}|{x.severity}' END" for x in rules)
    return f"""WITH l AS (SELECT {key} AS path, string_split({text}, chr(10)) AS ls FROM {table}), e AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM l),
h AS (SELECT path, line_number::BIGINT AS line_number, substr(trim(line, ' '), 1, 100) AS evidence, unnest(list_filter([{each}], lambda x: x IS NOT NULL)) AS h FROM e)
SELECT path, line_number, evidence, split_part(h, '|', 1) AS rule, split_part(h, '|', 2) AS severity FROM h"""


def _counts(table: str, key: str, text: str, rules: list[r.Rule]) -> str:
    per = lambda s: " + ".join(f"len(list_filter(ls, lambda x: {_fits('x', y)}))" for y in rules if y.severity == s) or "0"
    return f"l AS (SELECT {key} AS path, string_split({text}, chr(10)) AS ls FROM {table}), k AS (SELECT path, len(ls)::BIGINT AS total_lines, {', '.join(f'({per(s)})::BIGINT AS {s.lower()}' for s in r.SEVERITIES)} FROM l)"


def _steps(value: str, steps: list[tuple[int, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {n} THEN '{x}'" for n, x in steps) + f" ELSE '{other}' END"


def _risk(table: str, key: str, text: str, rules: list[r.Rule]) -> str:
    score = " + ".join(f"{s.lower()} * {n}" for s, n in r.RISK_POINTS.items())
    return f"WITH {_counts(table, key, text, rules)}, s AS (SELECT *, ({score})::BIGINT AS risk_score FROM k) SELECT * EXCLUDE (total_lines), {_steps('risk_score', r.RISK_LEVELS, 'INFO')} AS risk_level FROM s"


def _quality(table: str, key: str, text: str, rules: list[r.Rule]) -> str:
    score = " + ".join(f"{s.lower()} * {n}" for s, n in r.REVIEW_POINTS.items())
    return f"""WITH {_counts(table, key, text, rules)}, s AS (SELECT *, ({score})::BIGINT AS deduction FROM k),
g AS (SELECT *, (100 - least(100, floor(deduction / greatest(1.0, total_lines / 100.0))))::BIGINT AS score FROM s) SELECT *, {_steps('score', r.GRADES, 'F')} AS grade FROM g"""


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '//[^\\n]*|#[^\\n]*', '', 'g'), '\\s+', ' ', 'g'), ' ')"
_TOKENS = f"list_filter(regexp_extract_all(lower({_NORMAL}), '{m.TOKEN}'), lambda t: t NOT IN ({', '.join(_lit(t) for t in m.STOP_TOKENS)}) AND length(t) > 1)"
_SHINGLES = "CASE WHEN len(toks) >= 3 THEN list_distinct(list_transform(range(1, len(toks) - 1), lambda i: array_to_string(toks[i:i + 2], ' '))) ELSE list_distinct(toks) END"
_SETS = f"t AS (SELECT doc_id AS path, {_TOKENS} AS toks FROM documents), s AS (SELECT path, toks, {_SHINGLES} AS shingles FROM t)"
_CLASSES = f"{_SETS}, d AS (SELECT path, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0), q AS (SELECT path, shingles, min(path) OVER (PARTITION BY shingles) AS class_path, count(*) OVER (PARTITION BY shingles) AS members FROM d)"



def _blocks(table: str, key: str, text: str, size: int = 8) -> str:
    return f"""WITH l AS (SELECT {key} AS path, list_transform(list_filter(string_split({text}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''), lambda x: lower(trim(regexp_replace(x, '#.*|//.*', '', 'g'), ' ' || chr(9) || chr(13)))) AS ls FROM {table}),
b AS (SELECT path, i - 1 AS at_line, md5(array_to_string(ls[i:i + {size - 1}], chr(10))) AS digest FROM (SELECT path, ls, unnest(range(1, len(ls) - {size - 2})) AS i FROM l WHERE len(ls) >= {2 * size})),
r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY path, digest) AS occurrences, lead(at_line) OVER w AS second_at FROM b WINDOW w AS (PARTITION BY path, digest ORDER BY at_line))
SELECT path, digest, occurrences, at_line AS first_at, second_at FROM r WHERE r = 1 AND second_at - at_line >= {size}"""


def _windows(table: str, key: str, text: str, size: int = 4) -> str:
    return f"""WITH l AS (SELECT {key} AS path, list_transform(string_split(regexp_replace(coalesce({text}, ''), '\\n\\z', ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '#.*', ''), '//.*', ''), '[ \\t\\r]+', ' ', 'g'), ' ')) AS ls FROM {table}),
b AS (SELECT path, i AS first_line, md5(array_to_string(ls[i:i + {size - 1}], chr(10))) AS digest FROM (SELECT path, ls, unnest(range(1, len(ls) - {size - 2})) AS i FROM l WHERE len(ls) >= {2 * size}) WHERE len(list_filter(ls[i:i + {size - 1}], lambda x: length(x) > 3)) >= {size // 2}),
r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY path, digest) AS occurrences, lead(first_line) OVER w AS second_line FROM b WINDOW w AS (PARTITION BY path, digest ORDER BY first_line))
SELECT path, digest, occurrences, first_line, second_line FROM r WHERE r = 1 AND occurrences > 1"""


ORACLE = {
    "generic_security_findings": _findings("documents", "doc_id", "text", r.GENERIC_SECURITY),
    "generic_review_findings": _findings("documents", "doc_id", "text", r.GENERIC_REVIEW),
    "shingle_counts": f"WITH {_SETS} SELECT path, len(toks)::BIGINT AS tokens, len(shingles)::BIGINT AS shingles FROM s",
    "exact_duplicates": f"""WITH n AS (SELECT doc_id AS path, md5({_NORMAL}) AS digest FROM documents)
SELECT path, min(path) OVER (PARTITION BY digest) AS class_path, count(*) OVER (PARTITION BY digest) AS class_size, digest FROM n QUALIFY class_size > 1""",
    "jaccard_pairs": f"""WITH {_CLASSES}, u AS (SELECT path, len(shingles) AS n, unnest(shingles) AS x FROM q WHERE path = class_path),
p AS (SELECT a.path AS path_a, b.path AS path_b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.path < b.path GROUP BY ALL)
SELECT path_a, path_b, round(k / (na + nb - k), 4) AS similarity FROM p WHERE k / (na + nb - k) >= 0.7 - 1e-9""",
    "lsh_similar": f"""WITH {_CLASSES}, u AS (SELECT path, len(shingles) AS n, unnest(shingles) AS x FROM q WHERE path = class_path),
p AS (SELECT a.path AS path_a, b.path AS path_b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.path < b.path GROUP BY ALL)
SELECT path_a, path_b, round(k / (na + nb - k), 4) AS similarity FROM p WHERE k / (na + nb - k) >= 0.7 - 1e-9""",
    "jaccard_membership": f"WITH {_CLASSES} SELECT path, class_path, members FROM q",
    "repeated_blocks": _blocks("documents", "doc_id", "text"),
    "duplicate_windows": _windows("documents", "doc_id", "text"),
    "benchmark_overlap": f"""WITH {_SETS}, bt AS (SELECT item_id AS item, {_TOKENS} AS toks FROM benchmark), bs AS (SELECT item, {_SHINGLES} AS shingles FROM bt),
a AS (SELECT path, unnest(shingles) AS x FROM s), b AS (SELECT item, len(shingles) AS n, unnest(shingles) AS x FROM bs)
SELECT path, item, count(*) AS shared, round(count(*) / n, 4) AS containment FROM a JOIN b USING (x) GROUP BY path, item, n HAVING count(*) >= 0.5 * n""",
    "duplicate_report": f"""WITH n AS (SELECT md5({_NORMAL}) AS digest, length(text) AS chars FROM documents), k AS (SELECT digest, count(*) AS n, sum(chars) AS chars, max(chars) AS longest FROM n GROUP BY digest)
SELECT sum(n)::BIGINT AS files, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicated, count(*) FILTER (WHERE n > 1) AS classes, coalesce(sum(chars - longest) FILTER (WHERE n > 1), 0)::BIGINT AS saved_chars,
  round(coalesce(sum(n) FILTER (WHERE n > 1), 0) * 100 / sum(n), 2) AS duplicate_ratio FROM k""",
    "security_findings": _findings("pages", "page_id", "html", r.JS_SECURITY + r.PYTHON_SECURITY),
    "security_risk": _risk("pages", "page_id", "html", r.JS_SECURITY),
    "security_risk_python": _risk("documents", "doc_id", "text", r.PYTHON_SECURITY),
    "review_findings": _findings("documents", "doc_id", "text", r.PYTHON_REVIEW),
    "review_quality": _quality("documents", "doc_id", "text", r.PYTHON_REVIEW),
    "review_quality_js": _quality("pages", "page_id", "html", r.JS_REVIEW),
    "url_normalize": f"""SELECT page_id AS path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '{w.SCHEME_HOST}', ''), '{w.UUID}', '{{id}}', 'gi'), '/[0-9]+(/|$)', '/{{id}}\\1', 'g'), '/[0-9]+(/|$)', '/{{id}}\\1', 'g') AS route FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""",
    "html_to_text": "SELECT page_id AS path, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'), ' ') AS plain FROM pages",
}


def halstead_sql(rows: str, lines: str) -> str:
    """Rows with n1, n2, ops, opds, complexity and lines, and what follows from these numbers."""
    return f"""(SELECT *, CASE WHEN mi >= 85 THEN 'A' WHEN mi >= 75 THEN 'B' WHEN mi >= 65 THEN 'C' WHEN mi >= 50 THEN 'D' ELSE 'F' END AS mi_grade,
  CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 15 THEN 'C' WHEN complexity <= 20 THEN 'D' ELSE 'F' END AS cc_grade
FROM (SELECT *, round(difficulty * volume, 2) AS effort, CASE WHEN volume <= 0 THEN 100.0 ELSE round(least(greatest((171 - 5.2 * ln(volume) - 0.23 * complexity - 16.2 * ln({lines})) * 100 / 171, 0), 100), 2) END AS mi
FROM (SELECT *, CASE WHEN n1 + n2 > 1 THEN round((ops + opds) * log2(n1 + n2), 2) ELSE 0.0 END AS volume, CASE WHEN n1 + n2 > 1 THEN round(n1 / 2 * (opds / greatest(n2, 1)), 2) ELSE 0.0 END AS difficulty FROM ({rows}))))"""


_PAIRS = f"""WITH p AS (SELECT class_path AS path_a, path AS path_b, 1.0::DOUBLE AS similarity, 'exact' AS kind FROM ({ORACLE["exact_duplicates"]}) WHERE path <> class_path
UNION ALL SELECT path_a, path_b, similarity, 'near' FROM ({ORACLE["jaccard_pairs"]}) WHERE similarity < 1)"""
ORACLE |= {
    "similar_pairs_top": f"{_PAIRS} SELECT * FROM p ORDER BY similarity DESC, path_a, path_b LIMIT 50",
    "similar_files_top": f"{_PAIRS} SELECT path, count(*) AS pairs, max(similarity) AS highest FROM (SELECT similarity, unnest([path_a, path_b]) AS path FROM p) GROUP BY path ORDER BY pairs DESC, path LIMIT 10",
}
