"""Queries over files: documents stand in for source files, labels for parse results."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import files as f
from kilnspark.sources import corpus as c


def _parsed(spark, sf_dir):
    return c.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))


QUERIES = {
    "project_stats": lambda s, d: f.project_stats(c.files(s, d)),
    "status_rollup": lambda s, d: f.status_rollup(c.load(s, d, "orders"), "o_orderstatus", "o_totalprice"),
    "language_stats": lambda s, d: f.language_stats(c.files(s, d)),
    "parse_coverage": lambda s, d: f.parse_coverage(c.files(s, d), _parsed(s, d)),
    "unparsed_files": lambda s, d: f.unparsed_files(c.files(s, d), _parsed(s, d)),
    "loc_metrics": lambda s, d: f.loc_metrics(c.files(s, d)),
    "complexity_estimate": lambda s, d: f.complexity_estimate(c.files(s, d)),
    "halstead_metrics": lambda s, d: f.halstead(c.files(s, d)),
    "maintainability": lambda s, d: f.maintainability_index(c.files(s, d)),
    "chunk_windows": lambda s, d: f.chunk_windows(c.files(s, d)),
}

_LINES = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)"
_CC = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in (rf"\b(?:{'|'.join(f.BRANCH_WORDS)})\b", f.BRANCH_SIGN))
_LOC = "len(string_split(text, chr(10)))"
_BLANK = "len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = ''))"
_HALSTEAD = f"""t AS (SELECT doc_id AS path, regexp_extract_all(text, '{f.OPERATOR}') AS ops, regexp_extract_all(text, '{f.OPERAND}') AS opds FROM documents),
n AS (SELECT path, len(list_distinct(ops))::BIGINT AS n1, len(list_distinct(opds))::BIGINT AS n2, len(ops)::BIGINT AS total_operators, len(opds)::BIGINT AS total_operands FROM t),
v AS (SELECT *, n1 + n2 AS vocabulary, total_operators + total_operands AS length,
  CASE WHEN n1 + n2 > 1 THEN (total_operators + total_operands) * log2((n1 + n2)::DOUBLE) ELSE 0.0 END AS vol,
  CASE WHEN n1 + n2 > 1 THEN coalesce((n1 * total_operands) / nullif(2 * n2, 0), 0.0) ELSE 0.0 END AS dif FROM n)"""

ORACLE = {
    "project_stats": f"""SELECT source AS project, lang AS language, grouping(lang)::INT AS is_total, count(*) AS files, sum({_LINES})::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes
FROM documents GROUP BY GROUPING SETS ((source, lang), (source))""",
    "status_rollup": "SELECT o_orderstatus, grouping(o_orderstatus)::INT AS is_total, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ROLLUP (o_orderstatus)",
    "language_stats": """WITH r AS (SELECT lang AS language, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS sample_paths FROM documents GROUP BY lang)
SELECT language, files, round(files * 100 / sum(files) OVER (), 1) AS percent_files, bytes, round(bytes * 100 / sum(bytes) OVER (), 1) AS percent_bytes, sample_paths,
  row_number() OVER (ORDER BY files DESC, language DESC) = 1 AS is_primary FROM r""",
    "parse_coverage": """SELECT source AS project, count(*) AS files, count(l.doc_id) AS parsed, round(count(l.doc_id) * 100 / count(*), 1) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""",
    "unparsed_files": "SELECT doc_id AS path, source AS project, n_chars AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "loc_metrics": f"SELECT doc_id AS path, {_LOC}::BIGINT AS total_lines, {_BLANK}::BIGINT AS blank_lines, ({_LOC} - {_BLANK})::BIGINT AS code_lines FROM documents",
    "complexity_estimate": f"""WITH r AS (SELECT doc_id AS path, least(50, 1 + {_CC})::BIGINT AS cc, {_LOC}::BIGINT AS lines FROM documents)
SELECT path, cc, lines, round(greatest(0.0, 171 - 5.2 * ln(greatest(lines, 1)::DOUBLE) - 0.23 * cc) / 171 * 100, 2) AS maintainability,
  CASE WHEN cc <= 5 THEN 'A' WHEN cc <= 10 THEN 'B' WHEN cc <= 15 THEN 'C' WHEN cc <= 20 THEN 'D' ELSE 'F' END AS grade FROM r""",
    "halstead_metrics": f"""WITH {_HALSTEAD}
SELECT path, n1, n2, total_operators, total_operands, vocabulary, length, round(vol, 2) AS volume, round(dif, 2) AS difficulty, round(vol * dif, 2) AS effort, round(vol * dif / 18, 2) AS time_s, round(vol / 3000, 4) AS bugs FROM v""",
    "maintainability": f"""WITH {_HALSTEAD}, m AS (
  SELECT doc_id AS path, round(vol, 2) AS vol, least(50, 1 + {_CC})::DOUBLE AS cc, ({_LOC} - {_BLANK})::DOUBLE AS loc FROM v JOIN documents ON path = doc_id)
SELECT path, CASE WHEN vol <= 0 OR loc <= 0 THEN 100.0 ELSE round(least(greatest((171 - 5.2 * ln(vol) - 0.23 * cc - 16.2 * ln(loc)) * 100 / 171, 0.0), 100.0), 2) END AS mi FROM m""",
    "chunk_windows": f"""WITH l AS (SELECT doc_id AS path, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT path, ls, unnest(range(1, greatest(len(ls) - 4, 1) + 1, 116)) AS s FROM l),
e AS (SELECT path, s AS line_start, least(s + 119, len(ls)) AS line_end, ls FROM w),
k AS (SELECT path, line_start, line_end, length(array_to_string(ls[line_start:line_end], chr(10))) AS chars FROM e)
SELECT path, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, chars::BIGINT AS chars, greatest(1, chars // 4)::BIGINT AS tokens FROM k""",
}
