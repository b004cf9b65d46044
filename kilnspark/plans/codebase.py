"""Queries over program code (the samples, one file for each part).

Where SQL can express a query it does. Where a syntax tree or a walk over lines is
needed, the oracle states what each sample gives, worked out by hand, for every file
made of it.
"""

from __future__ import annotations

from kilnspark.operators import checks, chunks, lines, paths, performance, pyast, rules, similarity, summaries
from kilnspark.sources.samples import CODE_SQL, code_files, expected_sql

from .code import _blocks, _findings, _quality, _risk, _windows, halstead_sql


def _python(spark, sf_dir):
    return code_files(spark, sf_dir).where("language = 'python'")


def _script(spark, sf_dir):
    return code_files(spark, sf_dir).where("language = 'javascript'")


def _performance(spark, sf_dir):
    found = performance.python_findings(_python(spark, sf_dir)).unionByName(performance.script_findings(_script(spark, sf_dir)))
    return performance.performance_rollup(code_files(spark, sf_dir), found)


def _alerts(spark, sf_dir):
    return checks.alerts(rules.severity_counts(_python(spark, sf_dir), rules.PYTHON_SECURITY)).select("path", "critical", "high")


QUERIES = {
    "python_performance": lambda s, d: performance.python_findings(_python(s, d)),
    "script_performance": lambda s, d: performance.script_findings(_script(s, d)),
    "performance_grades": _performance,
    "line_counts": lambda s, d: lines.line_counts(code_files(s, d)),
    "code_tree_findings": lambda s, d: pyast.tree_findings(_python(s, d)),
    "function_metrics": lambda s, d: pyast.functions(_python(s, d)),
    "file_complexity": lambda s, d: pyast.file_complexity(_python(s, d)),
    "function_halstead": lambda s, d: pyast.halstead_functions(_python(s, d)),
    "file_quality": lambda s, d: pyast.file_quality(_python(s, d)),
    "class_complexity": lambda s, d: pyast.class_complexity(_python(s, d)),
    "class_hierarchy": lambda s, d: pyast.class_edges(_python(s, d)),
    "project_complexity": lambda s, d: pyast.project_complexity(_python(s, d), 9),
    "magic_numbers": lambda s, d: pyast.magic_numbers(_python(s, d)),
    "code_imports": lambda s, d: pyast.imports(_python(s, d)),
    "code_chunks": lambda s, d: chunks.code_chunks(_python(s, d)),
    "code_repeated_blocks": lambda s, d: similarity.repeated_blocks(code_files(s, d)),
    "code_duplicate_windows": lambda s, d: similarity.duplicate_windows(code_files(s, d)),
    "code_security_findings": lambda s, d: rules.findings(_python(s, d), rules.PYTHON_SECURITY),
    "script_security_findings": lambda s, d: rules.findings(_script(s, d), rules.JS_SECURITY),
    "code_security_risk": lambda s, d: rules.security_risk(_python(s, d), rules.PYTHON_SECURITY),
    "script_security_risk": lambda s, d: rules.security_risk(_script(s, d), rules.JS_SECURITY),
    "security_alerts": _alerts,
    "code_review_findings": lambda s, d: rules.findings(_python(s, d), rules.PYTHON_REVIEW),
    "script_review_findings": lambda s, d: rules.findings(_script(s, d), rules.JS_REVIEW),
    "code_review_quality": lambda s, d: rules.review_quality(_python(s, d), rules.PYTHON_REVIEW),
    "ranked_findings": lambda s, d: summaries.ranked_findings(rules.findings(_python(s, d), rules.PYTHON_SECURITY).drop("evidence")),
    "script_refactoring": lambda s, d: rules.script_suggestions(_script(s, d)),
    "refactoring_rollup": lambda s, d: rules.suggestion_rollup(rules.script_suggestions(_script(s, d))),
    "detected_languages": lambda s, d: paths.detected_languages(code_files(s, d)),
}


#: sample, rule, impact, line, line_end
_PYTHON_PERFORMANCE = [
    (0, "PERF-PY-007", "CRITICAL", 16, 17), (0, "PERF-PY-001", "HIGH", 22, 24),
    (1, "PERF-PY-003", "HIGH", 4, 4), (1, "PERF-PY-004", "HIGH", 5, 5), (1, "PERF-PY-014", "MEDIUM", 6, 6), (1, "PERF-PY-012", "LOW", 7, 7), (1, "PERF-PY-002", "MEDIUM", 9, 9),
    (2, "PERF-PY-008", "HIGH", 5, 7), (2, "PERF-PY-008b", "HIGH", 5, 7), (2, "PERF-PY-015", "CRITICAL", 16, 19), (2, "PERF-PY-001", "HIGH", 17, 19), (2, "PERF-PY-011", "LOW", 16, 19), (2, "PERF-PY-011", "LOW", 17, 19),
    (5, "PERF-PY-001", "HIGH", 7, 11),
]
_SCRIPT_PERFORMANCE = [
    (6, "PERF-JS-001", "HIGH", 5, 5), (6, "PERF-JS-005", "MEDIUM", 7, 7), (6, "PERF-JS-008", "MEDIUM", 8, 8), (6, "PERF-JS-009", "LOW", 12, 12), (6, "PERF-JS-010", "HIGH", 16, 16),
    (7, "PERF-JS-003", "MEDIUM", 3, 3), (7, "PERF-JS-002", "CRITICAL", 15, 15),
]
#: sample, lines in all, of code, comment, docstring, blank, and the share of comments and docstrings
_LINE_COUNTS = [
    (0, 25, 17, 1, 2, 5, 15.0), (1, 12, 12, 0, 0, 0, 0.0), (2, 24, 18, 0, 0, 6, 0.0), (3, 19, 18, 1, 0, 0, 5.3), (4, 2, 2, 0, 0, 0, 0.0),
    (5, 24, 20, 0, 0, 4, 0.0), (6, 16, 13, 3, 0, 0, 18.8), (7, 16, 16, 0, 0, 0, 0.0), (8, 2, 2, 0, 0, 0, 0.0), (9, 26, 25, 0, 0, 1, 0.0),
]
#: sample, line, rule, severity, name
_TREE = [
    (0, 7, "REF-PY-DI", "MEDIUM", "Store"), (0, 13, "PY011", "LOW", "load"), (0, 20, "PY003", "HIGH", "total"), (0, 20, "PY011", "LOW", "total"),
    (1, 1, "PY009", "MEDIUM", "report_{id}"), (1, 1, "PY010", "MEDIUM", "report_{id}"), (1, 1, "PY011", "LOW", "report_{id}"), (1, 1, "REF-PY-003", "MEDIUM", "report_{id}"),
    (1, 1, "REF-PY-008", "LOW", "report_{id}"), (1, 1, "REF-PY-009", "LOW", "report_{id}"), (1, 1, "REF-PY-009", "LOW", "report_{id}"), (1, 10, "PY004", "LOW", "4711"), (1, 12, "PY004", "LOW", "5"),
    (2, 22, "PY002", "HIGH", None), (2, 22, "SEC-PY-012", "MEDIUM", None), (4, 0, "PY000", "CRITICAL", None),
    (5, 1, "PY011", "LOW", "walk_{id}"), (5, 1, "REF-PY-005", "MEDIUM", "walk_{id}"), (5, 4, "PY004", "LOW", "9"),
    (9, 1, "PY004", "LOW", "{id}"), (9, 2, "PY011", "LOW", "first"), (9, 10, "PY011", "LOW", "second"), (9, 19, "PY011", "LOW", "first"),
]
#: sample, name, class, first and last line, arguments, cyclomatic and cognitive complexity, nesting, documented
_FUNCTIONS = [
    (0, "__init__", "Store", 10, 11, 2, 1, 0, 0, 0), (0, "load", "Store", 13, 18, 2, 2, 1, 1, 0), (0, "total", "Store", 20, 25, 3, 5, 4, 2, 0),
    (1, "report_{id}", None, 1, 12, 6, 4, 3, 1, 0),
    (2, "poll_{id}", None, 5, 7, 1, 1, 0, 0, 0), (2, "calm", None, 10, 11, 1, 1, 0, 0, 0), (2, "cube", None, 14, 24, 1, 6, 7, 3, 0),
    (5, "walk_{id}", None, 1, 14, 2, 10, 26, 6, 0), (5, "one", "Base", 18, 19, 1, 1, 0, 0, 0), (5, "two", "Leaf", 23, 24, 1, 1, 0, 0, 0),
    (9, "first", None, 2, 9, 0, 1, 0, 0, 0), (9, "second", None, 10, 18, 0, 1, 0, 0, 0), (9, "first", None, 19, 26, 0, 1, 0, 0, 0),
]
_FUNCTION_COLUMNS = "name VARCHAR, class_name VARCHAR, line_start INT, line_end INT, args INT, complexity INT, cognitive INT, nesting INT, documented BOOLEAN"
#: sample, name, first line, kinds of operators and operands, operators and operands
_SIGNS = [
    (0, "__init__", 10, 2, 4, 2, 4), (0, "load", 13, 4, 7, 4, 10), (0, "total", 20, 7, 8, 9, 18), (1, "report_{id}", 1, 7, 18, 11, 26),
    (2, "poll_{id}", 5, 1, 8, 1, 8), (2, "calm", 10, 1, 5, 1, 5), (2, "cube", 14, 7, 9, 11, 21),
    (5, "walk_{id}", 1, 11, 17, 16, 26), (5, "one", 18, 2, 2, 2, 2), (5, "two", 23, 2, 2, 2, 2), (9, "first", 2, 7, 9, 12, 19), (9, "second", 10, 7, 10, 12, 19), (9, "first", 19, 7, 9, 12, 19),
]
#: sample, classes, and the same of the whole text
_FILE_SIGNS = [(0, 1, 10, 19, 19, 34), (1, 0, 7, 18, 11, 26), (2, 0, 9, 17, 15, 34), (3, 0, 2, 42, 5, 48), (5, 2, 12, 20, 22, 31), (9, 0, 7, 12, 37, 59)]
#: sample, type, name, first and last line, characters
_CHUNKS = [
    (0, "imports", "imports", 2, 4), (0, "class", "Store", 7, 25), (1, "function", "report_{id}", 1, 12), (2, "imports", "imports", 1, 2), (2, "function", "poll_{id}", 5, 7),
    (2, "function", "calm", 10, 11), (2, "function", "cube", 14, 24), (3, "module_part", "module", 1, 19), (4, "module_part", "module", 1, 2),
    (5, "function", "walk_{id}", 1, 14), (5, "class", "Base", 17, 19), (5, "class", "Leaf", 22, 24), (9, "function", "first", 2, 9), (9, "function", "second", 10, 18), (9, "function", "first", 19, 26),
]
_SUGGESTIONS = [(6, "REF-JS-002", "KISS", "LOW", 3), (7, "REF-JS-006", "SOLID-O", "MEDIUM", 16), (7, "REF-JS-007", "NAMING", "MEDIUM", 1)]
_SUGGESTION_SQL = expected_sql("rule VARCHAR, principle VARCHAR, severity VARCHAR, line BIGINT", _SUGGESTIONS)
_FINDING = "rule VARCHAR, impact VARCHAR, line BIGINT, line_end BIGINT"
_F = expected_sql(_FUNCTION_COLUMNS, _FUNCTIONS)
_PY, _JS = (f"(WITH {CODE_SQL} SELECT * FROM code WHERE language = '{x}')" for x in ("python", "javascript"))
_ALL = f"(WITH {CODE_SQL} SELECT * FROM code)"
_FILE = f"SELECT path, count(*) AS functions, round(avg(complexity), 2) AS avg_complexity, max(complexity) AS max_complexity, round(avg(cognitive), 2) AS avg_cognitive, count(*) FILTER (WHERE complexity > 10) AS complex_functions FROM ({_F}) GROUP BY path"
_POINTS = " + ".join(f"{n} * count(*) FILTER (WHERE impact = '{i}')" for i, n in performance.IMPACT_POINTS.items())
_RANK = "list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity)"

ORACLE = {
    "python_performance": expected_sql(_FINDING, _PYTHON_PERFORMANCE),
    "script_performance": expected_sql(_FINDING, _SCRIPT_PERFORMANCE),
    "performance_grades": f"""WITH f AS ({expected_sql(_FINDING, _PYTHON_PERFORMANCE + _SCRIPT_PERFORMANCE)}),
s AS (SELECT c.path, {", ".join(f"count(*) FILTER (WHERE impact = '{i}') AS {i.lower()}" for i in performance.IMPACT_POINTS)}, ({_POINTS})::BIGINT AS score FROM {_ALL} c LEFT JOIN f ON f.path = c.path GROUP BY c.path)
SELECT *, CASE {" ".join(f"WHEN score >= {n} THEN '{x}'" for n, x in performance.GRADES)} ELSE '{performance.BEST_GRADE}' END AS grade FROM s""",
    "line_counts": expected_sql("total_lines BIGINT, code_lines BIGINT, comment_lines BIGINT, docstring_lines BIGINT, blank_lines BIGINT, comment_ratio DOUBLE", _LINE_COUNTS),
    "code_tree_findings": expected_sql("line INT, rule VARCHAR, severity VARCHAR, name VARCHAR", _TREE),
    "function_metrics": _F,
    "file_complexity": _FILE,
    "function_halstead": f"""SELECT path, name, line_start, CASE WHEN n1 + n2 > 1 THEN n1 + n2 ELSE 0 END AS vocabulary, CASE WHEN n1 + n2 > 1 THEN ops + opds ELSE 0 END AS length, volume, difficulty, effort, round(effort / 18, 2) AS time_s, round(volume / 3000, 4) AS bugs, mi AS maintainability, cc_grade AS complexity_grade, mi_grade AS maintainability_grade
FROM {halstead_sql(f"SELECT * FROM ({_F}) JOIN ({expected_sql('name VARCHAR, line_start INT, n1 BIGINT, n2 BIGINT, ops BIGINT, opds BIGINT', _SIGNS)}) USING (path, name, line_start)", "line_end - line_start + 1")}""",
    "file_quality": f"""SELECT path, code_lines, functions, classes, avg_complexity, max_complexity, avg_cognitive, volume, mi AS maintainability, mi_grade AS maintainability_grade, cc_grade AS grade
FROM {halstead_sql(f"SELECT path, code_lines, coalesce(functions, 0) AS functions, classes, coalesce(avg_complexity, 0) AS avg_complexity, coalesce(max_complexity, 0) AS max_complexity, greatest(coalesce(max_complexity, 0), 1) AS complexity, coalesce(avg_cognitive, 0) AS avg_cognitive, n1, n2, ops, opds FROM ({expected_sql('classes BIGINT, n1 BIGINT, n2 BIGINT, ops BIGINT, opds BIGINT', _FILE_SIGNS)}) JOIN ({expected_sql('code_lines BIGINT', [r[:1] + r[2:3] for r in _LINE_COUNTS])}) USING (path) LEFT JOIN ({_FILE}) USING (path)", "code_lines")}""",
    "class_complexity": expected_sql("class_name VARCHAR, methods BIGINT, avg_complexity DOUBLE, max_complexity INT, bases VARCHAR", [(0, "Store", 3, 2.67, 5, ""), (5, "Base", 1, 1.0, 1, ""), (5, "Leaf", 1, 1.0, 1, "Base")]),
    "class_hierarchy": expected_sql("class_name VARCHAR, base VARCHAR", [(5, "Leaf", "Base")]),
    "project_complexity": f"""WITH m AS ({_FILE}), f AS (SELECT c.project, c.path, coalesce(functions, 0) AS functions, coalesce(avg_complexity, 0) AS a, coalesce(max_complexity, 0) AS x, coalesce(avg_cognitive, 0) AS g FROM {_PY} c LEFT JOIN m ON m.path = c.path),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY x DESC, a DESC, path DESC) AS r FROM f)
SELECT project, count(*) AS files, sum(functions)::BIGINT AS functions, round(sum(round(a * 100)) / (count(*) * 100), 9) AS avg_complexity, round(sum(round(g * 100)) / (count(*) * 100), 9) AS avg_cognitive, max(x) AS max_complexity, max(path) FILTER (WHERE r = 1) AS worst_file FROM r GROUP BY project""",
    "magic_numbers": expected_sql("value VARCHAR, line INT", [(1, "4711", 10), (1, "5", 12), (5, "9", 4), (9, "{id}", 1)]),
    "code_imports": expected_sql("module VARCHAR, name VARCHAR, level BIGINT, line BIGINT", [(0, "os", None, 0, 2), (0, "re", None, 0, 3), (0, "models.order", "Order", 0, 4), (0, "models.order", "Line", 0, 4), (2, "time", None, 0, 1), (2, "requests", None, 0, 2)]),
    "code_chunks": f"""WITH e AS ({expected_sql("chunk_type VARCHAR, name VARCHAR, line_start INT, line_end INT", _CHUNKS)}),
n AS (SELECT e.*, length(array_to_string(string_split(content, chr(10))[line_start:line_end], chr(10)))::BIGINT AS chars FROM e JOIN {_PY} c ON c.path = e.path)
SELECT *, greatest(1, chars // 4)::BIGINT AS tokens FROM n""",
    "code_repeated_blocks": _blocks(_ALL, "path", "content"),
    "code_duplicate_windows": _windows(_ALL, "path", "content"),
    "code_security_findings": _findings(_PY, "path", "content", rules.PYTHON_SECURITY),
    "script_security_findings": _findings(_JS, "path", "content", rules.JS_SECURITY),
    "code_security_risk": _risk(_PY, "path", "content", rules.PYTHON_SECURITY),
    "script_security_risk": _risk(_JS, "path", "content", rules.JS_SECURITY),
    "security_alerts": f"SELECT path, critical, high FROM ({_risk(_PY, 'path', 'content', rules.PYTHON_SECURITY)}) WHERE critical > 0 OR high >= 3",
    "code_review_findings": _findings(_PY, "path", "content", rules.PYTHON_REVIEW),
    "script_review_findings": _findings(_JS, "path", "content", rules.JS_REVIEW),
    "code_review_quality": _quality(_PY, "path", "content", rules.PYTHON_REVIEW),
    "ranked_findings": f"SELECT path, line_number, rule, severity, row_number() OVER (PARTITION BY path ORDER BY {_RANK}, line_number, rule)::INT AS place FROM ({_findings(_PY, 'path', 'content', rules.PYTHON_SECURITY)}) QUALIFY place <= 5",
    "script_refactoring": _SUGGESTION_SQL,
    "refactoring_rollup": f"SELECT principle, severity, grouping(principle, severity)::INT AS level, count(*) AS suggestions FROM ({_SUGGESTION_SQL}) GROUP BY CUBE (principle, severity)",
    "detected_languages": f"SELECT path, CASE WHEN sample = 8 THEN 'python' ELSE language END AS language, 'high' AS confidence, CASE WHEN sample = 8 THEN 'shebang' ELSE 'extension' END AS method FROM {_ALL}",
}
