"""Queries over sources assembled from the lines of orders."""

from __future__ import annotations

from kilnspark.operators import declarations as d
from kilnspark.operators import elements as e
from kilnspark.sources.assembled import ASSEMBLED_SQL, EACH, LANGUAGES, PIECES, assembled_files


def _files(spark, sf_dir, language):
    files = assembled_files(spark, sf_dir)
    return files.where(files["language"] == language)


QUERIES = {
    "declarations": lambda s, sf: d.declarations(assembled_files(s, sf)),
    "script_elements": lambda s, sf: e.script_elements(_files(s, sf, "javascript")),
    "script_targets": lambda s, sf: e.script_targets(_files(s, sf, "javascript")),
    "python_elements": lambda s, sf: e.python_elements(_files(s, sf, "python")),
    "test_targets": lambda s, sf: e.test_targets(_files(s, sf, "python")),
}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cut(pattern: str, own: str) -> str:
    """path, i, piece, line and place of each match of a pattern."""
    before = "OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""(SELECT * FROM (SELECT path, piece, i, (1 + sum(len(piece) - len(replace(piece, chr(10), ''))) {before})::INT AS line, sum(len(piece)) {before} AS place
  FROM (SELECT path, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT path, string_split(regexp_replace(content, {_lit(pattern)}, chr(1) || '\\0', 'g'), chr(1)) AS ps FROM assembled WHERE {own}))) WHERE i > 1)"""


def _one(x: d.Declaration) -> str:
    """One pattern's rows."""
    own = f"language = '{x.language}'" if x.language != d.OTHER else f"language NOT IN ({', '.join(map(repr, d.LANGUAGES))})"
    head = lambda g: f"regexp_extract(piece, {_lit(x.pattern)}, {g})"
    name = f"coalesce({', '.join(f'nullif({head(g)}, {chr(39) * 2})' for g in x.names)})"
    if x.kind == "import":
        name = f"unnest(list_transform(string_split({name}, ','), lambda p: trim(p)))"
    parts = f"list_filter(list_transform(string_split({head(x.detail)}, ','), lambda p: trim(p)), lambda p: p <> '')" if x.detail else "[]::VARCHAR[]"
    if (x.language, x.kind) == ("python", "function"):
        parts = f"list_transform(list_filter({parts.replace('trim(p)', 'trim(p, chr(32) || chr(10))')}, lambda p: p NOT IN ('self', 'cls')), lambda p: trim(regexp_replace(p, '[:=](?s:.*)$', '')))"
    return f"SELECT path, '{x.kind}' AS kind, {name} AS name, array_to_string({parts}, ',') AS detail, line FROM {_cut(x.pattern, own)}"


def _elements() -> str:
    """The last comment's start before an element, by its place in the text."""
    parts = []
    for kind, pattern, args, base in e.SCRIPT_ELEMENTS:
        head = lambda g, p=pattern: f"regexp_extract(piece, {_lit(p)}, {g})"
        given = f"array_to_string(list_transform(list_filter(string_split({head(args)}, ','), lambda a: trim(a, chr(32) || chr(10)) <> ''), lambda a: trim(split_part(a, ':', 1), chr(32) || chr(10))), ',')" if args else "''"
        parts.append(f"SELECT path, '{kind}' AS kind, {head(1)} AS name, {given} AS args, {head(base) if base else chr(39) * 2} AS base, line, place FROM {_cut(pattern, 'true')}")
    window = f"substr(a.content, greatest(1, f.place::BIGINT - {e.REACH} + 1), least(f.place::BIGINT, {e.REACH}))"
    return f"""WITH {ASSEMBLED_SQL.replace("assembled AS", "every AS", 1)}, assembled AS MATERIALIZED (SELECT * FROM every WHERE language = 'javascript'), f AS ({" UNION ALL ".join(parts)})
SELECT path, kind, name, args, base, line, NOT contains({window}, '{e.COMMENT}') AS needs_doc FROM f JOIN assembled a USING (path)"""


def _known(language: str, rows: list[tuple[int, str]]) -> str:
    """What pieces of a source are known to give, by the lines before them: (piece, columns) each."""
    breaks = ", ".join(str(p.count("\n")) for p in PIECES[language])
    return f"""WITH p AS (SELECT l_orderkey AS path, (l_partkey + l_suppkey) % {EACH} AS piece, l_partkey AS p, l_linenumber AS q, ([{breaks}])[(l_partkey + l_suppkey) % {EACH} + 1] AS breaks,
  (1 + coalesce(sum(([{breaks}])[(l_partkey + l_suppkey) % {EACH} + 1]) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line
  FROM lineitem WHERE l_orderkey % {len(LANGUAGES)} = {LANGUAGES.index(language)})
""" + " UNION ALL ".join(f"SELECT path, {columns} FROM p WHERE piece = {piece}" for piece, columns in rows)


def _python(of_function: str, of_class: str, of_method: str) -> str:
    return _known("python", [(2, of_function), (3, of_class), (3, of_method)])


ORACLE = {
    "declarations": f"WITH {ASSEMBLED_SQL} " + " UNION ALL ".join(map(_one, d.DECLARATIONS)),
    "script_elements": _elements(),
    "script_targets": _known("javascript", [
        (0, "'function' AS kind, 'draw' || p AS name, NULL AS base, false AS is_async, 'a' AS args, false AS conditions, false AS loops, false AS raises, 2 AS score, line"),
        (1, "'arrow_function', 'run' || p, NULL, true, 'x', false, false, false, 1, line"),
        (2, "'class', 'View' || p, 'Base', NULL, NULL, false, false, false, 2, line"),
    ]),
    "python_elements": _python(
        "'function' AS kind, 'load_' || p AS name, false AS is_async, 'a: Any, b: int' AS args, 'dict' AS return_type, NULL AS bases, NULL AS methods, line, true AS needs_doc",
        "'class', 'Item' || p, NULL, NULL, NULL, 'Base,mixins.M' || q, 'total', line, true",
        "'function', 'total', false, 'self: Any, tax: Any', 'None', NULL, NULL, line + 1, true",
    ),
    "test_targets": _python(
        "'function' AS kind, 'load_' || p AS name, NULL AS class_name, false AS is_async, 'a: Any, b: int' AS args, 'dict' AS return_type, false AS conditions, false AS loops, false AS raises, false AS tries, 1 AS score, line",
        "'class', 'Item' || p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 2, line",
        "'method', 'total', 'Item' || p, false, 'tax: Any', 'None', false, false, false, false, 1, line + 1",
    ),
}
