"""Queries for layouts, diagrams, routes, functions of scripts and trees of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.functions.tables import materialize
from kilnspark.operators import diagrams as m
from kilnspark.operators import graph as g
from kilnspark.operators import pyast, scripts
from kilnspark.sources import corpus as c
from kilnspark.sources.samples import CODE_SQL, code_files, expected_sql, route_files, script_files

from .code import halstead_sql
from .structure import _R, _near_references


def _suppliers(spark, sf_dir):
    return c.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))


def _orders(spark, sf_dir):
    return c.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))


def _halves(spark, sf_dir):
    """An order depends on those at a half, a third, ... of its number: no cycles, layers as the logarithm of the orders."""
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.expr("l_orderkey div (l_linenumber + 1)").alias("dst"))


#: Folder names by which the parts' files fall into all layers.
_FOLDERS = [words[i] for words in g.LAYERS.values() for i in (0, 1)] + ["notes"]


def _layered(spark, sf_dir):
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("p_partkey") % len(_FOLDERS)).cast("int") + 1)
    return c.load(spark, sf_dir, "part").select(F.concat(folder, F.lit("/part-"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))


def _python(spark, sf_dir):
    return code_files(spark, sf_dir).where("language = 'python'")


def _classes(spark, sf_dir):
    """One parse for functions and classes."""
    found = materialize(pyast.with_classes(_python(spark, sf_dir), function="name owner line", **{"class": "name bases"}), "facts")
    methods = found.where("kind = 'function'").select("path", "name", F.col("owner").alias("class_name"), F.col("line").alias("line_start"))
    return m.class_diagram(methods, pyast.class_edges_of(found))


QUERIES = {
    "grid_layout": lambda s, d: m.grid_layout(_suppliers(s, d)),
    "circular_layout": lambda s, d: m.circular_layout(_suppliers(s, d)),
    "hierarchical_layout": lambda s, d: m.hierarchical_layout(_orders(s, d), _halves(s, d)),
    "top_subgraph": lambda s, d: m.subgraph(_orders(s, d), _near_references(s, d)),
    "layer_diagram": lambda s, d: m.layer_diagram(_layered(s, d)),
    "layer_nodes": lambda s, d: m.layer_nodes(_layered(s, d)),
    "class_diagrams": _classes,
    "api_routes": lambda s, d: m.routes(route_files(s, d)),
    "request_diagrams": lambda s, d: m.request_diagram(m.routes(route_files(s, d))),
    "script_functions": lambda s, d: scripts.script_functions(script_files(s, d)),
    "file_tree": lambda s, d: m.file_tree(code_files(s, d)),
}

#: verb, route, handler, style, place of the routes in the sample
_ROUTES = [("GET", "/items/{id}", "read_item", "verb", 0), ("POST", "/items", "add_item", "verb", 1), ("DELETE", "/lost", "unknown", "verb", 2), ("GET", "/shop/{id}", "shop", "methods", 0), ("POST", "/shop/{id}", "shop", "methods", 0), ("GET", "/plain", "plain", "methods", 1)]
_ROUTES_SQL = f"SELECT 'routes/shop' || s_suppkey || '.py' AS path, verb, replace(route, '{{id}}', s_suppkey::VARCHAR) AS route, handler, style, place FROM supplier JOIN (VALUES {', '.join(map(str, _ROUTES))}) r(verb, route, handler, style, place) ON true"
_REQUESTS = "\n".join(["sequenceDiagram", "    title API Request Flow", *[f"    participant {x}" for x in ("Client", "API", "Service", "Database")], *["    " + step.format(verb=v, path=p, handler=h) for v, p, h, _, _ in _ROUTES for step in m.REQUEST_STEPS]])
#: name, first and last line, branches, cognitive complexity, parameters, async; kinds of operators and operands, operators and operands
_SCRIPTS = [("load", 1, 8, 2, 5, 2, True, 6, 10, 7, 13), ("sum_{id}", 10, 12, 1, 0, 2, False, 2, 3, 2, 3), ("open_one", 13, 14, 1, 0, 1, True, 0, 0, 0, 0)]
_CLASSES = [
    (0, 'classDiagram\n    note "Class Hierarchy"\n    class Store {\n        +__init__()\n        +load()\n        +total()\n    }'),
    (5, 'classDiagram\n    note "Class Hierarchy"\n    class Base {\n        +one()\n    }\n    class Leaf {\n        +two()\n    }\n    Base <|-- Leaf'),
]
_PATHS = f"p AS (SELECT ({_FOLDERS})[p_partkey % {len(_FOLDERS)} + 1] || '/part-' || p_partkey || '.py' AS path FROM part)"
_LAYER = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(words)}') THEN '{layer}'" for layer, words in g.LAYERS.items()) + " ELSE 'other' END"
_LAYERED = f"{_PATHS}, l AS (SELECT *, {_LAYER} AS layer, regexp_extract(path, '([^/]*)$', 1) AS name, row_number() OVER (PARTITION BY layer ORDER BY path)::INT AS pos, count(*) OVER (PARTITION BY layer) AS files FROM p)"


def _case(values: dict) -> str:
    return "CASE layer " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


ORACLE = {
    "grid_layout": "WITH n AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, greatest(floor(sqrt(count(*) OVER ()))::BIGINT, 1) AS k FROM supplier) SELECT node, (i % k * 250)::DOUBLE AS x, (i // k * 150)::DOUBLE AS y FROM n",
    "circular_layout": "WITH n AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT node, round(greatest(300, n * 60) * cos(2 * pi() * i / n), 2) AS x, round(greatest(300, n * 60) * sin(2 * pi() * i / n), 2) AS y FROM n",
    "hierarchical_layout": """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS src, l_orderkey // (l_linenumber + 1) AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey // (l_linenumber + 1) IN (SELECT o_orderkey FROM orders)),
w AS (SELECT o_orderkey AS node, 0 AS layer FROM orders WHERE o_orderkey NOT IN (SELECT dst FROM e WHERE src <> dst) UNION SELECT dst, layer + 1 FROM w JOIN e ON src = node WHERE src <> dst),
l AS (SELECT node, max(layer) AS layer FROM w GROUP BY node)
SELECT node, layer, (row_number() OVER (PARTITION BY layer ORDER BY node) - 1) * 300::DOUBLE - (count(*) OVER (PARTITION BY layer) - 1) * 150::DOUBLE AS x, layer * 150::DOUBLE AS y FROM l""",
    "top_subgraph": f"""WITH {_R}, i AS (SELECT dst AS node, count(*) AS k FROM e GROUP BY dst), t AS (SELECT o_orderkey AS node FROM orders LEFT JOIN i ON node = o_orderkey ORDER BY coalesce(k, 0) DESC, o_orderkey LIMIT 100)
SELECT src, dst FROM e WHERE src IN (FROM t) AND dst IN (FROM t)""",
    "layer_diagram": f"""WITH {_LAYERED}, b AS (SELECT layer, list_position({list(m.LAYER_NAMES)}, layer) AS place, '    subgraph ' || layer || '["' || {_case(m.LAYER_NAMES)} || '"]' || chr(10) || string_agg('        ' || translate(path, '/.-', '___') || '["' || name || '"]', chr(10) ORDER BY path) || chr(10) || '    end' AS block FROM l WHERE pos <= 8 GROUP BY layer),
a(i, x, y) AS (VALUES {", ".join(f"({i}, '{x}', '{y}')" for i, (x, y) in enumerate(m.LAYER_ARROWS))}),
o AS (SELECT place AS i, block AS line FROM b UNION ALL SELECT 100 + i, '    ' || x || ' --> ' || y FROM a WHERE x IN (SELECT layer FROM b) AND y IN (SELECT layer FROM b))
SELECT '---' || chr(10) || 'title: Architecture Layers' || chr(10) || '---' || chr(10) || 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS diagram FROM o""",
    "layer_nodes": f"""WITH {_LAYERED}, h AS (SELECT *, {_case(m.LAYER_HEIGHTS)}::INT AS height FROM l WHERE pos <= 10)
SELECT 'layer:' || layer AS id, 'group' AS kind, NULL::VARCHAR AS parent, layer || ' ' || files AS label, 0 AS x, height AS y FROM h WHERE pos = 1
UNION ALL SELECT 'file:' || path, 'fileNode', 'layer:' || layer, name, 20 + (pos - 1) % 5 * 155, height + 40 + (pos - 1) // 5 * 60 FROM h""",
    "class_diagrams": expected_sql("diagram VARCHAR", _CLASSES),
    "api_routes": _ROUTES_SQL,
    "request_diagrams": f"SELECT 'routes/shop' || s_suppkey || '.py' AS path, replace('{_REQUESTS}', '{{id}}', s_suppkey::VARCHAR) AS diagram FROM supplier",
    "script_functions": f"""SELECT 'web/shop' || s_suppkey || '.js' AS path, replace(name, '{{id}}', s_suppkey::VARCHAR) AS name, line_start, line_end, complexity, cognitive, parameters, is_async, volume, difficulty, effort, mi AS maintainability, cc_grade AS grade, mi_grade AS maintainability_grade
FROM supplier JOIN {halstead_sql(f"SELECT * FROM (VALUES {', '.join(map(str, _SCRIPTS))}) f(name, line_start, line_end, complexity, cognitive, parameters, is_async, n1, n2, ops, opds)", "greatest(line_end - line_start, 1)")} ON true""",
    "file_tree": f"""WITH {CODE_SQL}, s AS (SELECT DISTINCT string_split(path, '/') AS parts FROM code), n AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM s),
t AS (SELECT array_to_string(parts[:depth], '/') AS node, depth, min((depth = len(parts))::INT) AS leaf, count(*) AS files FROM n GROUP BY 1, 2),
k AS (SELECT node, regexp_replace(node, '/?[^/]*$', '') AS parent, regexp_extract(node, '([^/]*)$', 1) AS name, depth::INT AS depth, CASE leaf WHEN 1 THEN 'file' ELSE 'directory' END AS kind, files FROM t)
SELECT *, row_number() OVER (PARTITION BY parent ORDER BY kind, name) AS place FROM k""",
}
