from __future__ import annotations

from kilnspark.operators import diagrams as d


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_layers_of_a_graph_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("e", "e"), ("a", "gone"), ("a", "b")], "src string, dst string")
    got = {r.node: r.layer for r in d.node_layers(nodes(spark, "abcdef"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 0, "f": 0}


def test_layouts_place_each_node_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    got = {r.node: (r.layer, r.x, r.y) for r in d.hierarchical_layout(nodes(spark, "abcc"), edges).collect()}
    assert got == {"a": (0, 0.0, 0.0), "b": (1, -150.0, 150.0), "c": (1, 150.0, 150.0)}
    assert {(r.x, r.y) for r in d.grid_layout(nodes(spark, "abcde")).collect()} == {(0.0, 0.0), (250.0, 0.0), (0.0, 150.0), (250.0, 150.0), (0.0, 300.0)}
    assert [(r.x, r.y) for r in d.circular_layout(nodes(spark, "a")).collect()] == [(300.0, 0.0)]


def test_no_rows(spark):
    none, edges = nodes(spark, []), spark.createDataFrame([], "src string, dst string")
    assert d.grid_layout(none).count() == d.circular_layout(none).count() == d.hierarchical_layout(none, edges).count() == 0
    files = spark.createDataFrame([(None, None), ("x", None)], "path string, content string")
    assert d.routes(files).count() == 0 and d.file_tree(files.where("path IS NULL")).count() == 0


def test_routes_take_the_next_function_within_reach(spark):
    far = "@router.get('/far')\n" + "# \n" * 100 + "def far(): pass\n"
    near = "@app.route('/n', methods=['put',\"GET\"])\nasync def near(x): pass\n"
    files = spark.createDataFrame([("f", far), ("n", near)], "path string, content string")
    got = sorted((r.path, r.verb, r.route, r.handler) for r in d.routes(files).collect())
    assert got == [("f", "GET", "/far", "unknown"), ("n", "GET", "/n", "near"), ("n", "PUT", "/n", "near")]


def test_tree_puts_folders_first(spark):
    files = spark.createDataFrame([("z/a.py",), ("/b.py",), ("z//q/c.py",), ("a.py",), ("b.py",)], "path string")
    got = sorted((r.parent, r.place, r.name, r.kind, r.files) for r in d.file_tree(files).collect())
    assert got == [("", 1, "z", "directory", 2), ("", 2, "a.py", "file", 1), ("", 3, "b.py", "file", 1), ("z", 1, "q", "directory", 1), ("z", 2, "a.py", "file", 1), ("z/q", 1, "c.py", "file", 1)]
