"""Layouts of graphs, diagrams of layers, classes and routes, and trees of files.

Layouts place every node. Diagrams are reports: each names how many rows it shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.functions.tables import materialize

from .graph import degrees, layer_of, strong_components

#: Layers as diagrams show them, in order, and the arrows between them: fixed values.
LAYER_NAMES = {"presentation": "Presentation Layer", "business": "Business Logic", "data": "Data Access", "infrastructure": "Infrastructure", "utility": "Utilities", "other": "Other"}
LAYER_ARROWS = [("presentation", "business"), ("business", "data"), ("business", "infrastructure"), ("infrastructure", "utility")]
#: Heights of layers on a canvas: fixed values.
LAYER_HEIGHTS = {"presentation": 0, "business": 200, "data": 400, "infrastructure": 200, "utility": 600, "other": 800}
#: Decorators that declare a route, in two styles, and the function that follows: fixed values.
VERB_ROUTE = r"""@(?:router|app)\.(get|post|put|delete|patch|head|options)\s*\(\s*["']([^"']+)["']"""
METHODS_ROUTE = r"""@(?:app|blueprint)\.route\s*\(\s*["']([^"']+)["'](?:[^)]*methods\s*=\s*\[([^\]]+)\])?"""
HANDLER = r"(?:async\s+)?def\s+(\w+)\s*\("
#: What a request passes through in a sequence diagram, {verb} {path} {handler} filled in: fixed values.
REQUEST_STEPS = ["Client->>API: {verb} {path}", "API->>Service: {handler}()", "Service->>Database: query()", "Database-->>Service: result", "Service-->>API: response", "API-->>Client: 200 OK"]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `number`, from 0 in the order of columns that tell all rows apart.

    Ranges are numbered each by itself and moved by the counts of the ranges before, so
    no task holds all rows.
    """
    cut = materialize(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("range").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return cut.withColumn("at", within).join(F.broadcast(before), "range").withColumn("number", F.col("at") + F.col("before")).drop("range", "at", "before")


def grid_layout(nodes: DataFrame, width: int = 250, height: int = 150) -> DataFrame:
    """node, x, y: rows of as many nodes as the root of their number."""
    rows = numbered(nodes.select("node").distinct(), "node")
    columns = F.greatest(F.floor(F.sqrt(F.lit(nodes.select("node").distinct().count()))), F.lit(1))
    return rows.select("node", (F.pmod("number", columns) * width).cast("double").alias("x"), (F.floor(F.col("number") / columns) * height).cast("double").alias("y"))


def circular_layout(nodes: DataFrame, radius: int = 300, gap: int = 60) -> DataFrame:
    """node, x, y: on a circle that grows with the nodes."""
    names = nodes.select("node").distinct()
    n = names.count()
    angle, size = 2 * F.pi() * F.col("number") / max(n, 1), F.lit(float(max(radius, n * gap)))
    return numbered(names, "node").select("node", F.round(size * F.cos(angle), 2).alias("x"), F.round(size * F.sin(angle), 2).alias("y"))


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose both ends are among the nodes."""
    names = nodes.select("node").distinct()
    return edges.select("src", "dst").distinct().join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def subgraph(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """Edges among the `most` nodes that most others point to, smaller ids first where that is alike."""
    rows = nodes.select("node").distinct().join(degrees(edges), "node", "left").na.fill(0, ["in_degree"])
    top = F.broadcast(rows.orderBy(F.desc("in_degree"), "node").limit(most).select("node"))
    return kept_edges(edges, top)


def node_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, layer: 0 for nodes that nothing points to, else one more than the deepest node that points to them.

    Nodes that lie on a cycle with each other share a layer. Edges to nodes not listed
    and from a node to itself don't count. Each step follows the edges from what the last
    one reached and writes it; the last step that reaches a node is its layer.
    """
    inner = materialize(kept_edges(edges, nodes).where("src <> dst"), "inner")
    whole = strong_components(inner)
    parts = materialize(nodes.select("node").distinct().join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("part")), "parts")
    named = inner.join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst").where("a <> b")
    left = materialize(named.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "left")
    ends = materialize(parts.select(F.col("part").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "layer")
    found, layer = ends.withColumn("layer", F.lit(0)), 0
    while not ends.isEmpty():
        layer += 1
        ends = materialize(left.join(ends, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct(), "layer")
        found = found.union(ends.withColumn("layer", F.lit(layer)))
    deepest = found.groupBy("node").agg(F.max("layer").alias("layer"))
    return parts.join(deepest.withColumnRenamed("node", "part"), "part").select("node", "layer")


def hierarchical_layout(nodes: DataFrame, edges: DataFrame, width: int = 300, height: int = 150) -> DataFrame:
    """node, layer, x, y: each layer a centred row, in the order of ids."""
    rows = materialize(numbered(node_layers(nodes, edges), "layer", "node"), "placed")
    sizes = rows.groupBy("layer").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    at = F.col("number") - F.col("first")
    return rows.join(sizes, "layer").select("node", "layer", (at * width - (F.col("n") - 1) * width / 2).cast("double").alias("x"), (F.col("layer") * height).cast("double").alias("y"))


def _first_of_layers(files: DataFrame, most: int) -> DataFrame:
    """layer, files, first: each layer's number of files and its first paths in order."""
    rows = files.select("path", layer_of(F.col("path")).alias("layer"))
    first = rows.distinct().withColumn("at", F.row_number().over(Window.partitionBy("layer").orderBy("path"))).where(F.col("at") <= most)
    return rows.groupBy("layer").agg(F.count("*").alias("files")).join(first.groupBy("layer").agg(F.array_sort(F.collect_list("path")).alias("first")), "layer")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def layer_diagram(files: DataFrame, title: str = "Architecture Layers", most: int = 8) -> DataFrame:
    """A Mermaid flowchart of the layers of files(path), the first `most` paths of each."""
    line = lambda p: F.concat(F.lit("        "), F.translate(p, "/.-", "___"), F.lit('["'), _name(p), F.lit('"]'))
    display = F.element_at(F.create_map(*[F.lit(x) for pair in LAYER_NAMES.items() for x in pair]), F.col("layer"))
    block = F.concat(F.lit("    subgraph "), "layer", F.lit('["'), display, F.lit('"]\n'), F.array_join(F.transform("first", line), "\n"), F.lit("\n    end"))
    place = F.array_position(F.array(*map(F.lit, LAYER_NAMES)), F.col("layer"))
    one = _first_of_layers(files, most).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), block.alias("block")))).alias("blocks"), F.collect_set("layer").alias("have"))
    both = lambda a, b: F.array_contains("have", a) & F.array_contains("have", b)
    arrows = F.array_compact(F.array(*[F.when(both(a, b), F.lit(f"    {a} --> {b}")) for a, b in LAYER_ARROWS]))
    head = F.lit(f"---\ntitle: {title}\n---\nflowchart TD")
    return one.select(F.array_join(F.concat(F.array(head), F.transform("blocks", lambda b: b["block"]), arrows), "\n").alias("diagram"))


def layer_nodes(files: DataFrame, most: int = 10) -> DataFrame:
    """id, kind, parent, label, x, y: a group for each layer and the first `most` files in it, five in a row."""
    rows = _first_of_layers(files, most).withColumn("height", F.element_at(F.create_map(*[F.lit(x) for pair in LAYER_HEIGHTS.items() for x in pair]), F.col("layer")))
    group = rows.select(F.concat(F.lit("layer:"), "layer").alias("id"), F.lit("group").alias("kind"), F.lit(None).cast("string").alias("parent"), F.concat("layer", F.lit(" "), F.col("files").cast("string")).alias("label"), F.lit(0).alias("x"), F.col("height").alias("y"))
    inside = rows.select("layer", "height", F.posexplode("first").alias("at", "path"))
    file = inside.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("fileNode").alias("kind"), F.concat(F.lit("layer:"), "layer").alias("parent"), _name(F.col("path")).alias("label"), (20 + F.pmod("at", F.lit(5)) * 155).alias("x"), (F.col("height") + 40 + F.floor(F.col("at") / 5) * 60).cast("int").alias("y"))
    return group.union(file)


def class_diagram(functions: DataFrame, bases: DataFrame, title: str = "Class Hierarchy", most: int = 20, methods: int = 5) -> DataFrame:
    """path, diagram: a Mermaid class diagram of each file's classes, with their first methods and the bases known in the file.

    functions(path, class_name, name, line_start) and bases(path, class_name, base).
    """
    owned = functions.where("class_name IS NOT NULL").groupBy("path", "class_name").agg(F.slice(F.array_sort(F.collect_list(F.struct("line_start", "name"))), 1, methods).alias("m"))
    body = F.concat(F.lit("    class "), "class_name", F.lit(" {\n"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("        +"), x["name"], F.lit("()\n"))), ""), F.lit("    }"))
    shown = owned.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("m")[0]["line_start"].alias("at"), "class_name", body.alias("body")))), 1, most).alias("shown"))
    arrow = F.concat(F.lit("    "), "base", F.lit(" <|-- "), "class_name")
    known = bases.join(owned.select("path", F.col("class_name").alias("base")), ["path", "base"], "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(arrow)).alias("arrows"))
    empty = F.array().cast("array<string>")
    lines = F.concat(F.array(F.lit("classDiagram"), F.lit(f'    note "{title}"')), F.transform("shown", lambda x: x["body"]), F.coalesce("arrows", empty))
    return shown.join(known, "path", "left").select("path", F.array_join(lines, "\n").alias("diagram"))


def routes(files: DataFrame, reach: int = 200) -> DataFrame:
    """path, place, verb, route, handler, style: routes that decorators declare, one row for each verb.

    The handler is the first function within so many characters after the decorator,
    else "unknown". Null contents declare nothing.
    """
    text = F.coalesce("content", F.lit(""))
    after = rf"(?=([\s\S]{{0,{reach}}}))"
    found = lambda pattern, i: F.regexp_extract_all(text, F.lit(pattern + after), F.lit(i))
    verbs = files.select("path", F.posexplode(F.arrays_zip(found(VERB_ROUTE, 1).alias("verb"), found(VERB_ROUTE, 2).alias("route"), found(VERB_ROUTE, 3).alias("rest"))).alias("place", "r"), F.lit("verb").alias("style"))
    listed = files.select("path", F.posexplode(F.arrays_zip(found(METHODS_ROUTE, 2).alias("verb"), found(METHODS_ROUTE, 1).alias("route"), found(METHODS_ROUTE, 3).alias("rest"))).alias("place", "r"), F.lit("methods").alias("style"))
    rows = verbs.union(listed).select("path", "place", F.explode(F.split(F.when(F.col("r.verb") == "", "GET").otherwise(F.col("r.verb")), ",")).alias("verb"), F.col("r.route").alias("route"), F.regexp_extract("r.rest", HANDLER, 1).alias("handler"), "style")
    return rows.select("path", "place", F.upper(F.trim("verb", F.lit(" '\"\t\r\n"))).alias("verb"), "route", F.when(F.col("handler") == "", "unknown").otherwise(F.col("handler")).alias("handler"), "style")


def request_diagram(found: DataFrame, title: str = "API Request Flow", most: int = 8) -> DataFrame:
    """path, diagram: a Mermaid sequence diagram of each file's first routes."""
    filled = F.lit("\n".join("    " + step for step in REQUEST_STEPS))
    for name, column in (("{verb}", "verb"), ("{path}", "route"), ("{handler}", "handler")):
        filled = F.replace(filled, F.lit(name), F.col(column))
    rows = found.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.when(F.col("style") == "verb", 0).otherwise(1).alias("o"), "place", "verb", filled.alias("lines")))), 1, most).alias("shown"))
    head = F.lit("\n".join(["sequenceDiagram", f"    title {title}", *[f"    participant {x}" for x in ("Client", "API", "Service", "Database")]]))
    return rows.select("path", F.array_join(F.concat(F.array(head), F.transform("shown", lambda x: x["lines"])), "\n").alias("diagram"))


def file_tree(files: DataFrame) -> DataFrame:
    """node, parent, name, depth, kind, files, place: folders and files of files(path); folders come first in their folder, then names.

    A folder's files are counted at any depth. A path that is also a folder of others
    is a folder. The root has the parent "".
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = files.select(parts.alias("parts")).where(F.size("parts") > 0).distinct()
    each = rows.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    nodes = each.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("node"), "depth", (F.col("depth") == F.size("parts")).alias("last")).groupBy("node", "depth").agg(F.min("last").alias("leaf"), F.count("*").alias("files"))
    named = nodes.select("node", F.regexp_replace("node", r"/?[^/]*$", "").alias("parent"), _name(F.col("node")).alias("name"), "depth", F.when(F.col("leaf"), "file").otherwise("directory").alias("kind"), "files")
    rows = materialize(numbered(named, "parent", "kind", "name"), "tree")
    first = rows.groupBy("parent").agg(F.min("number").alias("first"))
    return rows.join(first, "parent").select("node", "parent", "name", "depth", "kind", "files", (F.col("number") - F.col("first") + 1).alias("place"))
