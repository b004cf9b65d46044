"""Queries over vectors (embeddings) and dependency graphs (suppliers and parts of lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import graph as g
from kilnspark.operators import vectors as v
from kilnspark.sources import corpus as c


def _vectors(spark, sf_dir):
    return c.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), "embedding", "label")


def _edges(spark, sf_dir):
    """A supplier depends on the suppliers whose numbers its parts' keys leave over; the graph grows with the input."""
    n = c.load(spark, sf_dir, "supplier").count()
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst"))


def _references(spark, sf_dir):
    """A sparse graph: an order refers to the orders that lie its parts' keys further on."""
    n = c.load(spark, sf_dir, "orders").count()
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), ((F.col("l_orderkey") + F.col("l_partkey")) % n).alias("dst"))


def _near_references(spark, sf_dir):
    """The same, but to orders at most 20 before or after, so that short cycles are many."""
    n = c.load(spark, sf_dir, "orders").count()
    return c.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), ((F.col("l_orderkey") + F.col("l_partkey") % 41 - 20 + n) % n).alias("dst"))


def _customers_orders(spark, sf_dir):
    """An order refers to the order that has its customer's number: rings of many lengths, each with trees that lead to it."""
    return c.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


def _nodes(spark, sf_dir):
    return c.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.concat(F.lit("pkg"), F.col("s_nationkey")).alias("package"))


def _paths(spark, sf_dir):
    return c.load(spark, sf_dir, "part").select(F.concat("p_type", F.lit("/"), "p_name").alias("path"))


#: The recall that cells are probed for, measured on at most 256 of the queries.
_RECALL = 0.95


def _ann(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked, index = rows.where("chunk % 100 = 0"), v.InvertedLists(rows)
    return index.search(asked, probes=index.tuned_probes(rows, asked, recall=_RECALL))


def _diverse(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return v.marginal_relevance(v.cosine_topk(rows, rows.where("chunk % 100 = 0"), 20), rows)


def _mmr_sql(k: int, weight: float) -> str:
    """Greedy choice unrolled: worst holds each candidate's largest cosine with those chosen."""
    sql = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, x.vec_id AS chunk, round(list_cosine_similarity(q.e, x.e), 6) AS cosine FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
c AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, chunk) <= 20),
p AS MATERIALIZED (SELECT a.query, a.chunk, b.chunk AS other, round(list_cosine_similarity(x.e, y.e), 6) AS same FROM c a JOIN c b USING (query) JOIN v x ON x.vec_id = a.chunk JOIN v y ON y.vec_id = b.chunk),
r1 AS MATERIALIZED (SELECT *, cosine AS score FROM c), t1 AS MATERIALIZED (SELECT query, chunk, score, 1 AS place FROM r1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) = 1)"""
    for i in range(2, k + 1):
        chosen = " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(1, i))
        sql += f""",
r{i} AS (SELECT c.query, c.chunk, round({weight} * any_value(cosine) - {1 - weight} * max(same), 6) AS score FROM c JOIN p USING (query, chunk) JOIN ({chosen}) t ON t.query = c.query AND t.chunk = p.other WHERE (c.query, c.chunk) NOT IN (SELECT (query, chunk) FROM ({chosen})) GROUP BY 1, 2),
t{i} AS MATERIALIZED (SELECT query, chunk, score, {i} AS place FROM r{i} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) = 1)"""
    return sql + " " + " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(1, k + 1))


_QUERY = [round(((i * 37) % 11 - 5) / 5, 1) for i in range(64)]

QUERIES = {
    "vector_topk": lambda s, d: v.cosine_topk(_vectors(s, d), _vectors(s, d).where("chunk % 100 = 0")),
    "vector_retrieval": lambda s, d: v.retrieve(_vectors(s, d), _vectors(s, d).where("chunk % 100 = 0")),
    "vector_same_label": lambda s, d: v.cosine_topk(_vectors(s, d), _vectors(s, d).where("chunk % 100 = 0"), match=("label",)),
    "vector_ann": _ann,
    "vector_mmr": _diverse,
    "vector_threshold": lambda s, d: v.similarity_to(_vectors(s, d), _QUERY),
    "label_centroids": lambda s, d: v.group_stats(_vectors(s, d)),
    "dependency_degree": lambda s, d: g.degrees(_edges(s, d)),
    "node_types": lambda s, d: g.node_types(_nodes(s, d), _edges(s, d)),
    "transitive_deps": lambda s, d: g.transitive(_edges(s, d), _nodes(s, d).where("node % 100 = 0")),
    "cycles": lambda s, d: g.cycles(_customers_orders(s, d)),
    "short_cycles": lambda s, d: g.short_cycles(_near_references(s, d)),
    "cycle_edges": lambda s, d: g.edges_in_cycles(_references(s, d)),
    "package_deps": lambda s, d: g.package_deps(_edges(s, d), _nodes(s, d)),
    "layer_classes": lambda s, d: g.layer_classes(_paths(s, d)),
    "mermaid_components": lambda s, d: g.mermaid_components(g.package_deps(_edges(s, d), _nodes(s, d))),
}

_E = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT count(*) FROM supplier) AS dst FROM lineitem)"
_R = "n AS (SELECT count(*) AS n FROM orders), e AS (SELECT DISTINCT l_orderkey AS src, (l_orderkey + l_partkey % 41 - 20 + n) % n AS dst FROM lineitem, n)"
_DEG = "deg AS (SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node)"
_PKG = "n AS (SELECT s_suppkey AS node, 'pkg' || s_nationkey AS package FROM supplier), p AS (SELECT coalesce(a.package, 'unknown') AS from_package, coalesce(b.package, 'unknown') AS to_package FROM e LEFT JOIN n a ON a.node = src LEFT JOIN n b ON b.node = dst), k AS (SELECT from_package, to_package, count(*) AS edges FROM p WHERE from_package <> to_package GROUP BY 1, 2)"

ORACLE = {
    "vector_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, x.vec_id AS chunk, round(list_cosine_similarity(q.e, x.e), 6) AS cosine FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id)
SELECT query, chunk, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, chunk)::INT AS place FROM s QUALIFY place <= 8""",
    "vector_same_label": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, x.vec_id AS chunk, round(list_cosine_similarity(q.e, x.e), 6) AS cosine FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id AND q.label = x.label)
SELECT query, chunk, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, chunk)::INT AS place FROM s QUALIFY place <= 8""",
    "vector_mmr": _mmr_sql(8, 0.7),
    "vector_retrieval": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, x.vec_id AS chunk, round(list_cosine_similarity(q.e, x.e), 6) AS cosine FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id),
n AS (SELECT *, greatest(0.0, 1 - (1 - cosine) / 2) AS s, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, chunk)::INT AS place FROM s QUALIFY place <= 20)
SELECT query, chunk, round(s, 4) AS similarity, place FROM n WHERE s >= 0.15 AND place <= 8""",
    "vector_threshold": f"""WITH s AS (SELECT vec_id AS chunk, greatest(0.0, 1 - (1 - list_cosine_similarity(embedding::DOUBLE[], {_QUERY}::DOUBLE[])) / 2) AS similarity FROM embeddings)
SELECT chunk, round(similarity, 4) AS similarity FROM s WHERE similarity >= 0.15""",
    "label_centroids": """WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2),
c AS (SELECT label, round(sum(m * m), 6) AS centre_norm2 FROM m GROUP BY label)
SELECT label, count(*) AS vectors, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS avg_norm, any_value(centre_norm2) AS centre_norm2 FROM embeddings JOIN c USING (label) GROUP BY label""",
    "dependency_degree": f"WITH {_E}, {_DEG} SELECT * FROM deg",
    "node_types": f"""WITH {_E}, {_DEG}, r AS (SELECT s_suppkey AS node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM supplier LEFT JOIN deg ON node = s_suppkey)
SELECT node, out_degree, in_degree, CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'entry_point' WHEN in_degree + out_degree = 0 THEN 'orphan' WHEN in_degree > 5 THEN 'hub' ELSE 'module' END AS kind FROM r""",
    "transitive_deps": f"""WITH RECURSIVE {_E}, w AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS steps FROM supplier WHERE s_suppkey % 100 = 0
  UNION SELECT start, dst, steps + 1 FROM w JOIN e ON src = node WHERE steps < 10)
SELECT start, node, min(steps) AS steps FROM w GROUP BY start, node HAVING min(steps) > 0""",
    "cycles": """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders),
w AS (SELECT src AS start, dst AS node, [src] AS way FROM e WHERE dst >= src UNION ALL SELECT start, dst, list_append(way, node) FROM w JOIN e ON src = node WHERE node <> start AND dst >= start AND len(way) <= (SELECT count(*) FROM e))
SELECT array_to_string(way, '>') AS cycle, len(way)::INT AS length FROM w WHERE node = start""",
    "short_cycles": f"""WITH {_R}, d AS (SELECT * FROM e WHERE src <> dst), p2 AS (SELECT src AS a, dst AS b FROM d WHERE src < dst),
p3 AS (SELECT a, b, dst AS c FROM p2 JOIN d ON src = b WHERE dst > a AND dst <> b), p4 AS (SELECT a, b, c, dst AS x FROM p3 JOIN d ON src = c WHERE dst > a AND dst NOT IN (b, c))
SELECT a || '>' || b AS cycle, 2 AS length FROM p2 JOIN d ON src = b AND dst = a
UNION ALL SELECT a || '>' || b || '>' || c, 3 FROM p3 JOIN d ON src = c AND dst = a
UNION ALL SELECT a || '>' || b || '>' || c || '>' || x, 4 FROM p4 JOIN d ON src = x AND dst = a""",
    "package_deps": f"WITH {_E}, {_PKG} SELECT * FROM k",
    "layer_classes": f"""WITH p AS (SELECT p_type || '/' || p_name AS path FROM part)
SELECT CASE {" ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(words)}') THEN '{layer}'" for layer, words in g.LAYERS.items())} ELSE 'other' END AS layer, count(*) AS files, min(path) AS first_path FROM p GROUP BY 1""",
    "mermaid_components": f"""WITH {_E}, {_PKG}, t AS (SELECT * FROM k ORDER BY edges DESC, from_package, to_package LIMIT 30)
SELECT 'graph LR' || chr(10) || string_agg('    ' || from_package || ' -->|' || edges || '| ' || to_package, chr(10) ORDER BY edges DESC, from_package, to_package) AS diagram FROM t""",
}
