"""Merkle manifest of a dataset: a leaf for each row, a subroot for each language, one root, a proof for each row.

Leaves are ranked by one range partitioning and the counts of its partitions; no window
and no task ever holds a whole language. They are then cut into blocks of FAN ** LEVELS
consecutive leaves of a language, and each block is reduced to one node where it lies.
Nodes are cut into blocks again until at most TOP are left. That top tree is built by the
driver. The way from each of its nodes to the root is broadcast, at most TOP rows, and
handed down from blocks to their members; a leaf's proof is its way inside its block and
then its block's way. Every row folds its leaf, tampered or not, along that way.

Many languages are no different from many leaves: subroots, once each language is down to
one node, are ranked and cut into blocks by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, map_batches, materialize, table

#: Children of a node, levels in a block, nodes that the driver takes.
FAN, LEVELS, TOP = 8, 4, 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
EVERY = 3
#: A node's way to the root: its run's other digests before and after it, as hex text, level by level.
WAYS = "grp string, pos bigint, subroot string, way array<struct<before:string,after:string>>"
HANDED = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("way", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])
ROOTS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("node", pa.string())])


def framed(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, columns)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def reduce_nodes(nodes: list[str], levels: int | None) -> tuple[str, list[list[tuple[str, str]]]]:
    """One digest of up to FAN ** levels nodes, and each node's way to it.

    Without a number of levels it stops where one node is left.
    """
    ways: list[list[tuple[str, str]]] = [[] for _ in nodes]
    spans = [range(i, i + 1) for i in range(len(nodes))]
    while len(nodes) > 1 if levels is None else levels > 0:
        above, wider = [], []
        for at in range(0, len(nodes), FAN):
            run = nodes[at : at + FAN]
            for i in range(len(run)):
                step = ("".join(run[:i]), "".join(run[i + 1 :]))
                for leaf in spans[at + i]:
                    ways[leaf].append(step)
            above.append(digest(run))
            wider.append(range(spans[at].start, spans[at + len(run) - 1].stop))
        nodes, spans, levels = above, wider, None if levels is None else levels - 1
    return nodes[0], ways


def fold(leaf: str, way: list[tuple[str, str]]) -> str:
    for before, after in way:
        leaf = sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def proof_of(way: list[tuple[str, str]]) -> str:
    return digest([side for step in way for side in step])


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos (place in its grp by the order, nulls first) and size (rows of its grp).

    A written table is sorted into ranges. Row numbers inside a range come with the sort,
    and what lies before it from the counts of ranges, of which there are as many as
    ranges and groups. Ties are split between ranges by a number that is unique to a row.
    """
    keyed = materialize(rows.withColumn("uniq", F.monotonically_increasing_id()), f"{name}-keyed")
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "uniq")]
    held = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = materialize(held.withColumn("span", F.spark_partition_id()).withColumn("num", F.monotonically_increasing_id()).drop("uniq"), f"{name}-sorted")
    forget(keyed)
    spans = held.groupBy("grp", "span").agg(F.count("*").alias("n"), F.min("num").alias("least"))
    before = "sum(n) OVER (PARTITION BY grp ORDER BY span ROWS UNBOUNDED PRECEDING) - n - least AS shift"
    spans = materialize(spans.selectExpr("grp AS span_grp", "span AS span_id", before, "sum(n) OVER (PARTITION BY grp) AS size"), f"{name}-spans")
    same = (F.col("span") == F.col("span_id")) & F.col("grp").eqNullSafe(F.col("span_grp"))
    return held.join(broadcast_if_small(spans), same).withColumn("pos", F.col("num") + F.col("shift")).drop("span", "num", "span_id", "span_grp", "shift")


def blocks_of(nodes: DataFrame, payload: list[str], levels: int, name: str) -> DataFrame:
    """One row for each block: grp, block, size (nodes of its group), members in order (pos, node and payload)."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", *payload))).alias("members")
    return materialize(nodes.groupBy("grp", F.expr(f"pos div {FAN**levels}").alias("block")).agg(F.first("size").alias("size"), members), name)


def levels_of(size: int, levels: int) -> int | None:
    """Levels to reduce a block by: all of a group that fits in one block, else those of a whole block."""
    return None if size <= FAN**levels else levels


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as a block has thousands of members."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def block_roots(blocks: DataFrame, levels: int) -> DataFrame:
    """grp, pos, size, node: the node that each block is reduced to, and its place among its group's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            node, _ = reduce_nodes(row["nodes"], levels_of(row["size"], levels))
            yield pa.RecordBatch.from_pylist([{"grp": row["grp"], "pos": row["block"], "size": -(-row["size"] // FAN**levels), "node": node}], ROOTS)

    nodes = blocks.select("grp", "block", "size", F.col("members.node").alias("nodes"))
    return materialize(map_batches(nodes, run, "grp string, pos bigint, size bigint, node string"), "block-roots")


def climb(blocks: DataFrame, levels: int, top: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, lowest first, and the nodes that the highest is reduced to: top at most, or one for each group."""
    rounds, nodes = [blocks], block_roots(blocks, levels)
    while nodes.count() > top and not nodes.where("size > 1").isEmpty():
        rounds.append(blocks_of(nodes, [], levels, "node-blocks"))
        nodes = block_roots(rounds[-1], levels)
    return rounds, nodes


def _with_ways(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """blocks with subroot and way of the nodes that they are reduced to, from ways(grp, pos, subroot, way)."""
    up = ways.withColumnsRenamed({"grp": "way_grp", "pos": "way_pos"})
    return blocks.join(up, F.col("grp").eqNullSafe(F.col("way_grp")) & (F.col("block") == F.col("way_pos"))).drop("way_grp", "way_pos")


def _member_ways(row: dict, levels: int) -> list[list[tuple[str, str]]]:
    """Each member's way to the root: inside its block, then the block's."""
    above = [(step["before"], step["after"]) for step in row["way"]]
    return [way + above for way in reduce_nodes([m["node"] for m in row["members"]], levels_of(row["size"], levels))[1]]


def hand_down(blocks: DataFrame, ways: DataFrame, levels: int) -> DataFrame:
    """ways(grp, pos, subroot, way) of the members of blocks. Members with a language are subroots, each the one node of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            out = []
            for m, way in zip(row["members"], _member_ways(row, levels), strict=True):
                own = {"grp": m["lang"], "pos": 0, "subroot": m["node"]} if "lang" in m else {"grp": row["grp"], "pos": m["pos"], "subroot": row["subroot"]}
                out.append(own | {"way": [{"before": b, "after": a} for b, a in way]})
            yield pa.RecordBatch.from_pylist(out, HANDED)

    return broadcast_if_small(materialize(map_batches(_with_ways(blocks, ways), run, WAYS), "ways"))


def leaves(docs: DataFrame) -> DataFrame:
    """grp, doc_id, node, other: a leaf for each row in the group of its language, and its tampered leaf where that differs."""
    docs = docs.select(*COLUMNS)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0) & (lowered(F.col("text")) != F.col("text"))
    changed = leaf_of([lowered(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    return docs.select(F.col("lang").alias("grp"), "doc_id", leaf_of([F.col(c) for c in COLUMNS]).alias("node"), F.when(tampered, changed).alias("other"))


def top_ways(nodes: list[tuple[str | None, int, str]], one_tree: bool) -> tuple[list[tuple], str]:
    """(grp, pos, subroot, way) of the top nodes, and the root.

    In one tree the nodes are blocks of subroots, else each language has some.
    """
    nodes = sorted(nodes, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    subroots, held = [], []
    for _, members in groupby(nodes, key=lambda r: r[0]):
        members = list(members)
        subroot, ways = reduce_nodes([m[2] for m in members], None)
        held += [(grp, pos, None if one_tree else subroot, way, len(subroots)) for (grp, pos, _), way in zip(members, ways, strict=True)]
        subroots.append(subroot)
    root, ways = reduce_nodes(subroots, None) if subroots else ("", [])
    return [(grp, pos, subroot, way + ways[at]) for grp, pos, subroot, way, at in held], root


def manifest(docs: DataFrame, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a language ascend by doc_id, null ids first, rows of one id by leaf; equal
    rows may stand in any order, which changes no digest. A null id is never tampered
    with. A null language is a tree of its own, as the empty one is. A single row is leaf,
    subroot and root in one and has no siblings: its proof is the digest of nothing. No
    rows give no rows. Other columns are not looked at; texts are read once and not moved.
    """
    lowest = blocks_of(ranked(leaves(docs), ["doc_id", "node"], "leaves"), ["doc_id", "other"], levels, "leaf-blocks")
    rounds, nodes = climb(lowest, levels, top)
    one_tree = nodes.count() > top
    if one_tree:
        subroots = ranked(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "node"), ["lang"], "subroots")
        more, nodes = climb(blocks_of(subroots, ["lang"], levels, "subroot-blocks"), levels, top)
        rounds += more
    held, root = top_ways([(r["grp"], r["pos"], r["node"]) for r in nodes.select("grp", "pos", "node").collect()], one_tree)
    ways = F.broadcast(docs.sparkSession.createDataFrame(held, WAYS))
    for blocks in reversed(rounds[1:]):
        ways = hand_down(blocks, ways, levels)
    return finish(lowest, ways, root, levels)


def finish(blocks: DataFrame, ways: DataFrame, root: str, levels: int) -> DataFrame:
    """The manifest's rows from blocks of leaves and the ways of their nodes."""
    kind = blocks.schema["members"].dataType.elementType["doc_id"].dataType.simpleString()
    strings = ("leaf", "subroot", "root", "proof_sha256", "folded_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("members").type.value_type.field("doc_id").type
            shape = pa.schema([("doc_id", id_type), *((c, pa.string()) for c in strings), ("verified", pa.bool_())])
            for row in _each([batch]):
                out = []
                for m, way in zip(row["members"], _member_ways(row, levels), strict=True):
                    folded = fold(m["other"] or m["node"], way)
                    out.append({"doc_id": m["doc_id"], "leaf": m["node"], "subroot": row["subroot"], "root": root, "proof_sha256": proof_of(way), "folded_root": folded, "verified": folded == root})
                yield pa.RecordBatch.from_pylist(out, shape)

    return map_batches(_with_ways(blocks, ways), run, f"doc_id {kind}, " + "".join(f"{c} string, " for c in strings) + "verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _oracle(depth: int = 12) -> str:
    """Levels unrolled, far more than a table that SQL can take needs; one crc32 step for each digit of doc_id."""
    part = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: f"sha256(concat({', '.join(part(text if c == 'text' else c) for c in COLUMNS)}))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {step}), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""
WITH docs AS MATERIALIZED (
  SELECT lang AS grp, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % {EVERY} = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS shown FROM documents
), placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs
), a0 AS MATERIALIZED (SELECT grp, pos, leaf AS node FROM placed"""

    def tree(a: str, key: str) -> str:
        sql = ""
        for i in range(depth):
            sql += f"""), {a}n{i} AS MATERIALIZED (SELECT *, pos // {FAN} AS run, count(*) OVER (PARTITION BY {key}) > 1 AS more FROM {a}{i}
), {a}{i + 1} AS MATERIALIZED (
  SELECT {key}, run AS pos, CASE WHEN any_value(more) THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node FROM {a}n{i} GROUP BY {key}, run
), {a}s{i} AS MATERIALIZED (
  SELECT x.{key}, x.pos, x.more, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM {a}n{i} x JOIN {a}n{i} y ON x.{key} IS NOT DISTINCT FROM y.{key} AND x.run = y.run GROUP BY ALL
"""
        return sql

    def walk(a: str, key: str, start: str) -> str:
        sql = f"), {a}w0 AS MATERIALIZED ({start}\n"
        for i in range(depth):
            sql += f"""), {a}w{i + 1} AS MATERIALIZED (
  SELECT w.* REPLACE (CASE WHEN more THEN sha256(l || folded || r) ELSE folded END AS folded, proof || l || r AS proof, spot // {FAN} AS spot)
  FROM {a}w{i} w JOIN {a}s{i} s ON s.{key} IS NOT DISTINCT FROM w.{key} AND s.pos = spot
"""
        return sql

    out += tree("a", "grp") + walk("a", "grp", "SELECT grp, doc_id, leaf, shown AS folded, '' AS proof, pos AS spot FROM placed")
    out += f"""), b0 AS MATERIALIZED (SELECT 1 AS one, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, node, grp FROM a{depth}
"""
    out += tree("b", "one") + walk("b", "one", f"SELECT w.doc_id, w.leaf, w.folded, w.proof, b.node AS subroot, b.pos AS spot, 1 AS one FROM aw{depth} w JOIN b0 b ON b.grp IS NOT DISTINCT FROM w.grp")
    return out + f""")
SELECT doc_id, leaf, subroot, b.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.node AS verified FROM bw{depth} w, b{depth} b
"""


ORACLE_SQL = _oracle()
