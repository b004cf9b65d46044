"""MinHash near-dedup with min-max hashing, exact verification and connected classes.

A document is its set of distinct word shingles. Each permutation gives two values of
a signature, the least and the greatest hash, so half as many hash evaluations make a
signature of the same length. Bands of the signature are bucket keys. Equal sets are
one node from the start, so copies never meet in a bucket.

Within a bucket no list of pairs is built. First every member is compared with the
bucket's pivot, the member that stands in the fullest buckets; that is linear in the
bucket. Buckets whose members are then still in several classes go to blocks: every
such node lives in one block of about BLOCK residents or BLOCK_HASHES hashes, and the nodes outside a
bucket's largest class visit the blocks of the bucket's members, where whole sets are
compared and only links that join two classes come out. So all candidates that share
a band are compared unless they are known to be in one class already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, digested, forget, fresh, map_batches, materialize, table, text_digest, without

#: Values and bands of a signature: a pair at 0.8 is missed with probability (1 - 0.8^6)^38, under 1e-5.
ROWS, BANDS = 6, 38
#: Most residents and visitors of a block, and hashes in the sets of either (8 bytes each; one larger set is a block's own).
BLOCK, VISITORS, BLOCK_HASHES = 1024, 4096, 4_000_000
#: Words whose hashes a worker remembers.
MEMO = 150_000
SEED = 20
_MASK = (1 << 64) - 1


class Shingles:
    """64-bit hashes of the distinct k-word shingles of a text; words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self, k: int):
        import xxhash

        self.k, self.hash, self.memo = k, xxhash.xxh64_intdigest, {}
        self.odd = np.random.default_rng(SEED).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        try:
            hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = self.hash(w)
            hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ hashes[i : len(hashes) - k + 1 + i]) * self.odd[i]
            out ^= out >> np.uint64(29)
        return np.unique(out)


class MinMax:
    """Band keys of a set's min-max signature."""

    def __init__(self, rows: int, bands: int):
        rng = np.random.default_rng(SEED + 1)
        self.rows, self.bands, n = rows, bands, -(-rows * bands // 2)
        self.odd = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Each permutation's min and max side by side, the max complemented so that both are minima."""
        out = np.empty(2 * len(self.odd), np.uint64)
        folded = shingles ^ (shingles >> np.uint64(32))
        for at in range(0, len(self.odd), 8):
            h = folded[None, :] * self.odd[at : at + 8, None] + self.add[at : at + 8, None]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out[2 * at : 2 * at + 16 : 2] = h.min(axis=1)
            out[2 * at + 1 : 2 * at + 17 : 2] = ~h.max(axis=1)
        return out

    def keys(self, shingles: np.ndarray) -> list[int]:
        values = self.signature(shingles)[: self.rows * self.bands]
        # a permutation's min and max go to bands far apart
        grid = np.concatenate([values[0::2], values[1::2]])[: self.rows * self.bands].reshape(self.bands, self.rows)
        keys = (np.arange(self.bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(self.rows):
            keys = (keys ^ grid[:, i]) * self.mix[i]
            keys ^= keys >> np.uint64(32)
        return keys.view(np.int64).tolist()


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n (size of the set), skey (128-bit digest of the set) and bands; a digest of the text goes along."""
    more = docs.columns[2:]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, minmax = Shingles(k), MinMax(rows, bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few, n, skey, keys = batch.slice(at, 256), [], [], []
                for text in few.column(1).to_pylist():
                    s = shingles.of(text)
                    n.append(len(s))
                    skey.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                    keys.append(minmax.keys(s) if len(s) else [])
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(n, pa.int64()), pa.array(skey, pa.string()), pa.array(keys, pa.list_(pa.int64())), *few.columns[2:]], names=["doc_id", "n", "skey", "bands", *more])

    return map_batches(docs, run, f"doc_id {id_type}, n long, skey string, bands array<long>" + "".join(f", {c} binary" for c in more))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """skey and shingles (sorted 64-bit hashes) of each row that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingles(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [s for s in map(shingles.of, batch.slice(at, 256).column(0).to_pylist()) if len(s)]
                if sets:
                    values = pa.array(np.concatenate(sets).view(np.int64))
                    ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.ListArray.from_arrays(ends, values)], names=["skey", "shingles"])

    return map_batches(docs, run, "skey string, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """uid and label (the class's least uid) of every node of edges(a, b), by alternating large and small stars.

    Each round is two joins and writes its edges to the shared folder; the rounds end
    when every edge leads straight to the least node.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        after = materialize(small, "edges")
        # done when no node has two parents and no parent has a parent
        open_ends = after.groupBy("u").agg(F.count("*").alias("parents")).where("parents > 1").limit(1).count() or after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        forget(now)
        now = after
        if not open_ends:
            break
    return now.select(F.col("u").alias("uid"), F.col("v").alias("label")).union(now.select(F.col("v").alias("uid"), F.col("v").alias("label")).distinct())


def linked(a_n: int, b_n: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a_n + b_n - both)


def _block_links(residents: list[tuple[int, int, np.ndarray]], visitors: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links (visitor, resident) between different classes, one for each pair of classes that a visitor joins."""
    sizes = np.array([len(s) for _, _, s in residents])
    flat = np.concatenate([s for _, _, s in residents])
    owner = np.repeat(np.arange(len(residents)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    labels = np.array([x for _, x, _ in residents])
    links = []
    for uid, label, s in visitors:
        left, right = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        runs = right - left
        total = int(runs.sum())
        if not total:
            continue
        at = np.repeat(left - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(residents))
        hits = np.flatnonzero((100 * shared >= percent * (sizes + len(s) - shared)) & (labels != label))
        for i in hits[np.unique(labels[hits], return_index=True)[1]]:
            links.append((uid, residents[i][0]))
    return links


def near_links(nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """uid and label for every node of nodes(uid, skey, rep, n, bands) that has a link; None if none has."""
    spark = nodes.sparkSession
    rows = nodes.where("n > 0").select("uid", "n", F.explode("bands").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("hashes")).where("size > 1")
    members = materialize(rows.join(full, "key"), "members")
    if members.isEmpty():
        return None
    central = members.groupBy("uid").agg(F.sum("size").alias("central"))
    pivots = members.join(central, "uid").groupBy("key").agg(F.max(F.struct("central", F.col("uid").alias("pivot"), F.col("n").alias("pivot_n"))).alias("p")).select("key", "p.pivot", "p.pivot_n")
    members = materialize(members.join(pivots, "key"), "pivoted")

    # whole sets of the nodes that share a bucket, from one document of each
    wanted = nodes.join(members.select("uid").distinct(), "uid", "left_semi").select("uid", "skey", "rep")
    wanted = materialize(wanted, "wanted")
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(broadcast_if_small(reps), docs["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").select("text")
    sets = materialize(shingle_sets(texts, k).join(wanted.select("uid", "skey"), "skey").groupBy("uid").agg(F.first("shingles").alias("shingles")), "sets")

    close = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    pairs = members.where((F.col("uid") != F.col("pivot")) & close).select(F.col("uid").alias("a"), F.col("pivot").alias("b")).distinct()
    shared = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared))
        .select("a", "b")
    )
    classes = components(links)
    placed = materialize(members.join(classes, "uid", "left").withColumn("label", F.coalesce("label", "uid")), "placed")

    # buckets whose members, the compared pivot aside, are in several classes
    apart = placed.where("uid <> pivot").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = materialize(placed.join(apart, "key").select("key", "uid", "label", "size", "hashes", "n"), "rest")
    if rest.isEmpty():
        return classes
    largest = rest.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("largest"))
    home = rest.groupBy("uid", "label").agg(F.max(F.struct("size", "key", "hashes")).alias("h"))
    block = F.concat_ws("-", F.col("h.key"), F.pmod(F.xxhash64("uid"), F.greatest(F.ceil(F.col("h.size") / BLOCK), F.ceil(F.col("h.hashes") / BLOCK_HASHES))))
    home = materialize(home.select("uid", "label", block.alias("home")), "homes")
    homes = rest.join(home.select("uid", "home"), "uid").select("key", "home").distinct()
    visits = rest.join(largest, "key").where("label <> largest").select("key", "uid", "label", "n").join(homes, "key").select("uid", "label", "home", "n").distinct()
    visits = materialize(visits, "visits")
    parts = visits.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / VISITORS), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int").alias("parts"))
    guests = visits.join(parts, "home").select("uid", "label", "home", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("resident"))
    hosts = home.join(parts, "home").select("uid", "label", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("resident"))

    def compare(rows: pa.Table) -> pa.Table:
        cols = [rows.column(c).to_pylist() for c in ("uid", "label", "resident")]
        arrays = rows.column("shingles").combine_chunks()
        arrays = arrays.chunk(0) if isinstance(arrays, pa.ChunkedArray) else arrays
        offsets, values = arrays.offsets.to_numpy(), arrays.values.to_numpy().view(np.uint64)
        all_rows = [(u, x, r, values[offsets[i] : offsets[i + 1]]) for i, (u, x, r) in enumerate(zip(*cols, strict=True))]
        found = _block_links([(u, x, s) for u, x, r, s in all_rows if r], [(u, x, s) for u, x, r, s in all_rows if not r], percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    more = materialize(guests.union(hosts).join(sets, "uid").groupBy("home", "part").applyInArrow(compare, "a long, b long"), "more")
    if more.isEmpty():
        return classes
    return components(more.union(classes.select(F.col("uid").alias("a"), F.col("label").alias("b"))))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, digests: bool = False) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept (and digest, of its text).

    Documents are linked when 100 * shared >= percent * united shingles; component_id is
    the smallest doc_id reachable by links, and of each class one row is kept, the first
    read of those whose doc_id is that. Null or empty texts have no shingles, are linked
    with nothing and kept; texts with fewer than k words are one shingle. Rows that share
    a doc_id are kept or dropped by their own texts. A null doc_id is no smallest id; a
    class without any other id keeps the first of its rows. Other columns are not looked
    at; no rows give no rows.
    """
    docs = digested(docs, id_col, text_col, digests)
    signed = materialize(signatures(docs, k, rows, bands).withColumn("row", F.monotonically_increasing_id()), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("rep"), "row")
    nodes = signed.where("n > 0").groupBy("skey").agg(F.min(first).alias("head"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("skey", "head", F.col("head.rep").alias("rep"), "n", "bands").withColumn("uid", F.monotonically_increasing_id()), "nodes")
    classes = near_links(nodes, docs, k, percent)
    slim = nodes.select("uid", "skey", "head")
    if classes is None:
        named = slim.select("skey", "head")
    else:
        placed = slim.join(classes, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        heads = placed.groupBy("label").agg(F.min("head").alias("first"))
        named = placed.join(heads, "label").select("skey", F.col("first").alias("head"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "skey", "row", *(["digest"] if digests else [])).join(named.select("skey", F.col("head.rep").alias("component_id"), F.col("head.row").alias("kept_row")), "skey", "left")
    lead = F.when(F.col("skey").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("skey").isNull() | (F.col("row") == F.col("kept_row"))
    return out.select("doc_id", "n_shingles", lead.alias("component_id"), kept.alias("kept"), *(["digest"] if digests else []))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, one row of each class, with all their columns.

    Rows are known by doc_id and the digest of their text; of rows that share both, any one stays.
    """
    judged = near_dedup(docs, k=k, percent=percent, digests=True).groupBy("doc_id", "digest").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    dropped = materialize(judged.where("stay < rows").select("doc_id", "digest", (F.col("stay") > 0).alias("stays")), "dropped")
    out = without(docs, dropped, "gone")
    again = dropped.where("stays")
    if again.isEmpty():
        return out
    key, digest, own = (fresh(docs, c) for c in ("row_id", "row_digest", "own_digest"))
    again = broadcast_if_small(again.select(F.col("doc_id").alias(key), F.col("digest").alias(digest)))
    marked = docs.withColumn(own, text_digest(docs["text"]))
    same = marked.join(again, marked["doc_id"].eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)))
    return out.unionByName(same.groupBy(key, digest).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=2, percent=80)
