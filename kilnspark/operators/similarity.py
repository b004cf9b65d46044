"""Duplicate code: equal normalised contents, shingle Jaccard by a prefix-filtered
inverted index, repeated blocks of lines, and overlap with a second corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kilnspark.functions.tables import materialize

#: Tokens too common to tell files apart: fixed values.
STOP_TOKENS = [
    "the", "a", "an",
    "if", "else", "for", "while", "return", "def", "class",
    "function", "var", "let", "const", "import", "export",
    "public", "private", "static", "void", "int", "string",
    "self", "this", "true", "false", "null", "none",
    "0", "1", "2", "-1",
]
TOKEN = r"[a-z_][a-z0-9_]*|[0-9]+\.?[0-9]*|[+\-*/=<>!&|^~?:;,(){}\[\].]"
BLOCK_COMMENT, LINE_COMMENT, SPACES = r"(?s)/\*.*?\*/", r"//[^\n]*|#[^\n]*", r"\s+"


def normalized(content: Column) -> Column:
    """Without comments of either style, white space collapsed."""
    text = F.coalesce(content, F.lit(""))
    for pattern, to in ((BLOCK_COMMENT, ""), (LINE_COMMENT, ""), (SPACES, " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def tokens(content: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(content, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_TOKENS) & (F.length(t) > 1))


def shingles(toks: Column, k: int = 3) -> Column:
    """Distinct k-shingles; the distinct tokens where there are fewer than k."""
    n = F.size(toks)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, k), " ")))).otherwise(F.array_distinct(toks))


def shingled(files: DataFrame, k: int = 3) -> DataFrame:
    """path, toks, shingles, comments taken out first. Explode shingles with explode_outer: explode infers a filter
    that is pushed below and cuts the tokens anew for each shingle."""
    return files.select("path", tokens(normalized(F.col("content"))).alias("toks")).select("path", "toks", shingles(F.col("toks"), k).alias("shingles"))


def shingle_counts(files: DataFrame, k: int = 3) -> DataFrame:
    return shingled(files, k).select("path", F.size("toks").cast("long").alias("tokens"), F.size("shingles").cast("long").alias("shingles"))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Files that share their normalised content with another: class (least path) and class size.

    One aggregation by digest; members join their class, so no pairs are built. Digests
    are written, so that texts are normalised once.
    """
    rows = materialize(files.select("path", F.md5(normalized(F.col("content"))).alias("digest")), "digests")
    classes = rows.groupBy("digest").agg(F.min("path").alias("class_path"), F.count("*").alias("class_size")).where("class_size > 1")
    return rows.join(classes, "digest").select("path", "class_path", "class_size", "digest")


def hashed_sets(files: DataFrame, k: int = 3) -> DataFrame:
    """path, hashes: each file's set of k-shingles (or of its tokens, where they are fewer) as sorted 64-bit hashes; files without tokens have none.

    Texts are read once and go no further: a shingle is hashed from its tokens.
    """
    toks, n = F.col("toks"), F.size("toks")
    shingle = lambda i: F.xxhash64(*[F.element_at(toks, i + j) for j in range(k)])
    whole = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), shingle)
    found = F.when(n >= k, whole).otherwise(F.transform(toks, lambda t: F.xxhash64(t, F.lit("token"))))
    rows = files.select("path", tokens(normalized(F.col("content"))).alias("toks"))
    # a filter on the tokens would be pushed below and cut them twice
    return rows.select("path", F.explode(F.when(n > 0, F.array(F.array_sort(F.array_distinct(found))))).alias("hashes"))


def shingle_classes(files: DataFrame, k: int = 3) -> DataFrame:
    """path (the least of its class), members, n, hashes: files with equal sets are one class. A written table: one row for each class."""
    rows = hashed_sets(files, k).withColumn("digest", _digest())
    classes = rows.groupBy("digest").agg(F.min("path").alias("path"), F.count("*").alias("members"), F.first("hashes").alias("hashes"))
    return materialize(classes.select("path", "members", F.size("hashes").alias("n"), "hashes"), "shingle-classes")


def _digest():
    """128 bits of a set's hashes, from two seeds."""
    return F.concat_ws("-", F.xxhash64(F.lit(1), "hashes"), F.xxhash64(F.lit(2), "hashes"))


def class_members(files: DataFrame, k: int = 3) -> DataFrame:
    """path, class_path, members: the class of files with equal shingle sets that each file with tokens is in."""
    rows = materialize(hashed_sets(files, k).select("path", _digest().alias("digest")), "set-digests")
    classes = rows.groupBy("digest").agg(F.min("path").alias("class_path"), F.count("*").alias("members"))
    return rows.join(classes, "digest").select("path", "class_path", "members")


def _by_size(rows: DataFrame, key: str, threshold: float, *more: str) -> tuple[DataFrame, DataFrame]:
    """Two sides that meet on key and size: sets that can be so similar are at most one step of 1 / threshold apart, so a key that many sets share falls apart by their sizes."""
    step = F.floor(F.ln(F.col("n").cast("double")) / -math.log(threshold) + 1e-9) if threshold < 1 else F.col("n").cast("long")
    held = rows.select(F.col(key).alias("key"), step.alias("step"), "path", "n", *more)
    a = held.toDF("key", "step", "path_a", "na", *[f"{c}_a" for c in more])
    b = held.toDF("key", "own", "path_b", "nb", *[f"{c}_b" for c in more]).withColumn("step", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    return a, b


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """path_a, path_b, j of the pairs whose whole sets are so similar."""
    whole = sets.select("path", "hashes")
    joined = pairs.join(whole.toDF("path_a", "sa"), "path_a").join(whole.toDF("path_b", "sb"), "path_b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return joined.select("path_a", "path_b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("j")).where(F.col("j") >= threshold - 1e-9)


#: Shingles of one range, and sets whose shingles are dealt to ranges at once.
RANGE_SHINGLES, SETS_AT_ONCE = 500_000, 1024


def shared_shingles(sets: DataFrame) -> DataFrame:
    """path, n, shingle, df: the shingles that several sets have, and how many.

    Shingles fall into as many ranges of hashes as they need, and move as arrays with
    their sets; within a range equal ones are found by sorting. So all shingles move
    once, and a task holds one range, and what sets share of a shingle in it.
    """
    ranges = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // RANGE_SHINGLES))
    of = {c: to_arrow_type(sets.schema[c].dataType) for c in ("path", "n")}
    kind = {c: sets.schema[c].dataType.simpleString() for c in of}
    packed = pa.schema([("range", pa.int32()), ("path", pa.list_(of["path"])), ("n", pa.list_(of["n"])), ("hashes", pa.list_(pa.int64()))])
    found = pa.schema([("path", of["path"]), ("n", of["n"]), ("shingle", pa.int64()), ("df", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SETS_AT_ONCE):
                some = batch.slice(at, SETS_AT_ONCE)
                values = some.column(2).flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(some.num_rows), some.column(2).value_lengths().to_numpy(zero_copy_only=False))
                place = ((values.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order, counts = np.argsort(place, kind="stable"), np.bincount(place, minlength=ranges)
                used = np.flatnonzero(counts)
                offsets, owners = pa.array(np.append(0, np.cumsum(counts[used])).astype(np.int32)), pa.array(owner[order])
                columns = [some.column(0).take(owners), some.column(1).take(owners), pa.array(values[order])]
                yield pa.record_batch([pa.array(used.astype(np.int32)), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], schema=packed)

    def count(table: pa.Table) -> pa.Table:
        path, n, hashes = (pa.concat_arrays([x.flatten() for x in table.column(c).chunks]) for c in ("path", "n", "hashes"))
        values = hashes.to_numpy(zero_copy_only=False)
        order = np.argsort(values, kind="stable")
        values = values[order]
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        df = np.diff(np.append(starts, len(values)))
        df = np.repeat(df, df)
        many = df > 1
        at = pa.array(order[many])
        return pa.table([path.take(at), n.take(at), pa.array(values[many]), pa.array(df[many])], schema=found)

    dealt = sets.select("path", "n", "hashes").mapInArrow(deal, f"range int, path array<{kind['path']}>, n array<{kind['n']}>, hashes array<long>")
    return dealt.groupBy("range").applyInArrow(count, f"path {kind['path']}, n {kind['n']}, shingle long, df long")


def jaccard_pairs(files: DataFrame, threshold: float = 0.7, k: int = 3) -> DataFrame:
    """Pairs of classes of equal sets with Jaccard of threshold or more.

    Sets that overlap so much share one of their rarest shingles: with sets ordered by
    document frequency, the first n - ceil(threshold n) + 1 of each suffice. Only those
    meet, where sizes and what is left behind the shared place still allow the overlap.
    Candidates are verified on whole sets, so none is lost. Sets are written once.
    """
    sets = shingle_classes(files, k)
    shared = shared_shingles(sets)  # a set's other shingles are rarer than all of these: they are only counted
    of_path = Window.partitionBy("path")
    rank = F.row_number().over(of_path.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(of_path)
    prefix = shared.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    a, b = _by_size(materialize(prefix.select("path", "n", "shingle", "r"), "prefix"), "shingle", threshold, "r")
    least = threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    possible = (F.col("path_a") < F.col("path_b")) & (F.least(F.col("na") - F.col("r_a"), F.col("nb") - F.col("r_b")) + 1 >= least) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    candidates = a.join(b, ["key", "step"]).where(possible).select("path_a", "path_b").distinct()
    return _alike(candidates, sets, threshold).select("path_a", "path_b", F.round("j", 4).alias("similarity"))


def normalized_line(line: Column) -> Column:
    """Without inline comments and outer white space, in lower case."""
    return F.lower(F.trim(F.regexp_replace(line, r"#.*|//.*", ""), F.lit(" \t\r")))


def repeated_blocks(files: DataFrame, size: int = 8) -> DataFrame:
    """Blocks of non-blank lines, alike once normalized, whose second place in a file is at least a block after the first.

    Windows are slices within the row; only digests leave it.
    """
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")
    rows = files.select("path", F.transform(lines, normalized_line).alias("lines")).where(F.size("lines") >= 2 * size)
    starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - size + 1, F.lit(1)))
    blocks = rows.select("path", F.posexplode(F.transform(starts, lambda i: F.md5(F.array_join(F.slice("lines", i, size), "\n")))).alias("at", "digest"))
    keyed = blocks.groupBy("path", "digest").agg(F.count("*").alias("occurrences"), F.slice(F.array_sort(F.collect_list("at")), 1, 2).alias("first"))
    keyed = keyed.where(F.col("occurrences") > 1).select("path", "digest", "occurrences", F.col("first")[0].cast("long").alias("first_at"), F.col("first")[1].cast("long").alias("second_at"))
    return keyed.where(F.col("second_at") - F.col("first_at") >= size)


def duplicate_windows(files: DataFrame, size: int = 4, least: int = 4) -> DataFrame:
    """path, digest, occurrences, first_line, second_line: windows of so many lines that a file has more than once, blank lines and overlaps included.

    Lines count from 1 and are compared without comments, with white space collapsed; a
    window needs lines of at least `least` characters in half of its places. Files
    shorter than two windows have none, null contents neither. All windows are given,
    with their first two places.
    """
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "#.*", ""), "//.*", ""), "[ \\t\\r]+", " "))
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"\n\z", "")
    rows = files.select("path", F.transform(F.split(text, "\n"), bare).alias("lines")).where(F.size("lines") >= 2 * size)
    starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - size + 1, F.lit(1)))
    window = lambda i: F.slice("lines", i, size)
    full = lambda i: F.size(F.filter(window(i), lambda x: F.length(x) >= least)) >= size // 2
    blocks = rows.select("path", F.explode(F.transform(F.filter(starts, full), lambda i: F.struct(i.alias("at"), F.md5(F.array_join(window(i), "\n")).alias("digest")))).alias("b"))
    keyed = blocks.groupBy("path", "b.digest").agg(F.count("*").alias("occurrences"), F.slice(F.array_sort(F.collect_list("b.at")), 1, 2).alias("first"))
    return keyed.where("occurrences > 1").select("path", "digest", "occurrences", F.col("first")[0].cast("long").alias("first_line"), F.col("first")[1].cast("long").alias("second_line"))


def benchmark_overlap(files: DataFrame, items: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """Items of a second corpus of which a file holds at least a part of the distinct shingles.

    Item shingles are rare and few; files meet them by an equi-join on the shingle.
    """
    mine = shingled(files, k).select("path", F.explode_outer("shingles").alias("shingle"))
    theirs = shingled(items, k).select(F.col("path").alias("item"), F.size("shingles").cast("long").alias("n"), F.explode_outer("shingles").alias("shingle"))
    hits = mine.join(theirs, "shingle").groupBy("path", "item", "n").agg(F.count("*").alias("shared"))
    return hits.where(F.col("shared") >= least * F.col("n")).select("path", "item", "shared", F.round(F.col("shared") / F.col("n"), 4).alias("containment"))


def duplicate_report(files: DataFrame) -> DataFrame:
    """Files, duplicated files, their ratio, classes and the characters that one copy each would save."""
    rows = files.select("path", F.md5(normalized(F.col("content"))).alias("digest"), F.length("content").cast("long").alias("chars"))
    classes = rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))
    many = F.col("n") > 1
    return classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("duplicated"), F.count_if(many).alias("classes"), F.coalesce(F.sum(F.when(many, F.col("chars") - F.col("longest"))), F.lit(0)).alias("saved_chars"), F.coalesce(F.round(F.sum(F.when(many, F.col("n")).otherwise(0)) * 100 / F.sum("n"), 2), F.lit(0.0)).alias("duplicate_ratio"))


#: Hash functions of a signature and their bands, as 32 bands of 4: fixed values.
SIGNATURE, BAND = 128, 4


def signatures(sets: DataFrame, hashes: int = SIGNATURE) -> DataFrame:
    """path, n, signature: for each of so many hash functions the least hash of a set's shingles (long); sets are not empty.

    The functions are hashes (xxhash64) of the shingle's hash and their number, taken for all of a set's shingles at once.
    """
    names = pa.schema([("path", to_arrow_type(sets.schema["path"].dataType)), ("n", to_arrow_type(sets.schema["n"].dataType)), ("signature", pa.list_(pa.int64()))])

    numbers = np.arange(1, hashes + 1, dtype=np.uint64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, signed = batch.column(2), np.empty((batch.num_rows, hashes), np.int64)
            for at in range(batch.num_rows):
                seeds = _rehashed(held[at].values.to_numpy(zero_copy_only=False))
                parts = [_numbered(seeds[i : i + SHINGLES_AT_ONCE], numbers).view(np.int64).min(axis=1) for i in range(0, len(seeds), SHINGLES_AT_ONCE)]
                signed[at] = parts[0] if len(parts) == 1 else np.min(parts, axis=0)
            offsets = pa.array(np.arange(0, signed.size + 1, hashes, dtype=np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(signed.ravel()))], schema=names)

    kind = sets.schema["path"].dataType.simpleString()
    return sets.select("path", "n", "hashes").mapInArrow(run, f"path {kind}, n {sets.schema['n'].dataType.simpleString()}, signature array<long>")


#: Shingles that meet all hash functions at once.
SHINGLES_AT_ONCE = 512
#: The primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x


def _rehashed(values: np.ndarray) -> np.ndarray:
    """xxhash64 of each long, with Spark's seed 42."""
    start = np.array([42], np.uint64) + _P5 + np.uint64(8)
    x = start ^ (_turned(values.view(np.uint64) * _P2, 31) * _P1)
    return _mixed(_turned(x, 27) * _P1 + _P4)


def _numbered(seeds: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """xxhash64 of small whole numbers (rows) with each of the seeds: with _rehashed, what xxhash64(h, number) is in Spark."""
    x = (seeds + _P5 + np.uint64(4)) ^ (numbers * _P1)
    x = _turned(x, 23)
    x *= _P2
    x += _P3
    return _mixed(x)


def lsh_pairs(files: DataFrame, threshold: float = 0.7, k: int = 3, hashes: int = SIGNATURE, band: int = BAND) -> DataFrame:
    """Pairs of classes of equal sets that share a band, with estimated and exact similarity; those of threshold or more by the exact one.

    A pair at similarity s is missed with probability (1 - s^4)^32: under 0.0001 at 0.7.
    Sets and signatures are written once; members of a band meet by size.
    """
    sets = shingle_classes(files, k)
    signed = materialize(signatures(sets, hashes), "signatures")
    bands = F.transform(F.sequence(F.lit(0), F.lit(hashes // band - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * band + 1, band)))
    rows = signed.select("path", "n", F.explode(bands).alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    a, b = _by_size(materialize(rows.join(shared, "band"), "bands"), "band", threshold)
    possible = (F.col("path_a") < F.col("path_b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    pairs = a.join(b, ["key", "step"]).where(possible).select("path_a", "path_b").distinct()
    alike = _alike(pairs, sets, threshold)
    both = alike.join(signed.select(F.col("path").alias("path_a"), F.col("signature").alias("ga")), "path_a").join(signed.select(F.col("path").alias("path_b"), F.col("signature").alias("gb")), "path_b")
    equal = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x: x)) / hashes
    return both.select("path_a", "path_b", F.round(equal, 4).alias("estimate"), F.round("j", 4).alias("similarity"))


def similar_pairs(files: DataFrame, threshold: float = 0.7, k: int = 3) -> DataFrame:
    """path_a, path_b, similarity, kind: each exact copy with the least of its class, and pairs that are near but not exact.

    Copies are pairs with their class, not with each other, so that a large class is as many rows as it has files.
    """
    return copy_pairs(files).union(near_pairs(files, threshold, k))


def copy_pairs(files: DataFrame) -> DataFrame:
    return exact_duplicates(files).where("path <> class_path").select(F.col("class_path").alias("path_a"), F.col("path").alias("path_b"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind"))


def near_pairs(files: DataFrame, threshold: float = 0.7, k: int = 3) -> DataFrame:
    return jaccard_pairs(files, threshold, k).where("similarity < 1").select("path_a", "path_b", "similarity", F.lit("near").alias("kind"))


def top_pairs(pairs: DataFrame, most: int = 50) -> DataFrame:
    """The most similar pairs."""
    return pairs.orderBy(F.desc("similarity"), "path_a", "path_b").limit(most)


def top_similar_pairs(files: DataFrame, most: int = 50, threshold: float = 0.7, k: int = 3) -> DataFrame:
    """The same rows as the top of `similar_pairs`.

    Copies of all files have similarity 1 and near pairs less, so that near pairs come
    after all copies: they are looked for only where copies are fewer than `most`.
    """
    copies = materialize(top_pairs(copy_pairs(files), most), "top-copies")
    return top_pairs(copies if copies.count() >= most else copies.union(near_pairs(files, threshold, k)), most)


def top_similar_files(pairs: DataFrame, most: int = 10) -> DataFrame:
    """path, pairs, highest: the files in most pairs."""
    ends = pairs.select("similarity", F.explode(F.array("path_a", "path_b")).alias("path"))
    return ends.groupBy("path").agg(F.count("*").alias("pairs"), F.max("similarity").alias("highest")).orderBy(F.desc("pairs"), "path").limit(most)


def compare_two(files: DataFrame, path_a, path_b, k: int = 3) -> DataFrame:
    """Similarity of two files and whether their normalized contents are the same; 1 for two without shingles, 0 for one without."""
    rows = files.where(F.col("path").isin(path_a, path_b)).select("path", tokens(normalized(F.col("content"))).alias("toks"), F.md5(normalized(F.col("content"))).alias("digest")).select("path", shingles(F.col("toks"), k).alias("s"), "digest")
    one = rows.agg(*[F.first(F.when(F.col("path") == p, F.col(c)), ignorenulls=True).alias(f"{c}_{n}") for n, p in (("a", path_a), ("b", path_b)) for c in ("s", "digest")])
    common, union = F.size(F.array_intersect("s_a", "s_b")), F.size(F.array_union("s_a", "s_b"))
    return one.select(F.lit(path_a).alias("path_a"), F.lit(path_b).alias("path_b"), F.coalesce(F.round(F.try_divide(common, union), 4), F.lit(1.0)).alias("similarity"), (F.col("digest_a") == F.col("digest_b")).alias("identical"))
