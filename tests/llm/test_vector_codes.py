from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnspark.llm import vector_codes as vc

from .helpers import with_clashes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, parts, entries, rounds):
    """Plain lists and Python integers of any size."""
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    find = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(find(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [find(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def whole(spark, df, **given):
    rows, books = vc.compress(df, **given)
    rows = vc.with_group_sum(vc.materialize(rows, "test-codes"), "label", "error", "label_error")
    return sorted(((r.vec_id, r.c, r.error, r.label_error, vc.digest_of(books)) for r in rows.withColumn("c", F.lower(F.hex("code"))).collect()), key=str)


def test_screen_keeps_the_nearest_of_large_and_tied_numbers():
    rng = np.random.default_rng(5)
    for size, top in ((8, 1 << 28), (16, 1 << 12), (1, 3), (64, 1 << 26)):
        book = rng.integers(-top, top, (60, size))
        book[30:40] = book[10:20]
        parts = np.vstack([book[rng.integers(0, 60, 200)] + rng.integers(-2, 3, (200, size)), rng.integers(-top, top, (100, size)), (book[5:6] + book[6:7]) // 2])
        want = [min((sum(int(a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(book)) for p in parts]
        index, error = vc.nearest(parts, book)
        assert list(zip(error.tolist(), index.tolist(), strict=True)) == want


def test_screen_leaves_out_most_entries():
    rng = np.random.default_rng(6)
    rows, _ = vc.screened(rng.integers(-500, 500, (100, 16)), rng.integers(-500, 500, (256, 16)))
    assert len(rows) < 120


def test_as_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)], int(rng.integers(0, 3)) if i % 5 else None) for i in rng.permutation(70)]
    rows += [(3, rows[0][1], 1), (3, rows[0][1], 1), (None, rows[4][1], None), (200, None, 1), (201, [None] + [0.0] * 7, 1), (202, [math.nan] * 8, 2), (203, [math.inf] + [0.0] * 7, None), (204, [-0.0001] * 8, 2)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "topic"))
    for entries, rounds in ((12, 3), (256, 2)):
        assert whole(spark, df, label_col="topic", entries=entries, rounds=rounds) == brute(rows, 4, entries, rounds)


def test_hot_label_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vc, "HOT_SHARE", 4)
    rows = [(i, [i / 7] * 4, None if i % 2 else i) for i in range(40)]
    assert whole(spark, spark.createDataFrame(rows, SCHEMA), entries=6, rounds=2) == brute(rows, 4, 6, 2)


def test_no_rows_other_lengths_and_huge_components(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whole(spark, empty) == []
    rows = [(i, [float(i)] * 4, 0) for i in range(5)] + [(9, [1.0] * 3, 0), (10, [], 0), (11, [3e38] * 4, None)]
    got = whole(spark, spark.createDataFrame(rows, SCHEMA), entries=8)
    assert [(g[0], g[1], g[3]) for g in got if g[0] > 8] == [(10, None, 0), (11, None, None), (9, None, 0)]
    assert [g[:4] for g in got if g[0] < 9] == [(i, f"0{i}" * 4, 0, 0) for i in range(5)]
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))


def test_the_query_reads_its_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").where("vec_id % 4 = 0").collect()]
    got = whole(spark, spark.createDataFrame(rows, SCHEMA), entries=16, rounds=2)
    assert got == brute(rows, 4, 16, 2)
