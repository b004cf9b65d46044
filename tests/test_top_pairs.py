from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kilnspark.operators import similarity


def _files(spark, copies):
    words = [" ".join(f"{'abcdefgh'[i]}{j:02d}" for j in range(40)) for i in range(3)]
    texts = [w for w in words for _ in range(copies)] + [words[0] + " more", words[0] + " more or less", "nothing alike at all", "", None]
    return spark.createDataFrame(list(enumerate(texts)), "path long, content string")


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_top_pairs_are_those_of_all_pairs(spark, copies):
    files = _files(spark, copies)
    top = [tuple(r) for r in similarity.top_similar_pairs(files, 6).collect()]
    assert top == [tuple(r) for r in similarity.top_pairs(similarity.similar_pairs(files), 6).collect()]
    assert ("near" in {r[3] for r in top}) == (copies < 5)


def test_near_pairs_are_not_built_behind_enough_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "jaccard_pairs", None)
    assert [r.kind for r in similarity.top_similar_pairs(_files(spark, 4), 9).collect()] == ["exact"] * 9


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_shingles_by_ranges_are_those_that_several_sets_have(spark, monkeypatch, kind):
    from collections import Counter

    monkeypatch.setattr(similarity, "RANGE_SHINGLES", 7)
    sets = similarity.shingle_classes(_files(spark, 2).withColumn("path", F.col("path").cast(kind)))
    rows = [(r.path, r.n, h) for r in sets.collect() for h in r.hashes]
    df = Counter(h for _, _, h in rows)
    found = similarity.shared_shingles(sets)
    assert sorted(map(tuple, found.collect())) == sorted((p, n, h, df[h]) for p, n, h in rows if df[h] > 1)
    assert similarity.shared_shingles(sets.where("n < 0")).isEmpty()
    # shingles move once: no join and no second reading of the sets
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
