from __future__ import annotations

import random

import numpy as np

from kilnspark.llm import near_dedup

from .helpers import frame, odd_rows, with_clashes


def brute(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = [r[0] for r in rows]
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {(ids[i], len(sets[i]), least.get(root(i))) for i in range(len(rows))}


def mutated(seed, n):
    """A base text and copies with more and more words changed, so that links chain."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(60)] = f"m{rng.randrange(10**6)}"
        out.append((i + 100 * seed, " ".join(words), "en"))
    return out


def test_classes_match_brute_force(spark):
    rows = odd_rows() + [r for seed in range(1, 5) for r in mutated(seed, 40)]
    got = near_dedup.near_dedup(with_clashes(frame(spark, rows)), k=2).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_find_links_that_pivots_miss(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "VISITORS", 8)
    rows = mutated(7, 120)
    got = near_dedup.near_dedup(frame(spark, rows), k=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_signature_agreement_estimates_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    minmax = near_dedup.MinMax(6, 100)
    a, b = minmax.signature(base[:700]), minmax.signature(base[200:])
    assert abs(float((a == b).mean()) - 500 / 900) < 0.06


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.uid: r.label for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_survivors_and_empty(spark):
    docs = with_clashes(frame(spark, mutated(3, 20)))
    kept = near_dedup.survivors(docs, k=2)
    assert kept.columns == docs.columns
    assert kept.count() == near_dedup.near_dedup(docs, k=2).where("kept").count() < 20
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_blocks_bounded_by_their_hashes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 300)
    rows = mutated(7, 120)
    got = near_dedup.near_dedup(frame(spark, rows), k=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_all_links_of_the_table_are_found(spark, sf_dir):
    """Recall at sf0.01 by brute force over pairs that share a shingle."""
    from kilnspark.llm.common import table

    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text").collect()
    shingles = near_dedup.Shingles(2)
    sets = {r.doc_id: shingles.of(r.text) for r in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, links = {}, 0
    for i in sorted(sets):
        shared = {}
        for s in sets[i].tolist():
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        for j, both in shared.items():
            if near_dedup.linked(len(sets[i]), len(sets[j]), both, 80):
                links += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: r for r in near_dedup.op2_minhash_near_dedup(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    assert links > 100 and all(got[i].component_id == root(i) and got[i].n_shingles == len(sets[i]) for i in sets)
