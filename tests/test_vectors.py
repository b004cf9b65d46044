from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from kilnspark.operators import vectors as v


@pytest.fixture(scope="module")
def rows(spark):
    """Clusters, one of them with a third of all rows, copies, null and zero vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    out = [(i, (centres[0 if i % 3 == 0 else int(rng.integers(12))] + rng.normal(scale=0.4, size=16)).tolist(), f"l{i % 4}") for i in range(900)]
    out += [(1000, out[0][1], "l0"), (1001, out[0][1], "l1"), (1002, None, "l0"), (1003, [0.0] * 16, None)]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk long, embedding array<double>, label string")


def exact(rows, k, same_label=False):
    held = [(i, np.asarray(e), lab) for i, e, lab in rows if e is not None]
    unit = {i: e / max(np.linalg.norm(e), 1e-12) for i, e, _ in held}
    labels = {i: lab for i, _, lab in held}
    out = {}
    for i in (i for i in unit if i % 100 == 0):
        near = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in unit if j != i and (not same_label or (labels[i] is not None and labels[i] == labels[j])))
        out[i] = [j for _, j in near[:k]]
    return out


def grouped(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["place"])):
        out.setdefault(r["query"], []).append(r["chunk"])
    return out


def test_topk_and_matching_columns(frame, rows, monkeypatch):
    monkeypatch.setattr(v, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(v, "QUERY_BLOCK", 3)
    asked = frame.where("chunk % 100 = 0")
    assert grouped(v.cosine_topk(frame, asked, 5)) == exact(rows, 5)
    assert grouped(v.cosine_topk(frame, asked, 5, match=("label",))) == exact(rows, 5, True)


def test_inverted_lists_find_nine_in_ten(frame, rows, monkeypatch):
    monkeypatch.setattr(v, "VECTOR_BLOCK", 64)
    index, want = v.InvertedLists(frame), exact(rows, 8)
    assert index.lists.selectExpr("sum(size(v_ids)) AS n", "max(size(v_ids)) AS most").first()["n"] == 903
    asked = frame.where("chunk % 100 = 0")
    share = lambda probes: sum(len(set(want[q]) & set(got)) for q, got in grouped(index.search(asked, 8, probes)).items()) / sum(map(len, want.values()))
    assert share(10) >= 0.9
    assert grouped(index.search(asked, 8, len(index.centres))) == want
    assert share(index.tuned_probes(frame, asked, 8, 0.9)) >= 0.9


def test_given_vectors_are_found(spark):
    sf = "/root/testdata/sf0.01"
    from kilnspark.plans.structure import QUERIES

    want, got = grouped(QUERIES["vector_topk"](spark, sf)), grouped(QUERIES["vector_ann"](spark, sf))
    assert sum(len(set(want[q]) & set(got.get(q, []))) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_no_vectors(spark, frame):
    index = v.InvertedLists(frame.limit(0))
    assert index.search(frame.limit(5), 3).collect() == []
    assert v.InvertedLists(frame).search(frame.where("chunk = 1002"), 3).collect() == []


def test_marginal_relevance(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.14]), (2, [0.99, 0.14]), (3, [0.7, -0.7]), (4, [0.0, 1.0]), (5, None)], "chunk long, embedding array<double>")
    candidates = spark.createDataFrame([(0, c, s) for c, s in ((1, 0.99), (2, 0.99), (3, 0.7), (4, 0.0), (5, 0.5))], "query long, chunk long, cosine double")
    chosen = lambda k, weight: [r["chunk"] for r in sorted(v.marginal_relevance(candidates, vectors, k, weight).collect(), key=lambda r: r["place"])]
    assert chosen(3, 0.7) == [1, 2, 3]  # 2 is a copy of 1, but still worth 0.393 against 0.31
    assert chosen(3, 0.3) == [1, 4, 3]
    assert chosen(9, 1.0) == [1, 2, 3, 4]


def test_distances_to_cells_are_held_for_few_vectors(monkeypatch):
    """A batch of 3,000 vectors meets the cells 512 at a time, with the same cells as at once."""
    rng = np.random.default_rng(5)
    centres, rows, seen = v.unit(rng.normal(size=(40, 8))), rng.normal(size=(3000, 8)), []
    index = object.__new__(v.InvertedLists)
    index.centres = centres

    class Rows:
        schema = {c: type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "x")})}) for c in ("chunk", "embedding")}

        def mapInPandas(self, run, schema):
            return run

    real = v.unit
    monkeypatch.setattr(v, "unit", lambda x: seen.append(len(x)) or real(x))
    for probes in (1, 3):
        batch = pd.DataFrame({"chunk": range(3000), "embedding": list(rows)})
        out = pd.concat(index._assigned(Rows(), probes)(iter([batch])))
        assert out.cell.tolist() == np.argsort(-(real(rows) @ centres.T), axis=1, kind="stable")[:, :probes].ravel().tolist()
        assert out.chunk.tolist() == np.repeat(range(3000), probes).tolist()
    assert max(seen) == 512
