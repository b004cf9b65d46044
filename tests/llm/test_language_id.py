from __future__ import annotations

import itertools
import zlib

import numpy as np

from kilnspark.llm import language_id
from kilnspark.llm.common import table

from .helpers import ENGLISH, GERMAN, frame, odd_rows, with_clashes


def test_held_out_accuracy(spark, sf_dir):
    got = language_id.op5_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(2)
    lengths, k = np.array([4, 3, 1]), 3
    chains = [rng.normal(size=(n, k)) for n in lengths]
    move = rng.normal(size=(k, k))
    laid = np.array([chains[i][t] for t in range(4) for i in range(3) if t < lengths[i]])
    post, off = {}, [0, 3, 5, 7]
    for rows, p, _ in language_id.forward_backward(laid, lengths, move):
        t = off.index(rows.start)
        for i, row in enumerate(p):
            post[i, t] = row
    for i, n in enumerate(lengths):
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            weight = np.exp(sum(chains[i][t][s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, s in enumerate(path):
                want[t, s] += weight
        want /= want.sum(axis=1, keepdims=True)
        for t in range(n):
            assert np.allclose(post[i, t], want[t])


def trained_rows():
    return [(i, " ".join(np.random.default_rng(i).permutation((ENGLISH if i % 2 else GERMAN).split())), "en" if i % 2 else "de") for i in range(100, 160)]


def test_switched_text_gets_spans(spark):
    rows = trained_rows() + [(1, ENGLISH + " " + GERMAN, None)]
    got = language_id.language_id(frame(spark, rows), spans=True).where("doc_id = 1").first()
    assert [s.lang for s in got.spans] == ["en", "de"] and sum(s.words for s in got.spans) == len(language_id.words_of(ENGLISH + " " + GERMAN))


def test_odd_rows(spark):
    rows = odd_rows() + trained_rows()
    got = {r.doc_id: r for r in language_id.language_id(with_clashes(frame(spark, rows))).collect()}
    assert {got[i].lang_pred for i in (3, 4, 5, 8)} == {"und"} and got[3].score == 0
    assert got[7].lang_pred == "en" and got[6].lang_pred == "de"
    assert language_id.language_id(frame(spark, [])).count() == 0
    alone = language_id.language_id(frame(spark, [(1, "text", None)])).first()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)
    docs = with_clashes(frame(spark, rows))
    assert language_id.survivors(docs).columns == docs.columns


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    def of(words):
        slots, starts = language_id.feature_slots(words)
        return [sorted(x.tolist()) for x in np.split(slots, starts[1:])]

    words = ["a", "the", "étre", "ab"]
    assert of(words) == [of([w])[0] for w in words]


def test_a_repeated_id_does_not_swell_the_sample(spark):
    rows = [(7, f"{ENGLISH} {i}", "en") for i in range(2000)] + [(7, ENGLISH, "en")] * 300 + [(8, GERMAN, "de")] * 400
    sample = language_id.training_sample(frame(spark, rows), per_lang=50)
    assert 25 <= sum(lang == "en" for lang, _ in sample) <= 50 and sum(lang == "de" for lang, _ in sample) == 1
    few = language_id.training_sample(frame(spark, rows), per_lang=50, points=1000)
    assert 1 <= len(few) and sum(len(t) for lang, t in few if lang == "en") <= 1000
    assert all(len(t) > 2 for _, t in few)


def test_the_gradient_is_that_of_the_likelihood():
    """Node and pair posteriors, as training uses them, against differences of the log-likelihood of one chain."""
    rng, k, n = np.random.default_rng(6), 3, 5
    scores, move, tags = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.integers(k, size=n)

    def likelihood(scores, move):
        paths = list(itertools.product(range(k), repeat=n))
        value = lambda p: sum(scores[t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))
        return value(tags) - np.log(np.sum(np.exp([value(p) for p in paths])))

    nodes, pairs = language_id.likelihood_gradient(scores, move, tags[:, None], 1)
    for at in np.ndindex(n, k):
        d = np.zeros_like(scores)
        d[at] = 1e-5
        assert abs((likelihood(scores + d, move) - likelihood(scores - d, move)) / 2e-5 - nodes[at]) < 1e-6
    for at in np.ndindex(k, k):
        d = np.zeros_like(move)
        d[at] = 1e-5
        assert abs((likelihood(scores, move + d) - likelihood(scores, move - d)) / 2e-5 - pairs[at]) < 1e-6
