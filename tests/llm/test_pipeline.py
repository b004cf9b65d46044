from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from kilnspark.llm import language_id, packing, quality
from kilnspark.llm.common import table

from .helpers import ENGLISH, GERMAN, frame, with_clashes
from .test_near_dedup import brute as near_brute
from .test_tokens import held


def survivors(docs, labels, spark):
    """doc_id and text of what four plain passes over all documents keep, in doc_id order."""
    x = {r.doc_id: np.array(quality.statistics(r.text)) for r in docs}
    taught = [(x[r.doc_id], r.quality) for r in labels if r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    classes = []
    for label in (0, 1):
        own = np.array([v for v, y in taught if y == label])
        classes.append(quality.Gaussian.fitted(len(own), len(taught), own.sum(axis=0), own.T @ own, quality.SHRINKAGE, quality.RIDGE))
    gap = {i: float(classes[1].log_density(v[None])[0] - classes[0].log_density(v[None])[0]) for i, v in x.items()}
    docs = [r for r in docs if gap[r.doc_id] >= 0]

    field = language_id.train(language_id.training_sample(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in docs], "doc_id long, text string, lang string")))
    labeller, kept = language_id.Labeller(field), []
    for r in docs:
        words = language_id.words_of(r.text)
        if words and labeller.label([words], False)[0][0].max() / len(words) >= language_id.LEAST_SCORE:
            kept.append(r)

    best = {}
    for r in sorted(kept, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), r)
    rows = sorted((r.doc_id, r.text, r.lang) for r in best.values())
    heads = {i for i, _, head in near_brute(rows, 5, 80) if i == head}
    return [(i, t) for i, t, _ in rows if i in heads]


def test_run_equals_plain_passes(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").collect(), table(spark, sf_dir, "labels").collect()
    want = survivors(docs, labels, spark)
    assert 0 < len(want) < len(docs)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    own = packing.WordTokens(P.path("word_bpe_49k.json"))
    assert {r.doc_id for r in got} == {i for i, _ in want}
    for doc_id, text in want:
        ids = own.encode(text)
        at = 0
        for r in sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at * 4 : (at + r.length) * 4]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert at * 4 == len(ids)
    assert held(got, 4096)[1] <= 0.01 * sum(r.length for r in got)


def test_filter_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_clean_documents_stay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    clean = docs.join(good, "doc_id")
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir).join(good, "doc_id").count()
    assert kept >= 0.97 * clean.count()
    assert corpus_pipeline.language_stage(spark, docs, sf_dir).join(good, "doc_id").count() >= 0.99 * clean.count()


def tables(spark, folder, rows):
    """documents with odd rows and clashing columns, and labels that teach both classes."""
    docs = with_clashes(frame(spark, rows))
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i, *_ in rows if i is not None and 300 <= i < 360] + [(i, 0) for i, *_ in rows if i is not None and 400 <= i < 440]
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("doc_id", "quality", "0 AS toxic").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_and_clashing_columns_go_through(spark, tmp_path):
    rng = np.random.default_rng(4)
    shuffled = lambda text, i: " ".join(np.random.default_rng(i).permutation(text.split() * 3))
    good = [(300 + i, f"{shuffled(ENGLISH, i)}. {shuffled(ENGLISH, i + 99)}.", "en") for i in range(30)] + [(330 + i, f"{shuffled(GERMAN, i)}. {shuffled(GERMAN, i + 99)}.", "de") for i in range(30)]
    bad = [(400 + i, "$$ ## 11 @@ " * int(rng.integers(3, 30)), "en") for i in range(40)]
    twin = good[0][1]
    extra = [(None, twin, "en"), (None, f"{shuffled(ENGLISH, 777)}. so it is.", "en"), (301, twin, "en"), (None, "$$ ## 11 @@ " * 9, None), (None, None, None), (500, "", "en"), good[5], good[5]]
    folder = tables(spark, tmp_path / "t", good + bad + extra)
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = {r.doc_id for r in pieces}
    assert {i for i, *_ in good} - {300} <= docs and not docs & {i for i, *_ in bad} and None in docs
    assert sum(r.doc_tokens for r in pieces if r.doc_id == 305 and r.start == 0) == len(packing.WordTokens(P.path("word_bpe_49k.json")).encode(good[5][1])) // 4
    held(pieces, packing.WINDOW)


def test_empty_tables_go_through(spark, tmp_path):
    folder = tables(spark, tmp_path / "t", [])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and "sequence_id" in out.columns
