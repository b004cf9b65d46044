"""Rows whose doc_id is null or repeated stay or go by their own texts."""

from __future__ import annotations

from kilnspark.llm import exact_dedup, language_id, near_dedup, quality

from .helpers import ENGLISH, GERMAN, frame, with_clashes

WORDS = [f"w{i}" for i in range(40)]
TEXT, NEAR, OTHER = " ".join(WORDS), " ".join([*WORDS[:-1], "end"]), " ".join(f"v{i}" for i in range(40))


def texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_near_copies_leave_one_row_of_each_class(spark):
    rows = [(1, TEXT, "en"), (None, NEAR, "en"), (None, OTHER, "en"), (5, TEXT + " x", "en"), (5, "alone here", "en"), (None, "", "en"), (None, None, "en")]
    assert texts(near_dedup.survivors(with_clashes(frame(spark, rows)))) == [(False, 1, TEXT), (False, 5, "alone here"), (True, 0, ""), (True, 0, ""), (True, 0, OTHER)]


def test_copies_that_share_the_least_id_leave_one_row(spark):
    for i in (3, None):
        rows = [(i, TEXT, "en"), (i, NEAR, "en"), (i, NEAR, "de"), (i, OTHER, "en"), (i, OTHER, "en")]
        docs = with_clashes(frame(spark, rows))
        assert near_dedup.near_dedup(docs).where("kept").count() == 2
        kept = near_dedup.survivors(docs)
        assert kept.columns == docs.columns
        left = [r.text for r in kept.collect()]
        assert len(left) == 2 and OTHER in left and set(left) - {OTHER} <= {TEXT, NEAR}


def test_a_rejected_text_takes_no_clean_row_with_it(spark):
    rows = [(i, ENGLISH + f" {i}", "en") for i in range(20)] + [(100 + i, GERMAN + f" {i}", "de") for i in range(20)]
    docs = with_clashes(frame(spark, rows + [(None, "12 34 !!", None), (None, ENGLISH, None), (7, "5 5 5", None)]))
    kept = language_id.survivors(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").select("text").collect() == [(ENGLISH,)]
    assert kept.where("doc_id = 7").count() == 1 and kept.count() == 41


def test_quality_judges_rows_by_text(spark):
    good = [(i, f"{ENGLISH}. {GERMAN}. {i}", "en") for i in range(30)]
    bad = [(100 + i, "$$ ## @@ 11 $$ ## " * (5 + i % 7), "en") for i in range(30)]
    docs = with_clashes(frame(spark, good + bad + [(None, bad[0][1], None), (None, good[0][1], None)]))
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    kept = quality.survivors(docs, labels, threshold=0.5)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").select("text").collect() == [(good[0][1],)]


def test_exact_copies_without_text_stay_a_row(spark):
    rows = exact_dedup.survivors(frame(spark, [(3, None, "en"), (3, None, "en"), (None, "a", "en"), (None, "b", "en"), (9, "a", "en")])).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.lang) for r in rows) == [(0, "b", "en"), (3, "", "en"), (9, "a", "en")]
