from __future__ import annotations

import hashlib
import re

from kilnspark.llm import exact_dedup

from .helpers import frame, odd_rows, with_clashes


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, _ in rows}
    out = {}
    for i, t, _ in rows:
        group = [(-len(u or ""), j is None, j or 0, j) for j, u, _ in rows if re.sub(r"[\x20\x09-\x0D]", "", u or "") == norm[i]]
        out[i] = (min(group)[3], len(group), hashlib.sha256(norm[i].encode()).hexdigest())
    return out


def test_groups_match_brute_force(spark):
    rows = odd_rows() + [(20, "a  b", "en"), (21, "ab", "en"), (22, "a b", "en")]
    want = brute(rows)
    got = exact_dedup.exact_dedup(with_clashes(frame(spark, rows)), least=4, most=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id]
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_colliding_keys_get_an_identifier_each(spark):
    """Two chunks under one key stay apart by their digests."""
    rows = spark.createDataFrame([(1, 1, 1, "a", [(5, bytearray(b"x"))]), (2, 2, 1, "b", [(5, bytearray(b"y"))]), (3, 3, 1, "c", [(5, bytearray(b"x"))])], "uid long, doc_id long, n_chars long, text_sha256 string, chunks array<struct<key:long,digest:binary>>")
    got = {r.doc_id: tuple(r.recipe) for r in exact_dedup.recipes(rows).collect()}
    assert got[1] == got[3] != got[2]


def test_survivors_keep_all_columns_and_one_row(spark):
    docs = with_clashes(frame(spark, odd_rows()))
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id in (1, 2)").count() == 1
    assert kept.count() == exact_dedup.exact_dedup(docs).where("kept").count()


def test_main_path_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    docs = frame(spark, [])
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert exact_dedup.survivors(docs).count() == 0
