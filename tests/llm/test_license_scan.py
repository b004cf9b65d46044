from __future__ import annotations

import re

from kilnspark.llm import license_scan
from kilnspark.llm.license_scan import TEMPLATES, WORD

from .helpers import frame, odd_rows, with_clashes


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, found = re.findall(WORD, low), set()
    for t in TEMPLATES:
        for i in range(len(words)):
            if words[i : i + len(t.key_words)] == t.key_words:
                start = i - t.key_at
                part = sum(0 <= start + j < len(words) and words[start + j] == x for j, x in enumerate(t.words)) / len(t.words)
                if part >= license_scan.MIN_FRACTION:
                    found.add((t.label, t.base, i, part))
    return len(words), found


def test_matches_equal_brute_force(spark):
    texts = [
        "All rights reserved. ALL RIGHTS RESERVED all rights",
        "Licensed under CC BY-NC 4.0. cc  by",
        "the GNU General Public License, version 3; a general public  license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "permission is hereby granted free",
        "Licensed under the Apache License, Version 2.0. " * 300,
        "all é rights reserved all rights reserveđ \u212aind",
    ]
    rows = odd_rows() + [(100 + i, t, "en") for i, t in enumerate(texts)]
    got = license_scan.license_scan(with_clashes(frame(spark, rows))).collect()
    want = {i: brute(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, {(m.label, m.base, m.word_at, m.fraction) for m in r.matches}) == want[r.doc_id], r.doc_id
    assert any(m for _, m in want.values())


def test_idf_counts_documents_not_places(spark):
    docs = frame(spark, [(1, "license license", "en"), (2, "license", "en"), (3, "mit", "en")])
    idf = license_scan.key_word_idf(docs, "text", TEMPLATES)
    assert idf["mit"] > idf["license"]


def test_empty(spark):
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_native(spark):
    plan = license_scan.license_scan(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
