from __future__ import annotations

import zlib
from hashlib import sha256

from kilnspark.llm import merkle

from .helpers import frame, odd_rows, with_clashes


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, n_chars):
    values = (doc_id, "s", lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node the (left, right) siblings by level, by walking up from each node anew."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    ways = []
    for i in range(len(nodes)):
        way = []
        for row in rows[:-1]:
            first = i - i % 8
            way.append((row[first:i], row[i + 1 : first + 8]))
            i //= 8
        ways.append(way)
    return rows[-1][0], ways


def brute(rows):
    trees, out = {}, []
    for doc_id, text, lang in rows:
        n = None if text is None else len(text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = text.translate({c: c + 32 for c in range(65, 91)}) if text is not None and tampered else text
        trees.setdefault(lang, []).append((doc_id, leaf(doc_id, text, lang, n), leaf(doc_id, low, lang, n)))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    lower = {lang: tree([r[1] for r in trees[lang]]) for lang in langs}
    root, upper = tree([lower[lang][0] for lang in langs])
    for lang, above in zip(langs, upper, strict=True):
        subroot, ways = lower[lang]
        for (doc_id, own, shown), way in zip(trees[lang], ways, strict=True):
            folded = shown
            for left, right in way + above:
                folded = h(*left, folded, *right)
            out.append((doc_id, own, subroot, root, h(*(s for left, right in way + above for s in left + right)), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    rows = odd_rows()
    found = got(merkle.manifest(with_clashes(frame(spark, rows))))
    assert found == brute(rows)


def test_no_rows_and_one_row(spark):
    assert got(merkle.manifest(frame(spark, []))) == []
    (only,) = got(merkle.manifest(frame(spark, [(2, "Ab", None)])))
    assert only[1] == only[2] == only[3] and only[4] == h()
    assert [only] == brute([(2, "Ab", None)])


def test_rounds_of_small_blocks(spark):
    """One language with most rows, some with a few, blocks of 8 leaves and a top of three nodes."""
    rows = [(i * 37 % 1000, f"Text {i}", "en" if i % 3 else "fr") for i in range(700)] + [(1000 + i, "X", "de") for i in range(9)] + [(2000, "Y", None), (7, "Dup", "en"), (7, "Dup", "en"), (None, "N", "en"), (None, "M", "en")]
    want = brute(rows)
    assert 150 < sum(not w[-1] for w in want) < 350
    for levels, top in ((1, 5), (2, 3), (4, 4096)):
        assert got(merkle.manifest(frame(spark, rows), levels=levels, top=top)) == want


def test_more_languages_than_the_driver_takes(spark):
    rows = [(i, f"Text {i}", f"l{i % 90}é") for i in range(400)]
    want = brute(rows)
    for levels in (1, 2):
        assert got(merkle.manifest(frame(spark, rows), levels=levels, top=4)) == want


def test_the_query_over_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    found = got(merkle.manifest(frame(spark, rows)))
    assert found == brute(rows)
    assert len(merkle.op13_merkle_manifest(spark, sf_dir).collect()) == len(rows)
