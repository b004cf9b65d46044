from __future__ import annotations

import hashlib

import numpy as np

from kilnspark.llm import fingerprints as fp

from .helpers import ENGLISH, GERMAN, frame, odd_rows, with_clashes


def brute_kmers(text, k):
    seen, out = {}, []
    for i in range(max(0, len(text) - k + 1)):
        w = text[i : i + k]
        out.append((w, seen.get(w, 0)))
        seen[w] = seen.get(w, 0) + 1
    return out


def test_equal_numbered_kmers_have_equal_hashes():
    omh, text = fp.OrderMinHash(k=3), "abcabcabcxabcab" * 3
    hashes, pairs = omh.kmers(fp.code_points(text)).tolist(), brute_kmers(text, 3)
    by_pair = {}
    for h, p in zip(hashes, pairs, strict=True):
        assert by_pair.setdefault(p, h) == h
    assert len(set(by_pair.values())) == len(by_pair) == len(pairs)


def test_order_matters_and_edits_show():
    omh = fp.OrderMinHash()
    a = omh.sketch(fp.code_points(ENGLISH * 3))
    swapped = omh.sketch(fp.code_points((ENGLISH * 3)[60:] + (ENGLISH * 3)[:60]))
    slight = omh.sketch(fp.code_points((ENGLISH * 3).replace("quick", "slick", 1)))
    other = omh.sketch(fp.code_points(GERMAN * 3))
    assert fp.likeness(a, a) == 1 > fp.likeness(a, slight) > fp.likeness(a, swapped) > fp.likeness(a, other)


def want(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc_id, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_neighbours_over_ranges(spark, monkeypatch):
    rows = [r for r in odd_rows() if r[0] != 2] + [(i * 7, f"{ENGLISH} {i}", "en") for i in range(2, 90)]
    rows = list({r[0]: r for r in rows}.values())
    for size in (5, 40, 4096):
        monkeypatch.setattr(fp, "RANGE_ROWS", size)
        got = fp.fingerprints(with_clashes(frame(spark, rows))).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == want(rows)


def test_repeated_single_and_no_rows(spark):
    got = fp.fingerprints(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and {r.fingerprint for r in got if r.doc_id in (3, 4)} == {"0" * 8 * fp.SKETCHES}
    one = fp.fingerprints(frame(spark, [(5, ENGLISH, "en")])).first()
    assert one.near_next == 1.0 and np.isclose(one.n_chars, len(ENGLISH))
    assert fp.fingerprints(frame(spark, [])).count() == 0


def test_sketches_pick_the_least_numbered_kmers_in_text_order():
    """Each sketch, from hashes of a plain list of numbered k-mers: the two of least rank, in text order, hashed together."""
    omh = fp.OrderMinHash(k=4, sketches=16, tuple_size=2)
    for text in (ENGLISH, "ab" * 40 + "xyz", GERMAN + ENGLISH, "abc", "abcde"):
        points = fp.code_points(text)
        h = omh.kmers(points).tolist()
        mask, want = (1 << 64) - 1, []
        for s in range(16):
            ranks = []
            for x in h:
                r = ((((x ^ (x >> 32)) & 0xFFFFFFFF) * int(omh.odd[s, 0])) + int(omh.add[s, 0])) & 0xFFFFFFFF
                r ^= r >> 15
                ranks.append((r * 0x2C1B3C6D) & 0xFFFFFFFF)
            least = sorted(sorted(range(len(h)), key=lambda i: (ranks[i], i))[:2])
            out = 0x9E3779B97F4A7C15
            for i in least:
                out = ((out ^ h[i]) * 0x94D049BB133111EB) & mask
                out ^= out >> 30
            want.append(out >> 32)
        assert omh.sketch(points).tolist() == want


def test_likeness_is_the_share_of_equal_sketches(spark):
    rows = [(i, t, "en") for i, t in enumerate((ENGLISH, ENGLISH + " more", GERMAN, "", ENGLISH))]
    omh, got = fp.OrderMinHash(), {r.doc_id: r for r in fp.fingerprints(frame(spark, rows)).collect()}
    for i, text, _ in rows:
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, new, after = (omh.sketch(fp.code_points(t)) for t in (text, edited, following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (omh.text_of(own), omh.text_of(new))
        assert got[i].near_edited == sum(a == b for a, b in zip(own, new, strict=True)) / 64
        assert got[i].near_next == sum(a == b for a, b in zip(own, after, strict=True)) / 64


def test_a_hot_id_gives_one_cut_point(spark):
    docs = frame(spark, [(5, f"t{i}", "en") for i in range(3000)] + [(i, "x", "en") for i in range(10, 3000)])
    assert len(fp.range_cuts(docs, "doc_id")) <= 5 and fp.fingerprints(docs).count() == 5990
