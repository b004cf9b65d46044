from __future__ import annotations

import math
import zlib

import numpy as np

from kilnspark.llm import quality
from kilnspark.llm.common import table

from .helpers import frame, odd_rows, with_clashes


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.op4_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def plain_statistics(text):
    """The statistics counted by characters and bytes, one after the other."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    logit = lambda name, part, whole: (lambda p: math.log(p / (1 - p)))((part + 20 * quality.USUAL[name]) / (whole + 20))
    letters = upper = digits = symbols = stops = 0
    for b in raw:
        c = chr(b)
        letters += b >= 128 or "a" <= c <= "z" or "A" <= c <= "Z"
        upper += "A" <= c <= "Z"
        digits += "0" <= c <= "9"
        symbols += b < 128 and c in "!#$%&*+/<=>@[\\]^_`{|}~"
        stops += b < 128 and c in ".,;:?"
    words, word = [], b""
    for b in raw + b" ":
        if b in b" \t\n\r\x0b\x0c":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([b])
    lines = raw.split(b"\n")
    same = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    seen = []
    for w in words:
        if w not in seen:
            seen.append(w)
    return [
        math.log(len(words) + 40), math.log((sum(len(w) for w in words) + 100) / (len(words) + 20)), logit("symbols", symbols, len(raw)), logit("stops", stops, len(raw)), logit("upper", upper, letters), logit("digits", digits, len(raw)),
        logit("adjacent", same, max(0, len(words) - 1)), logit("unique", len(seen), len(words)), logit("lines", len(lines) - len({bytes(x) for x in lines}), len(lines)), math.log(len(raw) / len(lines) + 40), math.log((len(zlib.compress(raw, 1)) + 100) / (len(raw) + 200)),
    ]


def test_statistics_equal_plain_counts(spark, sf_dir):
    texts = [r[1] for r in odd_rows()] + ["A a A a\n\n\nB!? #1 É漢🙂\x00", "x\ud800y", *[r.text[:3000] for r in table(spark, sf_dir, "documents").limit(20).collect()]]
    for text in texts:
        text = text if text is None else text[:5000]
        assert np.allclose(quality.statistics(text), plain_statistics(text), rtol=1e-12)


def test_moments_give_the_classes_of_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, len(quality.FEATURES)))
    y = np.arange(60) % 2
    got = quality.fit(spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, label int"), 0.2, 0.1)
    for k in (0, 1):
        own = x[y == k]
        cov = np.cov(own.T, bias=True)
        cov = 0.8 * cov + 0.2 * np.diag(np.diag(cov)) + 0.1 * np.eye(len(cov))
        assert np.allclose(got[k].mean, own.mean(axis=0)) and np.allclose(got[k].factor @ got[k].factor.T, cov)
        z = own - own.mean(axis=0)
        want = np.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
        assert np.allclose(got[k].log_density(own), want)


def test_odd_rows_and_no_labels(spark):
    docs = with_clashes(frame(spark, odd_rows()))
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(odd_rows()) and all(r.score == 0.5 and r.predicted == 0 for r in got)
    assert quality.quality(frame(spark, []), labels).count() == 0
    assert quality.survivors(docs, labels, threshold=0.5).columns == docs.columns
