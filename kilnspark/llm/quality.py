"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics (log lengths, logits of
character and repetition shares, compressibility). Class means and covariances come
from moments summed over all labelled rows in Spark; the covariances are shrunk to
their diagonals and factored once (Cholesky). A text's score is the logistic of the
difference of the two Mahalanobis log-densities, divided by a temperature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digested, map_batches, materialize, table, without

SHRINKAGE, RIDGE, TEMPERATURE = 0.2, 0.1, 4.0
THRESHOLD = 0.7
FEATURES = ["words", "word_length", "symbols", "stops", "upper", "digits", "adjacent", "unique", "lines", "line_length", "packed"]

_upper, _letter, _digit, _symbol, _stop = (np.zeros(256, bool) for _ in range(5))
_upper[65:91] = True
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_digit[48:58] = True
_symbol[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_stop[[ord(c) for c in ".,;:?"]] = True


#: Shares that a text of no length is taken to have, and how many counts of them are added to every text.
USUAL = {"symbols": 0.002, "stops": 0.03, "upper": 0.05, "digits": 0.005, "adjacent": 0.01, "unique": 0.7, "lines": 0.02}
PSEUDO, PSEUDO_LENGTH = 20, 40


def _logit(name: str, part: float, whole: float) -> float:
    """Logit of a share that is drawn to its usual value the shorter the text is."""
    share = (part + PSEUDO * USUAL[name]) / (whole + PSEUDO)
    return float(np.log(share / (1 - share)))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    letters = int(seen[_letter].sum())
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log(len(words) + PSEUDO_LENGTH)),
        float(np.log((sum(map(len, words)) + 5 * PSEUDO) / (len(words) + PSEUDO))),
        _logit("symbols", int(seen[_symbol].sum()), n),
        _logit("stops", int(seen[_stop].sum()), n),
        _logit("upper", int(seen[_upper].sum()), letters),
        _logit("digits", int(seen[_digit].sum()), n),
        _logit("adjacent", repeats, max(0, len(words) - 1)),
        _logit("unique", len(set(words)), len(words)),
        _logit("lines", len(lines) - len(set(lines)), len(lines)),
        float(np.log(n / len(lines) + PSEUDO_LENGTH)),
        float(np.log((len(zlib.compress(raw, 1)) + 100) / (n + 200))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text, from docs(doc_id, text); a digest goes along."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                few = batch.slice(at, 1024)
                x = pa.array([statistics(t) for t in few.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([few.column(0), x, *few.columns[2:]], names=["doc_id", "x", *more])

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>" + "".join(f", {c} binary" for c in more))


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the shrunk covariance
    whiten: np.ndarray  # its inverse
    log_weight: float

    @classmethod
    def fitted(cls, n: float, total: float, sums: np.ndarray, products: np.ndarray, shrinkage: float, ridge: float) -> Gaussian:
        mean = sums / n
        cov = products / n - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        return cls(mean, factor, np.linalg.inv(factor), float(np.log(n / total)))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = self.whiten @ (x - self.mean).T
        return self.log_weight - np.log(np.diag(self.factor)).sum() - 0.5 * (z * z).sum(axis=0)


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> tuple[Gaussian, Gaussian] | None:
    """Class 0 and class 1 from rows(x, label), or None while a class has fewer than two rows.

    Moments of all rows are summed by partition and then by key; the driver gets one
    number for each class, pair of features and class.
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {label: np.zeros(1 + d + d * d) for label in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist())
            for label, total in sums.items():
                own = x[y == label]
                total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for label, total in sums.items():
            if total[0]:
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["label", "i", "v"])

    got = rows.select("x", F.col("label").cast("int")).where("label in (0, 1)").mapInArrow(moments, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = []
    for label in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in got:
            if r["label"] == label:
                v[r["i"]] = r["v"]
        out.append(v)
    if min(v[0] for v in out) < 2:
        return None
    total = sum(v[0] for v in out)
    return tuple(Gaussian.fitted(v[0], total, v[1 : 1 + d], v[1 + d :].reshape(d, d), shrinkage, ridge) for v in out)


def scored(found: DataFrame, model: tuple[Gaussian, Gaussian] | None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id and score of features(doc_id, x); a digest goes along; without a model every score is 0.5."""
    more = found.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), float)
                gap = np.zeros(len(x)) if model is None else (model[1].log_density(x) - model[0].log_density(x)) / temperature
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(gap, -700, 700)))), *batch.columns[2:]], names=["doc_id", "score", *more])

    return map_batches(found, run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double" + "".join(f", {c} binary" for c in more))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, digests: bool = False) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted (and digest, of its text).

    Learns from labels whose doc_id is not held out; null labels and ids teach nothing,
    repeated labels count each time. Null texts count as empty, and get a score. With
    fewer than two rows of a class every score is 0.5. Other columns are not looked at;
    no rows give no rows.
    """
    found = materialize(features(digested(docs, id_col, text_col, digests)), "features")
    taught = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).where(~held_out(F.col("_id")))
    model = fit(found.join(taught, F.col("doc_id") == F.col("_id")))
    out = scored(found, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["digest"] if digests else []))


def survivors(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns; each row by its own text, also where a doc_id is null or repeated."""
    return without(docs, quality(docs, labels, threshold=threshold, digests=True).where("predicted = 0"), "rejected")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
