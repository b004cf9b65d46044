"""Language ID of code-switched text by a linear-chain conditional random field.

Words carry affix, n-gram and lexicon features, hashed into one weight table; learned
transitions tie neighbouring words. Training sequences are spliced from documents of
different languages, so that the transitions learn how often text switches. Each word
of a text gets the exact posterior of the forward-backward algorithm, run over many
texts at once, one step of all of them at a time; a text's language is the one with
the most expected words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table, text_digest, without

#: Training is on a bounded sample: whole documents of each language, code points of all of them, and spliced sequences.
SAMPLE_DOCS, SAMPLE_POINTS, SEQUENCES, LENGTH = 300, 2_000_000, 1000, 80
SLOTS, STEPS, RATE, DECAY, SEED = 1 << 16, 40, 0.3, 1e-5, 5
#: Words whose feature sums a worker remembers, and words worked on together.
MEMO, TOGETHER = 200_000, 600_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    found = _WORD.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def feature_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of the words in one array, and where each word's begin.

    A word with its borders gives its bigrams and trigrams, prefixes and suffixes of one
    to three letters, and itself (the lexicon).
    """
    bordered = [f"\x02{w}\x03" for w in words]
    sizes = np.fromiter(map(len, bordered), np.int64, len(bordered))
    c = np.frombuffer("".join(bordered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    mixed = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SLOTS
    p, q, r = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = c[:-1] * p + c[1:] * q
    three = two[:-1] + c[2:] * r
    n = np.arange(len(c))
    has_two, has_three = n[:-1] + 2 <= ends[word[:-1]], n[:-2] + 3 <= ends[word[:-2]]
    slots, owner = [mixed(two + np.uint64(1))[has_two], mixed(three + np.uint64(2))[has_three]], [word[:-1][has_two], word[:-2][has_three]]
    every = np.arange(len(words))
    for size in (1, 2, 3):
        fits = sizes - 2 >= size
        head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for i in range(size):
            head = head * p + c[np.minimum(starts + 1 + i, len(c) - 1)]
            tail = tail * q + c[np.maximum(ends - 2 - i, 0)]
        slots += [mixed(head * r + np.uint64(2 * size + 1))[fits], mixed(tail * r + np.uint64(2 * size + 2))[fits]]
        owner += [every[fits], every[fits]]
    place = np.arange(len(c)) - np.repeat(starts, sizes)
    whole = np.add.reduceat((c + np.uint64(77)) * (p * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))), starts)
    slots.append(mixed(whole * q))
    owner.append(every)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.searchsorted(owner[order], every)


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # SLOTS x languages
    transitions: np.ndarray  # from x to

    def emissions(self, words: list[str]) -> np.ndarray:
        slots, starts = feature_slots(words)
        return np.add.reduceat(self.weights[slots], starts, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Posteriors of chains of descending length, last step first.

    scores is laid out by step: row off[t] + i is step t of chain i. Yields (t, i0..,
    posterior rows, messages) as (rows of the step, posterior, backward message).
    """
    active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right")
    off = np.concatenate([[0], np.cumsum(active)])
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(local.dtype)
    back = np.ascontiguousarray(move.T)
    alpha = np.empty_like(local)
    now = local[: off[1]]
    now = now / now.sum(axis=1, keepdims=True)
    alpha[: off[1]] = now
    for t in range(1, len(active)):
        now = (now[: active[t]] @ move) * local[off[t] : off[t + 1]]
        now /= now.sum(axis=1, keepdims=True)
        alpha[off[t] : off[t + 1]] = now
    beta = np.ones((active[-1], local.shape[1]), local.dtype)
    for t in range(len(active) - 1, -1, -1):
        rows = slice(off[t], off[t + 1])
        post = alpha[rows] * beta
        post /= post.sum(axis=1, keepdims=True)
        yield rows, post, beta
        if t:
            pulled = (local[rows] * beta) @ back
            pulled /= pulled.sum(axis=1, keepdims=True)
            more = active[t - 1] - len(pulled)
            beta = np.concatenate([pulled, np.ones((more, pulled.shape[1]), pulled.dtype)]) if more else pulled


def likelihood_gradient(scores: np.ndarray, transitions: np.ndarray, tags: np.ndarray, chains: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of chains of equal length by scores and by transitions: what is, less what is expected.

    scores and tags are laid out by step: row t * chains + i of scores is step t of
    chain i, whose tag is tags[t, i].
    """
    k, steps = len(transitions), len(tags)
    post, expected = np.empty_like(scores), np.zeros((k, k))
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alphas = [local[:chains] / local[:chains].sum(axis=1, keepdims=True)]
    for t in range(1, steps):
        a = (alphas[-1] @ move) * local[t * chains : (t + 1) * chains]
        alphas.append(a / a.sum(axis=1, keepdims=True))
    for rows, p, beta in forward_backward(scores, np.full(chains, steps), transitions):
        post[rows] = p
        if t := rows.start // chains:
            joint = alphas[t - 1][:, :, None] * move[None] * (local[rows] * beta)[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return np.eye(k)[tags.ravel()] - post, pairs - expected


def train(samples: list[tuple[str, str]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> Crf | None:
    """A field learned from (lang, text) samples by adaptive gradient ascent on the likelihood of spliced sequences."""
    rng = np.random.default_rng(seed)
    by_lang: dict[str, list[list[str]]] = {}
    for lang, text in samples:
        if words := words_of(text):
            by_lang.setdefault(lang, []).append(words)
    langs = sorted(by_lang)
    if not langs:
        return None
    k = len(langs)
    model = Crf(langs, np.zeros((SLOTS, k), np.float32), np.zeros((k, k)))
    if k == 1:
        return model
    chosen, truth = [], []
    for _ in range(SEQUENCES):
        words, tags, lang = [], [], int(rng.integers(k))
        while len(words) < LENGTH:
            doc = by_lang[langs[lang]][rng.integers(len(by_lang[langs[lang]]))]
            n = int(rng.integers(4, LENGTH))
            at = int(rng.integers(max(1, len(doc) - n + 1)))
            part = doc[at : at + n]
            words += part
            tags += [lang] * len(part)
            lang = int(rng.integers(k))
        chosen += words[:LENGTH]
        truth.append(tags[:LENGTH])
    truth = np.array(truth)
    names = sorted(set(chosen))
    index = {w: i for i, w in enumerate(names)}
    word = np.fromiter((index[w] for w in chosen), np.int64, len(chosen)).reshape(SEQUENCES, LENGTH).T.ravel()
    slots, starts = feature_slots(names)
    owner = np.repeat(np.arange(len(names)), np.diff(np.concatenate([starts, [len(slots)]])))
    used, slot = np.unique(slots, return_inverse=True)
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(steps):
        missing, pulled = likelihood_gradient(np.add.reduceat(w[slot], starts, axis=0)[word], trans, truth.T, SEQUENCES)
        gap = np.zeros((len(names), k))
        np.add.at(gap, word, missing)
        grad = np.stack([np.bincount(slot, gap[owner, j], len(used)) for j in range(k)], axis=1) / len(word) - decay * w
        gw += grad * grad
        w += rate * grad / np.sqrt(gw)
        grad = pulled / len(word)
        gt += grad * grad
        trans += rate * grad / np.sqrt(gt)
    model.weights[used] = w
    model.transitions = trans
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, points: int = SAMPLE_POINTS) -> list[tuple[str, str]]:
    """(lang, whole text) of a bounded sample: for each language at most per_lang distinct documents, in order of a hash of doc_id and text, and of those as many as have no more than so many code points in all, passing over what would be too long by itself."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    spot = F.xxhash64("doc_id", "text", F.lit("sample"))
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.approx_count_distinct(spot).alias("n")).collect()}
    if not counts:
        return []
    grain = 1 << 30
    limit = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(grain, 2 * per_lang * grain // max(n, 1) + 1)))])
    near = taught.select("lang", spot.alias("spot"), "text").where((F.pmod("spot", F.lit(grain)) < limit[F.col("lang")]) & (F.length("text") <= points))
    by_spot = Window.partitionBy("lang").orderBy("spot")
    near = near.groupBy("lang", "spot").agg(F.min("text").alias("text"))
    near = near.withColumn("place", F.row_number().over(by_spot)).withColumn("points", F.sum(F.length("text")).over(by_spot))
    rows = near.where((F.col("place") <= per_lang) & ((F.col("points") <= points) | (F.col("place") == 1))).select("lang", "text").collect()
    return sorted((r["lang"], r["text"]) for r in rows)


class Labeller:
    """Posteriors of whole texts, with feature sums remembered by word."""

    def __init__(self, model: Crf):
        self.model, self.memo, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def indices(self, docs: list[list[str]]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            self.table = self.table[:0]
        new = [w for w in dict.fromkeys(w for words in docs for w in words) if w not in memo]
        if new:
            for i, w in enumerate(new, len(memo)):
                memo[w] = i
            self.table = np.concatenate([self.table, self.model.emissions(new).astype(np.float32)])
        return np.fromiter((memo[w] for words in docs for w in words), np.int64, sum(map(len, docs)))

    def label(self, docs: list[list[str]], spans: bool) -> tuple[np.ndarray, list]:
        """Expected words of each language for each text, and runs (first word, words, lang) if asked for."""
        k = len(self.model.langs)
        totals, runs = np.zeros((len(docs), k)), [[] for _ in docs]
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return totals, runs
        sizes = lengths[order]
        flat = self.indices([docs[i] for i in order])
        active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right")
        off = np.concatenate([[0], np.cumsum(active)])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by_step = off[step] + np.repeat(np.arange(len(sizes)), sizes)
        laid = np.empty(len(flat), np.int64)
        laid[by_step] = flat
        sums, best = np.zeros((len(order), k)), np.empty(len(flat), np.int16)
        for rows, post, _ in forward_backward(self.table[laid], sizes, self.model.transitions):
            sums[: len(post)] += post
            if spans:
                best[rows] = post.argmax(axis=1)
        totals[order] = sums
        if spans:
            tags, at = best[by_step], 0
            for i, n in zip(order, sizes, strict=True):
                own = tags[at : at + n]
                cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n]])
                runs[i] = [(int(a), int(b - a), self.model.langs[own[a]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                at += n
        return totals, runs


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spans: bool = False, digests: bool = False) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score (and spans: runs of words by language; and digest, of its text).

    Learns from text and non-null lang of rows that are not held out. A null text, or one
    without a letter, is `und` with score 0; so is every text when nothing can be
    learned. Ties go to the first language by name. Repeated rows are labelled alike;
    other columns are not looked at; no rows give no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(training_sample(source))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights for each language
    kind = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        labeller = None if field is None else Labeller(field)

        def flush(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            if labeller is None:
                pred, score, runs = [UNKNOWN] * len(ids), [0.0] * len(ids), [[]] * len(ids)
            else:
                totals, runs = labeller.label(texts, spans)
                top = totals.argmax(axis=1)
                pred = [field.langs[i] if words else UNKNOWN for i, words in zip(top, texts, strict=True)]
                score = [min(1.0, float(t[i]) / len(words)) if words else 0.0 for t, i, words in zip(totals, top, texts, strict=True)]
            columns = [pa.array(ids, ids_type), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array([[{"word": a, "words": n, "lang": x} for a, n, x in r] for r in runs], kind))
                names.append("spans")
            return pa.RecordBatch.from_arrays(columns, names=names)

        ids, texts, size = [], [], 0
        for batch in batches:
            ids_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                for i, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(words_of(text))
                    size += len(texts[-1])
                    if size > TOGETHER:
                        yield flush(ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    more = ", spans array<struct<word:int,words:int,lang:string>>" if spans else ""
    if digests:  # they go along with the ids
        source = source.withColumn("doc_id", F.struct("doc_id", text_digest(F.col("text")).alias("digest")))
    out = map_batches(source.select("doc_id", "text"), run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double{more}")
    if digests:
        out = out.withColumn("digest", F.col("doc_id.digest")).withColumn("doc_id", F.col("doc_id.doc_id"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []), *(["digest"] if digests else []))


LEAST_SCORE = 0.5


def survivors(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose text has a language with a score of least or more, with all their columns; each row by its own text, also where a doc_id is null or repeated."""
    return without(docs, language_id(docs, digests=True).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)), "rejected")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
