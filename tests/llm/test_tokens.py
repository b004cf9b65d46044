from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from kilnspark.llm import byte_bpe, packing, token_counts
from kilnspark.llm.pretokens import pieces, read_ranks

from .helpers import ENGLISH, frame, odd_rows, with_clashes

LETTERS = "aAbB  zZ09'sS'tT're\n\t\r\x0b\x1c\x1f\x7f\x00.,!?-_éÉüß²¼ªµ÷×ÿĀſİı \u0085\u00a0\u00adждЖ漢🙂\u0301Σσς\u3000"


def fuzz(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 20))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_duck_merges_encode_like_tiktoken(encoding):
    texts = [*fuzz(3000), ENGLISH]
    words = list(dict.fromkeys(w for t in texts for w in pieces(t)))
    assert all("".join(pieces(t)) == t for t in texts)
    ids, decoded = byte_bpe.DuckMerges(P.path("byte_bpe_50k.tiktoken")).encode([w.encode() for w in words])
    by_word, back = dict(zip(words, ids, strict=True)), dict(zip(words, decoded, strict=True))
    for t in texts:
        assert [int(i) for w in pieces(t) for i in by_word[w]] == encoding.encode_ordinary(t)
        assert b"".join(back[w] for w in pieces(t)) == t.encode()


def test_long_words_encode_like_tiktoken(encoding):
    merges = byte_bpe.DuckMerges(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    drawn = ["".join(rng.choice(letters) for _ in range(n)) for letters, n in (("etaoinshrdlu", 4000), ("ab", 2000), ("the", 1500), ("漢字かな", 700))]
    words = ["a" * 3000, "abcde" * 300, "xyzzy" * 51 + "q", "=" * 20001, "the" * 400, "an" * 777 + "the" * 555, *drawn]
    ids, decoded = merges.encode([w.encode() for w in [*words, "short", *reversed(words)]])
    for word, i, d in zip([*words, "short", *reversed(words)], ids, decoded, strict=True):
        assert i.tolist() == encoding.encode_ordinary(word) and d == word.encode()


def test_long_words_go_on_from_the_last_step_of_a_query(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEP_ROWS", 3000)
    rng = random.Random(4)
    word = "".join(rng.choice("etaoins") for _ in range(1000))
    assert byte_bpe.DuckMerges(P.path("byte_bpe_50k.tiktoken")).encode([word.encode()])[0][0].tolist() == encoding.encode_ordinary(word)


def test_words_come_again_after_the_memory_is_full(spark, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    monkeypatch.setattr(byte_bpe, "NEW_WORDS", 4)
    texts = [*fuzz(40, 9), *fuzz(40, 9), ENGLISH]
    got = byte_bpe.encode_decode(frame(spark, [(i, t, None) for i, t in enumerate(texts)]).coalesce(1), P.path("byte_bpe_50k.tiktoken")).collect()
    assert all(list(r.ids) == encoding.encode_ordinary(texts[r.doc_id]) for r in got) and len(got) == len(texts)


def test_encode_decode_rows(spark, encoding):
    rows = odd_rows() + [(200 + i, t, None) for i, t in enumerate(fuzz(50, 8))]
    got = byte_bpe.encode_decode(with_clashes(frame(spark, rows)), P.path("byte_bpe_50k.tiktoken")).collect()
    want = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == encoding.encode_ordinary(want[r.doc_id]) and bytes(r.decoded) == want[r.doc_id].encode()
    assert byte_bpe.encode_decode(frame(spark, []), P.path("byte_bpe_50k.tiktoken")).count() == 0


def greedy(word, vocabulary):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


def test_longest_match_equals_greedy(ranks):
    automaton = token_counts.LongestMatch(ranks)
    for t in [*fuzz(500), ENGLISH]:
        for w in pieces(t):
            assert automaton.count(w.encode()) == greedy(w.encode(), ranks)
    rng = random.Random(4)
    for _ in range(300):
        vocabulary = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6))}
        small = token_counts.LongestMatch(vocabulary)
        for _ in range(20):
            word = bytes(rng.choice(b"abc" if rng.random() < 0.2 else b"ab") for _ in range(rng.randint(0, 12)))
            assert small.count(word) == greedy(word, vocabulary), (vocabulary, word)


def test_token_counts_rows(spark, ranks):
    got = token_counts.token_counts(with_clashes(frame(spark, odd_rows())), P.path("byte_bpe_50k.tiktoken")).collect()
    want = {i: t or "" for i, t, _ in odd_rows()}
    assert len(got) == len(odd_rows())
    for r in got:
        words = pieces(want[r.doc_id])
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(greedy(w.encode(), ranks) for w in words), 0)
    assert token_counts.token_counts(frame(spark, []), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_word_ids_equal_the_tokenizer():
    own = packing.WordTokens(P.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    names = [t.content for t in whole.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in names
    for t in [*fuzz(4000, 9), ENGLISH, *names, *(f"a {n} b{n.upper()} {n}c" for n in names)]:
        assert own.encode(t) == own.bytes_of(whole.encode(t, add_special_tokens=False).ids) + own.end


def held(pieces_, window):
    """Check the pieces and give their number of sequences and padding."""
    by_sequence = {}
    for r in pieces_:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for rows in by_sequence.values():
        offset = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == offset and r.length > 0
            offset += r.length
        assert offset <= window
        padding += 0 if offset & (offset - 1) == 0 else window - offset
    return len(by_sequence), padding


def test_every_id_is_packed_once(spark):
    rows = [r for r in odd_rows() if r[0] != 2] + [(250, "a <|endoftext|> b", "en")] + [(300 + i, ENGLISH * (1 + i % 9), "en") for i in range(200)]
    docs = with_clashes(frame(spark, rows)).repartition(3)
    got = packing.pack(docs, P.path("word_bpe_49k.json"), window=128, open_windows=4, min_cut=4, with_ids=True).collect()
    own = packing.WordTokens(P.path("word_bpe_49k.json"))
    for doc_id, text, _ in rows:
        ids = b""
        for r in sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == len(ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
            ids += bytes(r.ids)
            assert r.length == len(r.ids) // 4
        assert ids == own.encode(text) and all(r.doc_tokens == len(ids) // 4 for r in got if r.doc_id == doc_id)
    twice = packing.pack(with_clashes(frame(spark, odd_rows())).repartition(3), P.path("word_bpe_49k.json"), window=128, open_windows=4, min_cut=4, with_ids=True).where("doc_id = 2").collect()
    assert sum(r.length for r in twice) == 2 * len(own.encode(ENGLISH)) // 4 and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in twice)
    assert all(own.encode(ENGLISH)[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids) for r in twice)
    total = sum(r.length for r in got)
    assert held(got, 128)[1] < 0.05 * total
    assert packing.pack(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_a_packer_holds_so_many_windows():
    packer = packing.Packer(0, 0, window=100, open_windows=3, min_cut=10)
    rng = np.random.default_rng(0)
    for i in range(300):
        packer.add(i, 0, b"\0\0\0\0" * int(rng.integers(1, 150)), 0)
        assert len(packer.open) <= 3
