import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from shardsort.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as lines:
        return bpe.read_ranks(lines)


@pytest.fixture(scope="module")
def expected(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_random_texts(ranks, expected, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab be\n\t 1é's'\x1c\x85　日😀ll<|endoftext|>") for _ in range(rng.randrange(90))) for _ in range(1500)]
    for lot in (3000, 2):
        monkeypatch.setattr(bpe, "QUEUE_PIECES", lot)
        assert bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(texts) == [packed(expected(t)) for t in texts]


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "é" * 7_000, "\n" * 9_000, "0123456789" * 2_000, "日本語" * 3_000])
def test_very_long_pretokens(ranks, expected, text):
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert encoder.encode([text]) == [packed(expected(text))]
    assert not any(encoder.low) and not any(encoder.buckets)


def test_a_lower_rank_goes_first():
    """After a merge a lower rank can appear; the rest of the higher bucket waits for it."""
    ranks = {bytes([b]): k for k, b in enumerate(b"abcd")} | {b"abc": 4, b"ab": 5, b"ca": 6, b"cab": 7, b"abca": 8, b"bcab": 9}
    own = bpe.Encoder(ranks, r".+")
    theirs = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30)))
        assert own.encode([text]) == [packed(theirs.encode_ordinary(text))], text


def test_memo_stays_bounded(ranks, expected, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 50)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 100)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    texts = [f" word{k % 70}x{k} again" for k in range(500)]
    assert encoder.encode(texts) == [packed(expected(t)) for t in texts]
    assert len(encoder.memo) < 50 + 60 and len(encoder.older) < 50 + 60


def test_documents(docs, rows, expected):
    got = bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = expected(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_columns_and_empty(docs, no_docs):
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).columns == docs.columns  # token_ids is replaced
    assert bpe.digests(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_a_byte_without_a_rank_is_refused():
    encoder = bpe.Encoder({b"a": 0, b"b": 1, b"ab": 2, b"bz": 3}, r".+")
    assert encoder.encode(["abab", "bz"]) == [packed([2, 2]), packed([3])]
    for text in ("abz z", "z", "abz"):
        with pytest.raises(ValueError):
            bpe.Encoder({b"a": 0, b"b": 1, b"ab": 2}, r".+").encode([text])
