import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from leafledger.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def whole(text):
    encoding = bpe._encoding(PATH, PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    return encoding.encode_ordinary(text or "")


def expected(text):
    ids = whole(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (200, 40), (32768, 2048)])
def test_chunks_give_the_ids_of_the_whole_text(make, chunk, overlap):
    rng = random.Random(chunk)
    pieces = ["word", " ", "  ", "\n", "\n\n", "'s", "'re", "'", "1234", "!!", "é中", "\u00a0", "x" * 50, " " * 30, "\t", "🎉", "I'll"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 200))) for _ in range(30)]
    texts += ["a" * 1000, " " * 1000, "ab " * 400, "'" * 300, "", None, texts[0], "\n" * 500 + "end"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe.digests(make(rows), PATH, PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: expected(t) for i, t in rows}


def test_long_white_space_does_not_overflow_the_matcher():
    text = "a" + " " * 2_000_000 + "b"
    ids = bpe.encode_text(text, PATH, PATTERN)
    assert bpe._encoding(PATH, PATTERN).decode(ids) == text
    short = "a" + " " * 40_000 + "b\n" + " " * 40_000
    assert bpe.encode_text(short, PATH, PATTERN) == whole(short)


def test_odd_rows(odd):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, PATH, PATTERN, chunk=5000, overlap=500).collect())
    assert got == sorted((r.doc_id or 0, *expected(r.text)) for r in odd.collect())
    encoded = bpe.encode(odd, PATH, PATTERN)
    assert encoded.columns == [c for c in odd.columns if c != "text"] + ["ids_"]
    assert bpe.digests(odd.where("doc_id = -1"), PATH, PATTERN).count() == 0
