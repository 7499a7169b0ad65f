import random

import numpy as np
import public_tokenizers as P
import regex

from weftline.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_pieces_and_spaces():
    enc = bpe.encoding(RANKS, P.PATTERN)
    brute = lambda text: [i for m in regex.findall(P.PATTERN, text) for i in enc._encode_single_piece(m)]
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice(["ab", " ", "\n", "\xa0", "é", "12", "'s", "!", " " * 1500, "\t" * 1200, "\x1c", "word "]) for _ in range(60))
        assert bpe.encode(enc, t).tolist() == brute(t)
        assert [i for x in bpe.pieces(t, 20) for i in enc.encode_ordinary(x)] == enc.encode_ordinary(t)
        assert bpe.decode(enc, bpe.encode(enc, t)) == t.encode()
    assert bpe.encode(enc, "<|endoftext|>").tolist() == enc.encode_ordinary("<|endoftext|>")


def test_round_trip(docs, none):
    tokens = bpe.bpe_encode(docs, RANKS, P.PATTERN)
    back = bpe.bpe_decode(tokens, RANKS, P.PATTERN)
    assert tokens.count() == 8 and back.columns == ["doc_id", "decoded"]
    want = sorted((r.text or "").encode() for r in docs.collect())
    assert sorted(bytes(r.decoded) for r in back.collect()) == want
    digests = {r.doc_id: r for r in bpe.bpe_digests(docs, RANKS, P.PATTERN).collect()}
    assert digests[2].n_tokens == digests[3].n_tokens == 0 and digests[2].ids_sha256 == digests[3].decoded_sha256
    assert bpe.bpe_digests(none, RANKS, P.PATTERN).count() == 0
    assert bpe.decode(bpe.encoding(RANKS, P.PATTERN), np.zeros(0, np.int64)) == b""
