"""Operator 3: byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, sha

#: Texts of more characters are cut into pieces of about this many at safe boundaries.
PIECE = 1 << 16
#: Runs of white space from this length on are pieces of their own: the pattern's look-ahead would backtrack over them.
LONG_SPACE = 1024
#: What \s means to the library: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the splitting pattern holds a non-space followed by a space, and none of its look-aheads crosses such a place: a text cut there splits as the whole would.
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
SPACES = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe boundaries into pieces of at least size characters, but for the last; a text without white space stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m or m.start() >= len(text):
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit integers; special tokens' strings are ordinary text. Of a long run of white space, all but the last character before a non-space is one match of the pattern."""
    got, at = [], 0
    for m in SPACES.finditer(text) if len(text) >= LONG_SPACE else ():
        end = m.end() - (m.end() < len(text))
        got += [enc.encode_ordinary(x) for x in pieces(text[at : m.start()])]
        got.append(enc._encode_single_piece(text[m.start() : end]))
        at = end
    got += [enc.encode_ordinary(x) for x in pieces(text[at:])]
    return np.fromiter((i for x in got for i in x), "<u4", sum(map(len, got)))


def decode(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The bytes that ids stand for, which need not be valid UTF-8 when ids were cut."""
    return b"".join(enc.decode_tokens_bytes(ids.tolist()))


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids array<long> of each whole text. Null and empty texts have no ids; repeated rows stay; other columns are left out."""

    def run(texts: list[bytes]) -> dict:
        enc = encoding(rank_file, pattern)
        ids = [encode(enc, x.decode("utf-8", "replace")) for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return {"token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int64)))}

    return map_texts(docs, run, "token_ids array<bigint>", {id_col: F.col(f"`{id_col}`")}, text_col)


def bpe_decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """All columns but the ids, and decoded binary. Null ids decode to no bytes; an id outside the vocabulary is an error."""
    keep = [c for c in tokens.columns if c not in (ids_col, "decoded")]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*[f"`{c}`" for c in keep]).schema.fields] + ["decoded binary"])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            got = [decode(enc, np.asarray(x or [], np.int64)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.binary())], [*keep, "decoded"])

    return tokens.select(*[f"`{c}`" for c in keep], f"`{ids_col}`").mapInArrow(run, out)


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and keeps digests: id, n_tokens, ids_sha256, decoded_sha256, n_bytes. Null is an empty text: no tokens, digests of no bytes."""

    def run(texts: list[bytes]) -> dict:
        enc = encoding(rank_file, pattern)
        n, ids_sha, text_sha = [], [], []
        for x in texts:
            ids = encode(enc, x.decode("utf-8", "replace"))
            n.append(len(ids))
            ids_sha.append(sha(ids.tobytes()))
            text_sha.append(sha(decode(enc, ids)))
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha, "n_bytes": pa.array(map(len, texts), pa.int64())}

    return map_texts(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint", {id_col: F.col(f"`{id_col}`")}, text_col)
