"""Operator 10: removal of repeated byte strings by suffix order and longest previous factors.

A string of LENGTH bytes that also starts earlier goes, with each byte that it covers. Strings meet by content: the least
hash of the GRAM-byte pieces inside a string is its key, so that equal strings have equal keys, and the strings of
neighbouring starts with one key travel as one stretch of text. Keys that stand once in the corpus are left out. The
stretches of a key are put in suffix order, in which a start's previous smaller neighbour at a common prefix of LENGTH bytes
is an earlier match: its longest previous factor is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import hash_store
from weftline.llm.common import mix, new_folder, raw, sha, slices

LENGTH, GRAM = 100, 32
#: Starts in a stretch at most.
STRETCH = 256
#: Starts whose hashes are in memory at once.
PIECE = 4 << 20
#: Occurrences of a key from which on its strings are dealt out by their own hashes.
CROWD = 1500
#: Bytes of stretches that a task puts in suffix order at once.
CHUNK = 1 << 20
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each place on, by doubling; places with fewer bytes after them have none."""
    parts: list[tuple[int, np.ndarray]] = []
    h, n = _TABLE[data], 1
    left, at = size, 0
    while True:
        if left & n:
            parts.append((at, h))
            at += n
            left -= n
            if not left:
                break
        factor = mix(np.array([n], np.uint64))[0] | np.uint64(1)
        h = h[: max(0, len(h) - n)] * factor + h[n:]
        n *= 2
    count = max(0, len(data) - size + 1)
    out = np.zeros(count, np.uint64)
    for i, (off, part) in enumerate(parts):
        out *= np.uint64(0xD6E8FEB86659FD93 + 2 * i)
        out += part[off : off + count]
    return mix(out)


def window_min(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbours."""
    count, n = max(0, len(h) - size + 1), 1
    while 2 * n <= size:
        h = np.minimum(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    return np.minimum(h[:count], h[size - n : size - n + count])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, start and number of starts of each stretch: the starts whose least piece, the first of equals, is one and the same. No stretch crosses texts. Long batches are gone through in pieces."""
    if len(data) > PIECE + length:
        parts = []
        for at in range(0, len(data), PIECE):
            end = min(len(data), at + PIECE + length - 1)
            key, start, n = stretches(data[at:end], np.clip(offsets, at, end) - at, length, gram)
            parts.append((key, start + at, n))
        return tuple(np.concatenate(x) for x in zip(*parts))
    grams = rolling(data, gram)
    keys = window_min(grams, length - gram + 1)
    none = np.zeros(0, np.int64)
    if not len(keys):
        return np.zeros(0, np.uint64), none, none
    new = np.ones(len(keys) + 1, bool)
    # a stretch also ends where its piece of least hash drops out: what repeats inside a text is in several stretches
    new[1:-1] = (keys[1:] != keys[:-1]) | (grams[: len(keys) - 1] == keys[:-1])
    begin, end = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    valid = np.zeros(len(keys) + 1, np.int64)
    np.add.at(valid, np.minimum(begin, len(keys)), 1)
    np.add.at(valid, np.minimum(end, len(keys)), -1)
    inside = np.cumsum(valid[:-1]) > 0
    new[np.minimum(begin, len(keys))] = True
    new[np.minimum(end, len(keys))] = True
    at = np.flatnonzero(new)
    start, n = at[:-1], np.diff(at)
    keep = inside[start]
    start, n = start[keep], n[keep]
    cuts = -(-n // STRETCH)
    more = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start, n = np.repeat(start, cuts) + more * STRETCH, np.minimum(np.repeat(n, cuts) - more * STRETCH, STRETCH)
    return mix(keys[start]), start, n  # least hashes are small; keys spread


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the starts, in the order of precedence, have an earlier start with the same length bytes.

    Suffix order by prefix doubling, cut off at length bytes, ties by place: of starts whose suffixes share length bytes, each
    but the first stands right after an earlier one, its previous smaller value, and has a previous factor of that length.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(n, np.uint64)
    for j in range(8):
        rank = rank << np.uint64(8) | padded[j : j + n]
    have = 8
    while have < length:
        step = min(have, length - have)
        ids = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        after = np.zeros(n, np.uint64)
        after[: n - step] = ids[step:]
        if have + step >= length:
            ids, after = ids[starts], after[starts]
        rank = ids << np.uint64(32) | after
        have += step
    order = np.argsort(rank, kind="stable")
    out = np.zeros(len(starts), bool)
    out[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return out


@dataclass(frozen=True)
class Repeats:
    """Where the keys that stand more than once, and texts that do, are stored."""

    folder: str
    bits: int
    length: int
    gram: int

    def copies(self, ids: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Which texts are whole copies of that of a smaller id."""
        key = np.array([xxhash.xxh64_intdigest(x, 3) for x in texts], np.uint64)
        there, got = hash_store.lookup(f"{self.folder}/texts", self.bits, key, {"first": "<i8", "check": "<i8"})
        check = np.array([xxhash.xxh64_intdigest(x, 4) for x in texts], np.uint64).view(np.int64)
        return there & (got["check"] == check) & (got["first"] < ids) & (np.array([len(x) for x in texts]) >= self.length)


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the smallest integer), own (a hash of the text, which tells texts of one id, or of none, apart) and the bytes. A document is what id and own name."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(raw(text_col)).alias("own"), raw(text_col).alias("__text"))


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    for part in slices(b, 4 << 20):  # what repeats inside a slice isn't shuffled
        yield np.asarray(part.column("id")), np.asarray(part.column("own")), part.column("__text").to_pylist()


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Two passes: whole texts that stand more than once, then keys that do in what is left."""
    spark: SparkSession = docs.sparkSession
    given = _input(docs, id_col, text_col)
    bits = max(1, given.rdd.getNumPartitions()).bit_length()
    store = Repeats(new_folder(spark, "repeats"), bits, length, gram)

    def hashes(batches):
        for b in batches:
            for ids, _, texts in _texts(b):
                texts = [(i, x) for i, x in zip(ids.tolist(), texts) if len(x) >= length]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x, s) for _, x in texts], pa.uint64()).view(pa.int64()) for s in (3, 4)] + [pa.array([i for i, _ in texts], pa.int64())], ["key", "check", "id"])

    whole = given.mapInArrow(hashes, "key bigint, check bigint, id bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min("check").alias("check"), F.max("check").alias("other"))
    # of two texts with one hash of 64 bits, which no corpus will hold, neither is left out whole
    hash_store.write(whole.where("n > 1 and check = other").select("key", "first", "check"), f"{store.folder}/texts", bits, {"first": "<i8", "check": "<i8"})

    def keys(batches):
        for b in batches:
            for ids, _, texts in _texts(b):
                left = [x for x, c in zip(texts, store.copies(ids, texts)) if not c]
                key, n = np.unique(stretches(*_joined(left), length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    often = given.mapInArrow(keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    hash_store.write(often.select("key", F.least("n", F.lit((1 << 31) - 1)).alias("n")), f"{store.folder}/keys", bits, {"n": "<u4"})
    return store


def removed_spans(docs: DataFrame, store: Repeats, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """id, own, lo, hi: byte spans to remove, which may overlap. Whole copies have none."""
    length = store.length

    def met(batches):
        for b in batches:
            for ids, owns, texts in _texts(b):
                copy = store.copies(ids, texts)
                ids, owns, texts = ids[~copy], owns[~copy], [x for x, c in zip(texts, copy) if not c]
                data, offsets = _joined(texts)
                key, start, n = stretches(data, offsets, length, store.gram)
                there, got = hash_store.lookup(f"{store.folder}/keys", store.bits, key, {"n": "<u4"})
                key, start, n, count = key[there], start[there], n[there], got["n"][there]
                full = count > crowd
                if full.any():  # one row for each start
                    cuts = n[full]
                    each = np.repeat(start[full], cuts) + np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                    each_key = np.array([xxhash.xxh64_intdigest(data[s : s + length].tobytes(), 5) for s in each.tolist()], np.uint64)
                    key = np.concatenate([key[~full], each_key])
                    start, n = np.concatenate([start[~full], each]), np.concatenate([n[~full], np.ones(len(each), np.int64)])
                doc = np.searchsorted(offsets, start, side="right") - 1
                order = np.lexsort([start - offsets[doc], owns[doc], ids[doc]]) if len(start) else np.zeros(0, np.int64)
                key, start, n, doc = key[order], start[order], n[order], doc[order]
                place = start - offsets[doc]
                flat, seen, stretch = data.tobytes(), {}, []
                spread = mix(ids[doc].view(np.uint64) * np.uint64(31) + place.astype(np.uint64))
                for i, (s, m, *at) in enumerate(zip(start.tolist(), n.tolist(), ids[doc].tolist(), owns[doc].tolist(), place.tolist())):
                    x = flat[s : s + m + length - 1]
                    if seen.setdefault(x, at) < at:
                        x = None  # stands earlier in this batch
                        key[i] = spread[i]
                    stretch.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(owns[doc]), pa.array(place), pa.array(n), pa.array(stretch, pa.binary())], ["key", "id", "own", "start", "n", "stretch"])

    def solve(batches):
        last, seen, held, size = None, {}, [], 0
        out: list[tuple[int, int, int, int]] = []

        def flush():
            nonlocal held, size
            # keys with one stretch only have nothing to compare
            many = [h for i, h in enumerate(held) if (i and held[i - 1][0] == h[0]) or (i + 1 < len(held) and held[i + 1][0] == h[0])]
            held, size = [], 0
            if not many:
                return
            text = np.frombuffer(b"".join(h[5] for h in many), np.uint8)
            n = np.array([h[4] for h in many])
            base = np.concatenate([[0], np.cumsum(n + length - 1)])[:-1]
            row = np.repeat(np.arange(len(many)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = repeated_starts(text, base[row] + inner, length)
            at = np.flatnonzero(gone)
            if not len(at):
                return
            cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row[at], prepend=-1) != 0))
            for lo, hi in zip(at[cut], [*at[cut[1:] - 1], at[-1]]):
                _, d, o, p, _, _ = many[row[lo]]
                out.append((d, o, p + int(inner[lo]), p + int(inner[hi]) + length))

        def take():
            nonlocal out
            cols = list(zip(*out)) or [(), (), (), ()]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "own", "lo", "hi"])

        for b in batches:
            for k, d, o, p, n, x in zip(*(b.column(i).to_pylist() for i in range(6))):
                if x is None:
                    out.append((d, o, p, p + n + length - 1))
                    continue
                if k != last:
                    if size > chunk:
                        flush()
                    last, seen = k, {}
                first = seen.setdefault(x, (d, o, p))
                if first < (d, o, p):
                    out.append((d, o, p, p + n + length - 1))
                elif first == (d, o, p) and not (held and held[-1][:4] == (k, d, o, p)):
                    held.append((k, d, o, p, n, x))
                    size += len(x)
            yield take()
        flush()
        yield take()

    rows = _input(docs, id_col, text_col).mapInArrow(met, "key bigint, id bigint, own bigint, start bigint, n bigint, stretch binary")
    return rows.repartition("key").sortWithinPartitions("key", "id", "own", "start").mapInArrow(solve, "id bigint, own bigint, lo bigint, hi bigint")


def union(spans: np.ndarray, most: int) -> np.ndarray:
    """Overlapping and touching spans as one, by place, inside a text of most bytes."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")].clip(0, most)
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.concatenate([at[1:] - 1, [len(spans) - 1]])]], 1)


def dedup_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, crowd: int = CROWD) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, and kept: the bytes left as binary, or with digests their SHA-256 as kept_sha256.

    A row for each row. Integer ids; null ids come first. Different texts under one id, or under none, are documents of their
    own, in the order of a hash of their text; rows of one id and one text count as one document. Null and empty
    texts, and those under length bytes, keep all they have. Bytes left need not be valid UTF-8.
    """
    store = find_repeats(docs, length, gram, id_col, text_col)
    spans = removed_spans(docs, store, id_col, text_col, crowd).groupBy("id", "own").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select("id", "own", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("given"), F.xxhash64(raw(text_col)).alias("own"), F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("id"), raw(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            for part in slices(b):
                ids, texts = np.asarray(part.column("id")), part.column("__text").to_pylist()
                copy = store.copies(ids, texts)
                rows = []
                for x, c, lo, hi in zip(texts, copy, part.column("lo").to_pylist(), part.column("hi").to_pylist()):
                    found = np.array([[0, len(x)]]) if c else union(np.stack([lo, hi], 1), len(x)) if lo else np.zeros((0, 2), np.int64)
                    kept, at = [], 0
                    for s, e in found.tolist():
                        kept.append(x[at:s])
                        at = e
                    kept.append(x[at:])
                    left = b"".join(kept)
                    rows.append((len(x), len(x) - len(left), len(found), sha(left) if digests else left))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("given"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digests else pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", last])

    last = "kept_sha256" if digests else "kept"
    return rows.join(spans, ["id", "own"], "left").select("given", "id", "__text", "lo", "hi").mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if digests else 'binary'}")
