"""Operator 1: interpolated modified Kneser-Ney language model.

Spark counts n-grams: tasks count their own, ship packed counts by the hash of the n-gram's context, and merge them into
sorted hash arrays in the shared folder. Each level's distinct n-grams give the continuation counts of the level below.
Workers map the arrays into memory and look up the n-grams of the texts that they score.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import buffers, checkpoint, mix, new_folder, raw, release, slices, space_words
from weftline.llm.hash_store import mapped, put

#: Words of an n-gram.
ORDER = 3
#: Bytes of text for which there is a shard, at least, and rows of n-grams that wait until they are merged with what a shard holds.
SHARD, WAIT = 13 << 20, 1 << 21
BOS, END, EMPTY = np.uint64(0x5C3D91F0A7B24E61), np.uint64(0xE19A40C2D8673BF5), np.uint64(0x1F83D9ABFB41BD6B)
#: What stands for the start's hash among the ids of words.
START = np.uint64(1 << 63)
#: A context's place and sums.
ROW = np.dtype([("at", "<u4"), ("sums", "u1", 4)])
_STEP = np.uint64(0x9FB21C651E98DF25)


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word."""
    return mix(context * _STEP + word)


def unmix(h: np.ndarray) -> np.ndarray:
    """The words that mix() turns into these."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h ^= (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, each text's with an end after them, and how many each text has."""
    words, n = space_words(data, offsets)
    return np.insert(words, np.cumsum(n), END), n + 1


def contexts(toks: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the hashes of its contexts of 0, 1, ... order - 1 words; before a text stand starts."""
    place = np.arange(len(toks)) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for k in range(order):
        h = np.full(len(toks), EMPTY)
        for back in range(k, 0, -1):
            before = np.full(len(toks), BOS)
            before[back:] = np.where(place[back:] >= back, toks[:-back] if back else toks, BOS)
            h = extend(h, before)
        out.append(h)
    return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers, byte by byte of a number, so that what is alike stands together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _by_count(n: np.ndarray) -> np.ndarray:
    """Places of a blob's words in the order in which the columns number them: the most frequent first."""
    return np.argsort(-n.astype(np.int64), kind="stable")


def pack(cols: list[np.ndarray], small: list[np.ndarray]) -> bytes:
    """Columns of word ids, sorted, by the numbers of the blob's words; these by their distances; and columns of small numbers. All compressed."""
    own, at, n = np.unique(np.concatenate(cols), return_inverse=True, return_counts=True)
    rank = np.empty(len(own), "<u4")
    rank[_by_count(n)] = np.arange(len(own), dtype="<u4")
    of = rank[at].reshape(len(cols), -1)
    order = np.lexsort(of[::-1])
    of, small = of[:, order], [x[order] for x in small]
    of[0] = np.diff(of[0], prepend=of[0][:1] * 0)
    press = zstandard.ZstdCompressor(level=1)
    numbers = [np.diff(own, prepend=own[:1] * 0).astype("<u8"), n.astype("<u4"), *(x.astype("<u4") for x in (*of, *small))]
    parts = [press.compress(_planes(x)) for x in numbers]
    return struct.pack(f"<II{len(parts)}I", len(cols), len(parts), *map(len, parts)) + b"".join(parts)


def unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The blob's words, most frequent first, columns of their numbers, and columns of small numbers."""
    n_cols, n = struct.unpack_from("<II", blob)
    sizes = struct.unpack_from(f"<{n}I", blob, 8)
    at, parts = 8 + 4 * n, []
    for i, s in enumerate(sizes):
        parts.append(_numbers(blob[at : at + s], "<u4" if i else "<u8"))
        at += s
    own, count, cols, small = np.cumsum(parts[0], dtype=np.uint64), parts[1], parts[2 : 2 + n_cols], parts[2 + n_cols :]
    cols[0] = np.cumsum(cols[0], dtype=np.uint32)
    return own[_by_count(count)], cols, [x.astype(np.int64) for x in small]


def _by_shard(shard: np.ndarray):
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    return zip(shard[at].tolist(), at, [*at[1:], len(shard)])


def word_ids(folder: str, bits: int, words: np.ndarray) -> np.ndarray:
    """Ids of sorted distinct word hashes: their shard and place among the words' own counts."""
    out = np.zeros(len(words), np.uint64)
    for s, lo, hi in _by_shard((words >> np.uint64(64 - bits)).astype(np.int64)):
        held = mapped(f"{folder}/0/{s:07d}.gram", "<u8")
        place = np.searchsorted(held, words[lo:hi])
        if len(held) == 0 or (held[np.minimum(place, len(held) - 1)] != words[lo:hi]).any():
            raise RuntimeError("a text changed between two passes over it")
        out[lo:hi] = np.uint64(s << 32) | place.astype(np.uint64)
    return out


def id_words(folder: str, ids: np.ndarray) -> np.ndarray:
    """Word hashes of sorted distinct ids."""
    out = np.full(len(ids), BOS)
    known = ids[: np.searchsorted(ids, START)]
    for s, lo, hi in _by_shard((known >> np.uint64(32)).astype(np.int64)):
        out[lo:hi] = mapped(f"{folder}/0/{s:07d}.gram", "<u8")[(known[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return out


SCHEMA = "shard bigint, blob binary, stats array<bigint>"


def _row(shard: list[int], blob: list[bytes | None], stats: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(blob, pa.binary()), pa.array(stats, pa.list_(pa.int64()))], ["shard", "blob", "stats"])


def shipped(bits: int, by: np.ndarray, cols: list[np.ndarray], small: list[np.ndarray]) -> pa.RecordBatch:
    """Packed counts of n-grams by shard, which the hash of their context gives: their words' ids, leading starts and counts."""
    order = np.argsort(by, kind="stable")
    shards, blobs = [], []
    for s, lo, hi in _by_shard((by[order] >> np.uint64(64 - bits)).astype(np.int64)):
        o = order[lo:hi]
        shards.append(s)
        blobs.append(pack([c[o] for c in cols], [x[o] for x in small]))
    return _row(shards, blobs, [None] * len(shards))


def shipped_words(bits: int, words: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Counts of sorted distinct words by shard, each shard's hashes before its counts."""
    rows = [(s, words[lo:hi].astype("<u8").tobytes() + count[lo:hi].astype("<u4").tobytes()) for s, lo, hi in _by_shard((words >> np.uint64(64 - bits)).astype(np.int64))]
    return _row([s for s, _ in rows], [b for _, b in rows], [None] * len(rows))


def merged(keys: np.ndarray, cols: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """One row for each key, sorted, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], [c[order][first] for c in cols], np.add.reduceat(count[order], first)


def chain(words: list[np.ndarray]) -> np.ndarray:
    """The hash of a row of words."""
    h = np.full(len(words[0]) if words else 1, EMPTY)
    for w in words:
        h = extend(h, w)
    return h


def _blobs(batches):
    """Shard and blob of each row, one by one."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py()


def folded(batches, read, fold, wait: int):
    """Shard and what fold makes of its parts, shard by shard. read gives a blob's part and rows; parts are folded whenever wait rows are there, so that what stands often counts once."""
    held, parts, rows = {}, defaultdict(list), 0

    def settle():
        for s in sorted(parts):
            held[s] = fold(held.pop(s, None), parts.pop(s))

    for s, x in _blobs(batches):
        part, n = read(x)
        parts[s].append(part)
        rows += n
        if rows >= wait:
            settle()
            rows = 0
    settle()
    for s in sorted(held):
        yield s, held.pop(s)


def put_counts(at: str, keys: np.ndarray, count: np.ndarray) -> list[int]:
    """Writes sorted keys and counts, half a byte each, larger ones beside them; what discounts need of them."""
    big = np.flatnonzero(count >= 15)
    small = np.minimum(np.append(count, [0] * (len(count) % 2)), 15).astype("u1")
    put(f"{at}.gram", keys.astype("<u8").tobytes())
    put(f"{at}.count", (small[::2] | small[1::2] << 4).tobytes())
    if len(big):
        put(f"{at}.big", np.stack([big, count[big]], 1).astype("<i8").tobytes())
    return [len(keys), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int(count.sum()), int((count >= 3).sum())]


def put_sums(at: str, ctx: np.ndarray, count: np.ndarray) -> None:
    """Writes sorted contexts and a byte for each: how many words follow once and twice, if no more tell its sums; other sums in rows beside them."""
    by = np.argsort(ctx, kind="stable")
    c, k = ctx[by], count[by]
    head = np.flatnonzero(np.diff(c, prepend=~c[:1]) != 0)
    sums = np.stack([np.add.reduceat(x.astype(np.int64), head) for x in (k, k == 1, k == 2, k >= 3)], 1)
    brief = (sums[:, 3] == 0) & (sums[:, 1] < 16) & (sums[:, 2] < 15)
    some = np.flatnonzero(~brief)
    big = np.flatnonzero(sums[:, 0] >= 255)  # the sum of counts is the largest of a row
    rows = np.zeros(len(some), ROW)
    rows["at"], rows["sums"] = some, np.minimum(sums[some], 255)
    put(f"{at}.context", c[head].astype("<u8").tobytes())
    put(f"{at}.brief", np.where(brief, sums[:, 1] + 16 * sums[:, 2], 255).astype("u1").tobytes())
    if len(some):
        put(f"{at}.sums", rows.tobytes())
    if len(big):
        put(f"{at}.bigsums", np.concatenate([big[:, None], sums[big]], 1).astype("<i8").tobytes())


def read_counts(at: str, place: np.ndarray) -> np.ndarray:
    """Counts at these places of a shard."""
    out = (mapped(f"{at}.count", "u1")[place >> 1] >> (4 * (place & 1)).astype("u1") & 15).astype(np.int64)
    if (big := np.flatnonzero(out == 15)).size:
        more = mapped(f"{at}.big", "<i8").reshape(-1, 2)
        out[big] = more[np.searchsorted(more[:, 0], place[big]), 1]
    return out


def read_sums(at: str, place: np.ndarray) -> np.ndarray:
    """Rows of sums at these places of a shard's contexts."""
    x = mapped(f"{at}.brief", "u1")[place].astype(np.int64)
    out = np.stack([(x & 15) + 2 * (x >> 4), x & 15, x >> 4, np.zeros_like(x)], 1)
    if (some := np.flatnonzero(x == 255)).size:
        rows = mapped(f"{at}.sums", ROW)
        out[some] = rows["sums"][np.searchsorted(rows["at"], place[some].astype("<u4"))]
    if (big := np.flatnonzero((x == 255) & (out[:, 0] == 255))).size:
        more = mapped(f"{at}.bigsums", "<i8").reshape(-1, 5)
        out[big] = more[np.searchsorted(more[:, 0], place[big]), 1:]
    return out


def sort_words(bits: int, folder: str, wait: int = WAIT):
    """The task that merges the words' own counts and writes their arrays."""

    def read(x: bytes):
        n = len(x) // 12
        return (np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u4", n, 8 * n).astype(np.int64)), n

    def fold(own, parts):
        words, count = (np.concatenate(c) for c in zip(*([own] if own else []), *parts))
        words, _, count = merged(words, [], count)
        return words, count

    def run(batches):
        for s, (words, count) in folded(batches, read, fold, wait):
            yield _row([s], [None], [put_counts(f"{folder}/0/{s:07d}", words, count)])

    return run


def sort_shards(level: int, bits: int, folder: str, wait: int = WAIT):
    """The task that merges a level's packed counts, writes the arrays and ships the level below.

    It holds the distinct n-grams of a shard and about wait rows of counts, however often a frequent context was shipped.
    """

    def read(x: bytes):
        own, cols, (lead, count) = unpack(x)
        return (own, cols, lead.astype(np.uint8) if level < 256 else lead, count), len(count)

    def fold(own, parts):
        ids = np.unique(np.concatenate([p[0] for p in parts]))
        hashes, rows = id_words(folder, ids), [own] if own else []
        while parts:
            words, cols, lead, count = parts.pop()
            h = hashes[np.searchsorted(ids, words)]
            w = [h[c] for c in cols]
            ctx = chain(w[:-1])
            rows.append([extend(ctx, w[-1]) if level > 1 else w[-1], *([ctx] if level > 1 else []), *([chain(w[1:-1])] if level > 2 else []), *(words[c] for c in cols[1:]), lead, count])
        cols = []
        for i in range(len(rows[0])):
            cols.append(np.concatenate([r[i] for r in rows]))
            for r in rows:
                r[i] = None
        keys, cols, count = merged(cols[0], cols[1:-1], cols[-1])
        return [keys, *cols, count]

    def run(batches):
        for s, (keys, *cols, count) in folded(batches, read, fold, wait):
            at = f"{folder}/{level}/{s:07d}"
            stats = put_counts(at, keys, count)
            if level > 1:
                put_sums(at, cols[0], count)
            yield _row([s], [None], [stats])
            if level > 1:
                ctx, *own, lead = cols
                last = unmix(keys) - ctx * _STEP  # the n-gram's last word
                low = own.pop(0) if level > 2 else last  # what deals out the level below
                del ctx, cols, keys
                # an n-gram counts once for the one below it, or as often as it stands if that begins a text
                below = np.where(lead >= 2, count, 1)
                _, (low, *own, lead), below = merged(extend(low, last) if level > 2 else last, [low, *own, np.maximum(lead, 1) - 1], below)
                yield shipped(bits, low, own, [lead, below])

    return run


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    order: int
    n_tokens: int
    n_types: int
    #: By level: discounts for counts of 1, 2 and 3 or more.
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    #: Of the lowest level: sum of counts, and what its discounts leave, as a share.
    total: int = 0
    left: float = 1.0

    def _find(self, level: int, by: np.ndarray, keys: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard and place of each key, and whether it is there; keys are sorted by shard."""
        shard = (by >> np.uint64(64 - self.bits)).astype(np.int64)
        place, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(at, [*at[1:], len(keys)]):
            held = mapped(f"{self.folder}/{level}/{shard[lo]:07d}.{kind}", "<u8")
            if len(held):
                p = np.minimum(np.searchsorted(held, keys[lo:hi]), len(held) - 1)
                place[lo:hi], there[lo:hi] = p, held[p] == keys[lo:hi]
        return shard, place, there

    def counts(self, level: int, by: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of a level's n-grams, by the hash that deals out shards and their own."""
        order = np.lexsort([keys, by >> np.uint64(64 - self.bits)])
        shard, place, there = self._find(level, by[order], keys[order], "gram")
        out = np.zeros(len(keys), np.int64)
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(at, [*at[1:], len(keys)]):
            hit = lo + np.flatnonzero(there[lo:hi])
            if not len(hit):
                continue
            out[order[hit]] = read_counts(f"{self.folder}/{level}/{shard[lo]:07d}", place[hit])
        return out

    def sums(self, level: int, ctx: np.ndarray) -> np.ndarray:
        """Of contexts: sum of counts, and how many words follow once, twice, and three times or more."""
        order = np.argsort(ctx)
        shard, place, there = self._find(level, ctx[order], ctx[order], "context")
        out = np.zeros((len(ctx), 4), np.int64)
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(at, [*at[1:], len(ctx)]):
            hit = lo + np.flatnonzero(there[lo:hi])
            if len(hit):
                out[order[hit]] = read_sums(f"{self.folder}/{level}/{shard[lo]:07d}", place[hit])
        return out

    def _rest(self, level: int, count: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level]])
        return np.maximum(count - d[np.minimum(count, 3)], 0)

    def probabilities(self, toks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability after its context, and its count in training."""
        words, at = np.unique(toks, return_inverse=True)
        base = self.counts(0, words, words)
        p = np.full(len(words), 1.0 / (self.n_types + 1))
        if self.total:
            p = self._rest(1, self.counts(1, words, words)) / self.total + self.left * p
        p = p[at]
        for level, ctx in enumerate(contexts(toks, n, self.order)[1:], 2):
            gram, where, g_at = np.unique(extend(ctx, toks), return_index=True, return_inverse=True)
            rest = self._rest(level, self.counts(level, ctx[where], gram))[g_at]
            some, c_at = np.unique(ctx, return_inverse=True)
            s = self.sums(level, some)
            total = np.maximum(s[:, 0], 1)
            left = np.where(s[:, 0] > 0, s[:, 1:] @ np.array(self.discounts[level]) / total, 1.0)
            p = rest / total[c_at] + left[c_at] * p
        return p, base[at]


def discount(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts; where counts of counts are too few for them, 0.5, 1 and 1.5."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def _stats(rows: DataFrame) -> list[int]:
    """Sums over the shards of a level."""
    got = rows.where("stats is not null").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(7)]).first()
    return [x or 0 for x in got]


def shard_bits(given: DataFrame) -> int:
    """Bits that number the shards: a shard for each SHARD bytes of text, whatever the table's partitions are."""
    size = given.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    return max(2, (size // SHARD).bit_length())


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> Model:
    """A model of all texts given, null and empty ones too, each of which is an end. Without texts, all tokens are unknown."""
    if order < 1:
        raise ValueError("order is one at least")
    given = docs.select(raw(text_col).alias("__text"))
    bits = shard_bits(given)
    folder = new_folder(docs.sparkSession, "lm")
    # each shard has a task of its own
    dealt = lambda rows: rows.where("blob is not null").repartitionById(1 << bits, F.col("shard").cast("int"))

    def words(batches):
        for b in batches:
            for part in slices(b, 8 << 20):
                toks, _ = tokens(*buffers(part.column("__text")))
                yield shipped_words(bits, *np.unique(toks, return_counts=True))

    def grams(batches):
        for b in batches:
            for part in slices(b, 16 << 20):
                toks, n = tokens(*buffers(part.column("__text")))
                place = np.arange(len(toks)) - np.repeat(np.cumsum(n) - n, n)
                ctx = contexts(toks, n, order)[-1]
                _, where, c = np.unique(extend(ctx, toks) if order > 1 else toks, return_index=True, return_counts=True)
                own, at = np.unique(toks, return_inverse=True)
                ids = word_ids(folder, bits, own)[at]
                cols = [np.where(place[where] >= back, ids[where - back], START) for back in range(order - 1, -1, -1)]
                yield shipped(bits, (ctx if order > 1 else toks)[where], cols, [np.maximum(order - 1 - place[where], 0), c])

    own = checkpoint(dealt(given.mapInArrow(words, SCHEMA)).mapInArrow(sort_words(bits, folder), SCHEMA))
    types = _stats(own)
    release(own)
    discounts, rows = {}, given.mapInArrow(grams, SCHEMA)
    low = [0] * 7
    for level in range(order, 0, -1):
        above, rows = rows, checkpoint(dealt(rows).mapInArrow(sort_shards(level, bits, folder), SCHEMA))
        if level < order:
            release(above)
        low = _stats(rows)
        discounts[level] = discount(*low[1:5])
    release(rows)
    left = sum(d * n for d, n in zip(discounts[1], (low[1], low[2], low[6]))) / low[5] if low[5] else 1.0
    return Model(folder, bits, order, types[5], types[0], discounts, low[5], left)


def score_texts(docs: DataFrame, model: Model, keys: dict[str, Column], text_col: str = "text") -> DataFrame:
    """keys, n_tokens, n_known, base_score and score of each text: log10 probabilities under add-one counts and under the model. Null and empty texts are one end; repeated rows stay."""
    given = docs.select(*[c.alias(n) for n, c in keys.items()], raw(text_col).alias("__text"))
    names = list(keys)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + ["n_tokens bigint, n_known bigint, base_score double, score double"])
    floor = np.log10(model.n_tokens + model.n_types + 1)

    def run(batches):
        for b in batches:
            for part in slices(b, 8 << 20):
                toks, n = tokens(*buffers(part.column("__text")))
                p, c = model.probabilities(toks, n)
                at = np.cumsum(n) - n
                of = [np.add.reduceat(x, at) for x in ((c > 0).astype(np.int64), np.log10(c + 1) - floor, np.log10(p))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names), pa.array(n), *map(pa.array, of)], [*names, "n_tokens", "n_known", "base_score", "score"])

    return given.mapInArrow(run, schema)
