"""Operator 2: SimHash near-dedup by deletion-variant signatures.

Fingerprints that differ in at most d bits are cut into d // 2 + 1 segments, so that one segment differs by at most one
bit. Each segment goes into the index once for each of its bits, with that bit as a wildcard; equal variants meet in an
equality join, and the full fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, checkpoint, map_texts, raw
from weftline.llm.components import components

#: Neighbours in a bucket, in the order of fingerprints, that a fingerprint is compared with. Fuller buckets are also linked by balls.
CROWD = 32
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; without words, 0."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest, n = xxhash.xxh64_intdigest, len(w) - shingle + 1
    ends = ends[shingle - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(flat[s:e], seed) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp bigint (the fingerprint's bits), text_hash bigint. Null and empty texts have fingerprint zero; repeated rows stay."""

    def run(texts: list[bytes]) -> dict:
        seen: dict[bytes, int] = {}
        for x in texts:
            if x not in seen:
                seen[x] = fingerprint(x, shingle)
        return {"fp": pa.array(np.array([seen[x] for x in texts], np.uint64).view(np.int64))}

    return map_texts(docs, run, "fp bigint", {id_col: F.col(f"`{id_col}`"), "text_hash": F.xxhash64(raw(text_col))}, text_col)


def variants(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """key, fp: for each segment and each of its bits, the segment's number, the bit's number and the segment with that bit cleared."""
    n = max_bits // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    each = [
        F.xxhash64(F.lit(b), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 63 else -1)).bitwiseAND(F.bitwise_not(F.lit(1 << (b - lo)))))
        if hi - lo > 32
        else F.lit(b << 40).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).bitwiseAND(F.bitwise_not(F.lit(1 << (b - lo)))))
        for lo, hi in zip(edges, edges[1:])
        for b in range(lo, hi)
    ]
    return fps.select(F.explode(F.array(*[e.cast("bigint") for e in each])).alias("key"), "fp")


def _links(max_bits: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        for b in batches:
            old = len(key)
            key = np.concatenate([key, np.asarray(b.column(0))])
            fp = np.concatenate([fp, np.asarray(b.column(1))])
            left, right = [], []
            at = np.arange(len(key))
            for d in range(1, crowd + 1):
                at = at[at + d < len(key)]
                at = at[key[at] == key[at + d]]
                if not len(at):
                    break
                i = at[at + d >= old]
                if d == crowd:  # not compared with all of its bucket
                    left += [fp[i], fp[i + d]]
                    right += [fp[i], fp[i + d]]
                    break
                i = i[np.bitwise_count((fp[i] ^ fp[i + d]).view(np.uint64)) <= max_bits]
                left.append(np.minimum(fp[i], fp[i + d]))
                right.append(np.maximum(fp[i], fp[i + d]))
            if left:
                pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
                pairs = forest(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])
            key, fp = key[-crowd:], fp[-crowd:]

    return run


def forest(pairs: np.ndarray) -> np.ndarray:
    """As many of the pairs as join what all of them join; pairs of equals stay."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = p
        return x

    keep = np.zeros(len(pairs), bool)
    for i, (a, b) in enumerate(pairs.tolist()):
        if a == b:
            keep[i] = True
        elif (x := top(a)) != (y := top(b)):
            root[max(x, y)] = min(x, y)
            keep[i] = True
    return pairs[keep]


def links(fps: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (src, dst) that connect what all pairs of distinct fps at max_bits or fewer connect.

    A bucket's fingerprints are sorted; each is compared with the next crowd - 1. The members of fuller buckets that this
    leaves unfinished are linked by balls: all that flipped bits bring to one value meet there. A bucket's pairs are never all
    emitted.
    """
    met = variants(fps, max_bits).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(max_bits, crowd), "src bigint, dst bigint")
    met = checkpoint(met)
    full = met.where("src = dst").select(F.col("src").alias("fp")).distinct()
    return met.where("src <> dst").unionByName(_balls(full, max_bits))


def _balls(full: DataFrame, max_bits: int) -> DataFrame:
    """Links between fingerprints of full buckets, without comparing them in pairs.

    Two fingerprints at most max_bits apart have a value between them, at most max_bits // 2 bits from the one and the rest
    from the other. All that reach a value link to the smallest of those that reach it by the shorter way; they are
    max_bits apart at most.
    """
    one = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    flip = lambda df: df.select("fp", F.explode(one).alias("bit"), "at").select("fp", F.col("at").bitwiseXOR(F.col("bit")).alias("at")).distinct()
    short = full.select("fp", F.col("fp").alias("at"))
    for _ in range(max_bits // 2):
        short = flip(short)
    long = flip(short) if max_bits % 2 else short
    # the planner doesn't see how many rows explode makes, and would broadcast them
    low = short.groupBy("at").agg(F.min("fp").alias("m")).hint("merge")
    return long.join(low, "at").where("fp <> m").select(F.col("fp").alias("src"), F.col("m").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, fp and component_id, the smallest id that links of at most max_bits differing bits reach.

    A row for each row. Null and empty texts share fingerprint zero, which links like any other; null ids don't count as
    smallest, and a component of null ids only has a null component_id; an empty table has no rows; other columns are left out.
    """
    marked = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    fps = checkpoint(marked.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")))
    joined = components(links(fps.select("fp"), max_bits))
    named = fps.join(joined, fps.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fp").select(f"`{id_col}`", "text_hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, with one row of each component: that of its smallest id, null ids last, and of repeated rows one."""
    marked = checkpoint(near_duplicates(docs, shingle, max_bits, id_col, text_col).withColumnRenamed(id_col, "id"))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")).alias("k")
    # components of null ids only have no name and are told apart by fingerprint
    keep = marked.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(first).select("k.id", "k.text_hash")
    keep = keep.select(F.col("id").alias("__keep_id"), F.col("text_hash").alias("__keep_hash"))
    mine = docs.withColumn("__row_hash", F.xxhash64(raw(text_col)))
    out = mine.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col("__keep_id")) & (F.col("__row_hash") == F.col("__keep_hash")), "left_semi")
    if not marked.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, "__row_hash"])
    return out.drop("__row_hash")
