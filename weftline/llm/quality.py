"""Operator 8: quality classifier. Ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(threshold_k - score), score = weights . features, thresholds in order; all grades share the
weights. Expected grade and tail probabilities follow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import _LOWER_NP, buffers, filter_texts, give_back, hash_spans, map_texts, mix, raw, runs, slices

#: Buckets of hashed features, as a power of two; dense features stand after them.
BITS = 20
DENSE = 6
#: Rated documents in which a bucket must stand to have a weight; rarer ones would only learn the documents by heart.
MIN_DOCS = 8
#: Standard errors by which the mean grade of a bucket's documents must differ from the mean of all.
MIN_Z = 5.5
#: Ratings that the model is fitted on at most, those of the smallest hashes of their ids; this bounds the driver's work.
SAMPLE = 16_000
#: Documents whose probability of the best grade is at least this stay.
KEEP = 0.75

_b = np.arange(256)
_KIND = np.where(np.isin(_b, [32, *range(9, 14)]), 0, np.where((_b >= 128) | ((_b | 32) >= 97) & ((_b | 32) <= 122), 1, np.where((_b >= 48) & (_b <= 57), 2, _b))).astype(np.uint8)
_UPPER = (_b >= 65) & (_b <= 90)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: where each one's distinct buckets begin, the buckets, and dense features (texts x DENSE).

    Tokens are runs of letters (lower-cased), of digits, and of one symbol. A token counts once in a text.
    """
    n = len(offsets) - 1
    kind = _KIND[data]
    starts, ends = runs(kind > 0, offsets, kind)
    h = mix(hash_spans(_LOWER_NP[data], starts, ends)) >> np.uint64(64 - bits)
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    own = np.unique(doc.astype(np.int64) << bits | h.astype(np.int64))
    indptr = np.searchsorted(own, np.arange(n + 1, dtype=np.int64) << bits)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters = kind[starts] == 1 if len(starts) else np.zeros(0, bool)
    caps = letters & (ends - starts > 2) & (upper[ends] - upper[starts] == ends - starts) if len(starts) else letters
    total = np.maximum(np.diff(bounds), 1)
    sums = lambda x: np.bincount(doc, x, n)
    share = lambda x: sums(x) / total
    symbols = kind[starts] > 2 if len(starts) else letters
    dense = np.stack([share(caps), share(symbols), share(letters), np.diff(indptr) / total, np.log1p(total) / 10, np.ones(n)], axis=1)
    return indptr, own & ((1 << bits) - 1), dense


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        indptr, idx, dense = features(data, offsets, self.bits)
        total = np.concatenate([[0.0], np.cumsum(self.weights[idx], dtype=np.float64)])
        return total[indptr[1:]] - total[indptr[:-1]] + dense @ self.dense

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_ordinal(indptr: np.ndarray, idx: np.ndarray, dense: np.ndarray, grade: np.ndarray, n_grades: int, bits: int = BITS, rounds: int = 800, l2: float = 1e-5, rate: float = 0.1, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> Ordinal:
    """Weights and thresholds by Adam on the whole sample; the same input gives the same model. Without ratings every text is taken for the best grade."""
    n = len(grade)
    if n_grades < 2:
        raise ValueError("two grades are needed at least")
    if n == 0:
        return Ordinal(np.zeros(1 << bits, np.float32), np.zeros(DENSE), np.arange(n_grades - 1) - 40.0, bits)
    row = np.repeat(np.arange(n), np.diff(indptr))
    count = np.bincount(idx, minlength=1 << bits)
    apart = np.abs(np.bincount(idx, (grade - grade.mean())[row], 1 << bits)) / (grade.std() + 1e-12)
    used = np.flatnonzero((count >= min_docs) & (apart >= min_z * np.sqrt(count)))
    place = np.full(1 << bits, -1)
    place[used] = np.arange(len(used))
    row, idx = row[place[idx] >= 0], place[idx][place[idx] >= 0]
    size = len(used)
    x = np.zeros(size + dense.shape[1] + n_grades - 1)
    w, v, t = slice(0, size), slice(size, size + dense.shape[1]), slice(size + dense.shape[1], None)
    share = np.array([(grade > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    x[t] = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        score = np.bincount(row, x[w][idx], n) + dense @ x[v]
        theta = np.cumsum(np.concatenate([x[t][:1], np.exp(x[t][1:])]))
        upto = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -40, 40)))
        cdf = np.concatenate([np.zeros((n, 1)), upto, np.ones((n, 1))], axis=1)
        lo, hi = np.take_along_axis(cdf, grade[:, None], 1)[:, 0], np.take_along_axis(cdf, grade[:, None] + 1, 1)[:, 0]
        p = np.maximum(hi - lo, 1e-12)
        slope_lo, slope_hi = lo * (1 - lo), hi * (1 - hi)
        d_score = (slope_hi - slope_lo) / p / n
        g = np.zeros_like(x)
        g[w] = np.bincount(idx, d_score[row], size)
        g[v] = dense.T @ d_score
        d_theta = np.array([(np.where(grade == k + 1, slope_lo, 0) - np.where(grade == k, slope_hi, 0)).dot(1 / p) / n for k in range(n_grades - 1)])
        after = np.cumsum(d_theta[::-1])[::-1]
        g[t] = np.concatenate([after[:1], after[1:] * np.exp(x[t][1:])])
        g[: t.start] += l2 * x[: t.start]
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        x -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = x[w]
    return Ordinal(weights, x[v].copy(), np.cumsum(np.concatenate([x[t][:1], np.exp(x[t][1:])])), bits)


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The grade 0, 1 or 2 of a label: a point for good quality, and one for not being toxic. Null if either is."""
    return (F.col(quality) > 0).cast("int") + (F.col(toxic) <= 0).cast("int")


def fit(docs: DataFrame, labels: DataFrame, grade: Column | None = None, n_grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> Ordinal:
    """Fits on at most sample rated documents. The workers hash the texts; the driver gets buckets only.

    Ratings of null, or out of range, or whose document isn't there, don't count; of an id's ratings the highest does.
    """
    grade = rating() if grade is None else grade
    rated = labels.select(F.col(f"`{id_col}`").alias("id"), grade.alias("grade")).where(f"id is not null and grade between 0 and {n_grades - 1}").groupBy("id").agg(F.max("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), raw(text_col).alias("__text")).join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                indptr, idx, dense = features(*buffers(part.column("__text")), bits)
                lists = pa.ListArray.from_arrays(pa.array(indptr.astype(np.int32)), pa.array(idx.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), lists, pa.array(list(dense), pa.list_(pa.float64()))], ["id", "grade", "idx", "dense"])
            give_back()

    kind = rated.schema["id"].dataType.simpleString()
    got = texts.select("id", "grade", "__text").mapInArrow(run, f"id {kind}, grade int, idx array<int>, dense array<double>").toArrow().sort_by([("id", "ascending")])
    col = lambda c: got.column(c).combine_chunks()
    idx, dense = col("idx"), col("dense")
    n = len(idx)
    indptr = np.concatenate([[0], np.cumsum(np.asarray(idx.value_lengths(), np.int64))]).astype(np.int64) if n else np.zeros(1, np.int64)
    return fit_ordinal(indptr, np.asarray(idx.flatten(), np.int64), np.asarray(dense.flatten()).reshape(n, DENSE), np.asarray(col("grade"), np.int64), n_grades, bits)


def _held(model: Ordinal, spark) -> Callable[[], Ordinal]:
    """The model (four megabytes at 20 bits, whatever the input) as a broadcast."""
    b = spark.sparkContext.broadcast(model)
    return lambda: b.value


def grade_texts(docs: DataFrame, model: Ordinal, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, tail_probability (of the best grade), keep. Null and empty texts are graded by their dense features alone; repeated rows stay."""
    get = _held(model, docs.sparkSession)

    def run(texts: list[bytes]) -> dict:
        m = get()
        tails = m.tails(m.score(*joined(texts)))
        return {"expected_grade": pa.array(tails.sum(axis=1)), "tail_probability": pa.array(tails[:, -1]), "keep": pa.array(tails[:, -1] >= keep)}

    return map_texts(docs, run, "expected_grade double, tail_probability double, keep boolean", {id_col: F.col(f"`{id_col}`")}, text_col)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def select_good(docs: DataFrame, model: Ordinal, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose probability of the best grade is at least keep."""
    get = _held(model, docs.sparkSession)
    return filter_texts(docs, lambda texts: get().tails(get().score(*joined(texts)))[:, -1] >= keep, text_col)
