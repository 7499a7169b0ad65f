import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import ngram_lm as L


class Brute:
    """The same model, counted with dicts."""

    def __init__(self, train, order):
        self.n = order
        seqs = [self.padded(t) for t in train]
        count = {order: Counter(tuple(q[i - order + 1 : i + 1]) for q in seqs for i in range(order - 1, len(q)))}
        for n in range(order - 1, 0, -1):
            count[n] = Counter()
            for g, k in count[n + 1].items():
                count[n][g[1:]] += k if g[1] == "<s>" else 1
        self.count, self.words = count, Counter(w for q in seqs for w in q[order - 1 :])
        self.d = {n: (0, *L.discount(*[sum(v == k for v in count[n].values()) for k in (1, 2, 3, 4)])) for n in count}
        self.after = {n: defaultdict(list) for n in count}
        for n in count:
            for g, k in count[n].items():
                self.after[n][g[:-1]].append(k)

    def padded(self, t):
        return ["<s>"] * (self.n - 1) + (t or "").lower().split() + ["</s>"]

    def p(self, n, h, w):
        if n == 0:
            return 1 / (len(self.words) + 1)
        low, follow = self.p(n - 1, h[1:], w), self.after[n].get(h)
        if not follow:
            return low
        k, d, total = self.count[n].get((*h, w), 0), self.d[n], sum(follow)
        return max(k - d[min(k, 3)], 0) / total + sum(d[min(x, 3)] for x in follow) / total * low

    def score(self, t):
        q = self.padded(t)
        return sum(math.log10(self.p(self.n, tuple(q[i - self.n + 1 : i]), q[i])) for i in range(self.n - 1, len(q)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    rng = random.Random(5)
    words = ["a", "b", "The", "of", "and", "x1", "é"] + [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, weights=[30, 20, 15, 10, 8, 5, 4] + [1] * 30, k=rng.randint(0, 40)))
    train = [text() for _ in range(100)] + ["a " * 400] * 2 + [None]
    test = [text() + " zzz" for _ in range(20)] + ["", "new words only", "w" * 500, *train[:3]]
    model, brute = L.train(spark.createDataFrame([(x,) for x in train], "text string").repartition(3), order), Brute(train, order)
    got = L.score_texts(spark.createDataFrame(list(enumerate(test)), "doc_id bigint, text string"), model, {"doc_id": F.col("doc_id")}).orderBy("doc_id").collect()
    n, v = sum(brute.words.values()), len(brute.words)
    assert (model.n_tokens, model.n_types) == (n, v)
    for r, t in zip(got, test):
        q = brute.padded(t)[order - 1 :]
        assert r.score == pytest.approx(brute.score(t), abs=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((brute.words[w] + 1) / (n + v + 1)) for w in q), abs=1e-9)
        assert (r.n_tokens, r.n_known) == (len(q), sum(w in brute.words for w in q))
    for h in list(brute.after[order])[:5]:
        assert sum(brute.p(order, h, w) for w in [*brute.words, "unknown"]) == pytest.approx(1)


def test_cases(docs, none):
    model = L.train(docs)
    got = {r.doc_id: r for r in L.score_texts(docs, model, {"doc_id": F.col("doc_id")}).collect()}
    assert got[2].n_tokens == got[3].n_tokens == 1 and got[2].score == got[3].score and got[4].n_tokens == 12001
    empty = L.train(none)
    assert empty.n_tokens == 0 and L.score_texts(none, empty, {"doc_id": F.col("doc_id")}).count() == 0
    assert all(r.score <= 0 and r.n_known == 0 for r in L.score_texts(docs, empty, {"doc_id": F.col("doc_id")}).collect())


def test_the_query_looks_two_words_back(spark):
    model = L.train(spark.createDataFrame([(x,) for x in ["a x b", "c x d"] * 5], "text string"))
    got = {r.t: r.score for r in L.score_texts(spark.createDataFrame([("a x b",), ("a x d",)], "text string"), model, {"t": F.col("text")}).collect()}
    assert model.order >= 3 and got["a x b"] > got["a x d"] + 0.1


def test_shards_follow_the_text(spark, monkeypatch):
    """A table in one partition has as many shards as its text needs."""
    docs = spark.range(4000).select(F.concat_ws(" ", F.lit("one text of"), "id").alias("text")).coalesce(1)
    monkeypatch.setattr(L, "SHARD", 1000)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    model = L.train(docs)
    assert size / 1000 <= 1 << model.bits <= 2 * size / 1000 + 2
    assert model.n_tokens == 5 * 4000


def test_frequent_contexts_are_held_once(tmp_path):
    """However often a context's n-grams are shipped, a task holds its distinct ones and the rows that wait."""
    words = np.sort(L.mix(np.arange(1, 101, dtype=np.uint64)))
    L.put_counts(f"{tmp_path}/0/{0:07d}", words, np.ones(100, np.int64))
    ids = np.arange(100, dtype=np.uint64)
    blob = L.pack([np.zeros(100, np.uint64), np.zeros(100, np.uint64), ids], [np.zeros(100, np.int64), np.ones(100, np.int64)])
    taken = [0]

    def batches():
        for _ in range(200):
            taken[0] += 1
            yield L._row([0], [blob], [None])

    sizes, whole = [], L.merged

    def seen(keys, cols, count):
        sizes.append(len(keys))
        return whole(keys, cols, count)

    L.merged = seen
    try:
        out = pa.Table.from_batches(L.sort_shards(3, 2, str(tmp_path), wait=500)(batches()))
    finally:
        L.merged = whole
    assert max(sizes) <= 100 + 500 and taken[0] == 200
    stats = out.column("stats").to_pylist()[0]
    assert stats[0] == 100 and stats[5] == 200 * 100
    own, cols, (lead, below) = L.unpack(next(x for x in out.column("blob").to_pylist() if x is not None))
    assert len(below) == 100 and (below == 1).all() and (lead == 0).all() and len(own) == 100


def test_unmix():
    x = np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(3)
    assert (L.unmix(L.mix(x.copy())) == x).all()
