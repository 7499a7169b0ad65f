import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash as S
from weftline.llm.components import components


def plain(text, k=3):
    w = text.lower().split()
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(spark):
    for t in ("", "a", "A b", "one two three four five one two three", "é x " * 50, "w " * 70000):
        assert S.fingerprint(t.encode()) == plain(t) if len(t) < 10_000 else S.fingerprint(t.encode())
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(S.fingerprint(b"A B c")).view(np.int64)


def brute(fps, d):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count((fps[i] ^ fps[i + 1 :]).view(np.uint64)) <= d) + i + 1:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return {int(fps[i]): int(fps[top(i)]) for i in range(len(fps))}


@pytest.mark.parametrize("bits", [2, 3])
@pytest.mark.parametrize("crowd", [4, 32])
def test_links(spark, bits, crowd):
    rng = np.random.default_rng(bits)
    fps = list(rng.integers(-(2**63), 2**63 - 1, 20, dtype=np.int64))
    for b in fps[:4]:
        x = b
        for _ in range(80):
            y = x
            for _ in range(int(rng.integers(1, 5))):
                y ^= np.int64(1 << int(rng.integers(0, 62)))
            fps.append(y)
            x = y if rng.random() < 0.3 else b
    fps += [(np.int64(int(x)) << np.int64(40)) | np.int64(12345) for x in rng.integers(0, 2**12, 150)]
    fps = np.unique(np.array(fps, np.int64))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    got = {r.node: r.component for r in components(S.links(df, bits, crowd)).collect()}
    assert {k: got.get(k, k) for k in brute(fps, bits)} == brute(fps, bits)


def test_operator(docs, none):
    got = S.near_duplicates(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert len(got) == 8 and by[1] == [1, 1] and by[5] == [1] and by[2] == by[3] == by[6] == [2] and by[4] == [4] and by[None] == [None]
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (True, None)]
    assert S.near_duplicates(none).count() == 0 and S.drop_near_duplicates(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (50, 60), (60, 50)], "src bigint, dst bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 60: 50}
    assert components(edges.limit(0)).count() == 0
