import hashlib
import random

import numpy as np
import pytest

from weftline.llm import suffix_dedup as S


def brute(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd,piece", [(1500, 4 << 20), (3, 4 << 20), (1500, 3000)])
def test_against_brute_force(spark, monkeypatch, crowd, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    rng = random.Random(3)
    words = ["the", "of", "and", "é", "tion"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, docs = [text(40) for _ in range(5)], [(1000, None), (1001, "")]
    for i in range(150):
        r = rng.random()
        if r < 0.1 and i:
            t = rng.choice(docs)[1]
        elif r < 0.35:
            t = text(rng.randint(0, 80)) + rng.choice(shared) + text(rng.randint(0, 50))
        elif r < 0.45:
            t = rng.choice(["a" * 500, "ab" * 400, "xyz " * 200]) + text(5)
        else:
            t = text(rng.randint(0, 120))
        docs.append((i, t))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup_strings(df, digests=True, crowd=crowd).collect()}
    assert got == brute(docs, 100)


def test_repeats_inside_one_text(spark):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    docs = [(0, line(50) * 5), (1, line(99) * 3 + line(40)), (2, line(7) * 60), (3, "z" * 900), (4, line(130) + line(300)), (5, (x := line(160)) + line(90) + x)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup_strings(spark.createDataFrame(docs, "doc_id bigint, text string"), digests=True).collect()}
    assert got == brute(docs, 100) and all(got[i][1] > 0 for i in (0, 1, 2, 3, 5))


def test_cases(docs, none):
    got = S.dedup_strings(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"] and got.count() == 8
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].n_bytes == 0 and rows[5].n_removed == 0 and rows[4].n_removed > 60_000 and rows[None].n_removed == 0
    assert S.dedup_strings(none).count() == 0


def test_repeated_starts():
    text = np.frombuffer(b"abcabcabcabc", np.uint8)
    assert S.repeated_starts(text, np.arange(4), 9).tolist() == [False, False, False, True]


def test_texts_of_one_id(spark):
    """Different texts under one id, and under none, keep what doesn't repeat."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choices("abcdefghijklmnop ", k=300))
    first, lone, other, third = (text() for _ in range(4))
    rows = [(0, first), (7, first[50:250]), (7, lone), (None, other), (None, third), (None, third), (9, "x" + other[:150])]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.dedup_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(True, 0, 300, 0), (True, 7, 200, 200), (True, 7, 300, 0), (False, 0, 300, 0), (False, 0, 300, 0), (False, 0, 300, 0), (True, 9, 151, 150)])
