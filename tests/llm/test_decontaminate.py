import random

import numpy as np

from weftline.llm import decontaminate as D


def brute(words, items, window):
    marks, found = np.zeros(len(words), bool), set()
    for item, text in items:
        w = D.words(text)
        for p in [w[i : i + window] for i in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []:
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    marks[at : at + len(p)] = True
                    found.add(item)
    return marks, found


def test_search():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdé") for _ in range(n)).encode()
    for _ in range(40):
        items = [(str(i), text(rng.choice([0, 1, 2, 5, 6, 9]))) for i in range(6)]
        doc = D.words(text(300))
        marks, found = D.hits(D.matchers(items, 5), doc)
        want, want_found = brute(doc, items, 5)
        assert found == want_found and (marks if len(marks) else np.zeros(300, bool)).tolist() == want.tolist()


def test_operator(spark, docs, none):
    fox = "The QUICK brown-fox jumps over the lazy dog"
    bench = spark.createDataFrame([("b", fox), ("a", "lazy dog"), (None, "zzz"), ("c", None), ("d", "")], "item_id string, text string")
    for block in (1, 1 << 20):
        got = {r.doc_id: r for r in D.benchmark_overlap(docs, bench, block_bytes=block).collect()}
        assert (got[5].n_words, got[5].n_hit, got[5].item_ids, got[5].contaminated) == (9, 9, ["a", "b"], True)
        assert (got[2].n_words, got[2].contaminated, got[4].n_hit) == (0, False, 0)
    assert D.benchmark_overlap(docs, bench.limit(0)).where("contaminated").count() == 0
    assert D.benchmark_overlap(none, bench).count() == 0
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5


def test_benchmarks_one_after_another(spark):
    """Workers live on from one benchmark to the next; none may meet an older one's tables."""
    passage = lambda i: " ".join(f"word{i}x{k}" for k in range(13))
    docs = spark.createDataFrame([(i, f"before {passage(i)} after") for i in range(25)], "doc_id int, text string").repartition(3).cache()
    for i in range(25):
        bench = spark.createDataFrame([(f"item{i}", passage(i))], "item_id string, text string")
        assert [(r.doc_id, r.item_ids) for r in D.benchmark_overlap(docs, bench).where("n_hit > 0").collect()] == [(i, [f"item{i}"])]
        if i % 8 == 0:
            assert sorted(r.doc_id for r in D.remove_contaminated(docs, bench).collect()) == [x for x in range(25) if x != i]


def test_blocks_over_tasks(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items = [(f"i{k}", text(rng.choice([1, 3, 5, 6, 8]))) for k in range(12)]
    rows = [(i, text(rng.choice([0, 4, 30, 200]))) for i in range(60)]
    docs, bench = spark.createDataFrame(rows, "doc_id int, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string")
    for block in (1, 20, 1 << 20):
        got = {r.doc_id: r for r in D.benchmark_overlap(docs, bench, window=5, block_bytes=block).collect()}
        kept = {r.doc_id for r in D.remove_contaminated(docs, bench, window=5, block_bytes=block).collect()}
        for i, x in rows:
            w = D.words(x.encode())
            marks, found = brute(w, [(k, t.encode()) for k, t in items], 5)
            assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), int(marks.sum()), sorted(found))
            full, _ = brute(w, [(k, t.encode()) for k, t in items if len(t.split()) >= 5], 5)
            assert (i in kept) == (not full.any() and not (marks.any() and 20 * marks.sum() >= len(w)))
