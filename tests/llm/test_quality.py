import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import quality as Q


def test_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = Q.fit(docs, labels.where(~held))
    assert (np.diff(model.thresholds) > 0).all()
    got = Q.grade_texts(docs, model).join(labels.where(held), "doc_id")
    share = lambda c: F.avg(F.col("keep").cast("double")).alias(c)
    clean, bad = (got.where(w).agg(share("s")).first().s for w in ("quality = 1 AND toxic = 0", "quality = 0 OR toxic = 1"))
    assert clean > 0.97 and bad < 0.35
    mean = {r.quality + 1 - r.toxic: r.g for r in got.groupBy("quality", "toxic").agg(F.avg("expected_grade").alias("g")).collect()}
    assert mean[2] > mean[1]


def test_order_and_gradient():
    rng = np.random.default_rng(0)
    lists = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(600)]
    grade = np.clip(np.array([(x < 5).sum() for x in lists]), 0, 2)
    indptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = Q.fit_ordinal(indptr, np.concatenate(lists), np.ones((600, 1)), grade, 3, bits=6, min_z=2)
    total = np.array([model.weights[x].sum() for x in lists]) + model.dense[0]
    tails = model.tails(total)
    assert (tails[:, 0] >= tails[:, 1]).all() and (tails.sum(1).round() == grade).mean() > 0.9
    with pytest.raises(ValueError):
        Q.fit_ordinal(np.zeros(1, int), np.zeros(0, int), np.zeros((0, 1)), np.zeros(0, int), 1)


def test_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 0, 1), (3, 1, 1), (None, 1, 0), (9, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = Q.grade_texts(docs, model)
    assert got.count() == 8 and got.where("tail_probability BETWEEN 0 AND 1 AND expected_grade BETWEEN 0 AND 2").count() == 8
    assert Q.select_good(docs, model, 0.0).count() == 8 and Q.select_good(docs, model, 1.1).count() == 0 and Q.select_good(none, model).columns == docs.columns
    assert Q.grade_texts(none, model).count() == 0
    unrated = Q.fit(docs, labels.limit(0))
    assert Q.select_good(docs, unrated).count() == 8
    one_grade = Q.fit(docs, labels.where("doc_id = 1"))
    assert Q.grade_texts(docs, one_grade).count() == 8
