from pyspark.sql import functions as F

from weftline.llm import token_rollup as R
from weftline.llm.common import new_folder

SCHEMA = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"


def rows(df):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_commits(spark):
    roll = R.TokenRollup(spark, new_folder(spark, "rollup"))
    assert roll.totals().count() == 0
    make = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    first = make(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", 3, None))
    assert roll.commit("1", first) and not roll.commit("1", first)
    assert rows(roll.totals()) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 3)}
    roll.commit("2", make(("revise", "a", "en", "v1", 7, 5), ("delete", None, None, "v1", 3, None)))
    assert rows(roll.totals()) == {("a", "en", "v1"): (2, 17)}
    roll.compact()
    assert not roll.commit("2", first) and rows(roll.totals()) == {("a", "en", "v1"): (2, 17)}
    roll.commit("3", make(("insert", "b", "en", "v2", None, None)))
    roll.commit("4", first.limit(0))
    again = R.TokenRollup(spark, roll.folder)
    assert rows(again.totals()) == {("a", "en", "v1"): (2, 17), ("b", "en", "v2"): (1, 0)}


def test_unknown_op(spark):
    import pytest

    roll = R.TokenRollup(spark, new_folder(spark, "rollup"))
    with pytest.raises(Exception, match="unknown op"):
        roll.commit("x", spark.createDataFrame([("upsert", "a", "en", "v1", 1, None)], SCHEMA))
    assert roll.totals().count() == 0


def test_counts(docs):
    got = {r.doc_id: (r.words_v1, r.words_v2) for r in R.word_counts(docs).collect()}
    assert got[1] == (9, 9) and got[2] == got[3] == got[6] == (0, 0)
    assert R.changes(R.word_counts(docs), "insert", "v1", F.col("words_v1")).count() == 8
