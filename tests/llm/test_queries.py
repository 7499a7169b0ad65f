import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from weftline.llm import decontaminate, queries


def test_oracle(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf)
        want = con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, spark.createDataFrame(want.df()).select(*cols).collect())), name


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.count() == n if name not in ("op5_line_dedup", "op6_token_counts") else got.count() > 0
    assert name in entry.queries()


def test_pipeline(spark, sf):
    """Each stage on what the one before kept; the decisions of each hold on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == len(set(ids))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == cols
        if name == "line_dedup":
            lines = out.select(F.explode(F.split("text", "\n")).alias("x")).where("trim(x) <> ''")
            assert lines.count() == lines.select(F.lower(F.trim("x"))).distinct().count() and out.count() == docs.count()
        if name == "simhash_near_dedup":
            assert out.count() == out.select("text").distinct().count()
        if name == "benchmark_decontamination":
            marks = decontaminate.benchmark_overlap(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert sorted(ids) == sorted(r.doc_id for r in marks.where("n_hit = 0").collect())  # all items fill a window
        seen.append(len(ids))
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert corpus_pipeline.run(spark, sf).count() == seen[-1]
