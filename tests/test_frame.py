from pyspark.sql import functions as F

from weftline import frame
from weftline.frame import Frame
from weftline.operators import reductions, rolling


def test_frame(spark):
    f = Frame(spark.range(20).selectExpr("id", "id % 3 AS g", "CASE WHEN id % 4 = 0 THEN NULL ELSE id * 1.0D END AS v"), "id", "t")
    assert f.head(n=2).df.count() == 2 and [r.id for r in f.tail(n=2).df.collect()] == [18, 19]
    assert f.replace_missing("v", "down").df.where("v is null").count() == 1
    assert f.rolling(3, {"m": rolling.mean("v")}).df.columns[-1] == "m"
    assert f.select_columns(["g"]).order == [] and f.filter_rows("g = 0").order == ["id"]
    assert f.group_by_column_agg("g", {"n": reductions.row_count()}).df.count() == 3
    assert f.inner_join("id", f).df.columns == ["id", "g", "v", "t.g", "t.v"]
    assert f.pd_merge(f, on="id").df.count() == 20 and f.left_join_asof("id", f.df.select("id"), ">=").df.count() == 20
    assert f.union(f).df.count() == 20 and len(f) == 20 and str(f).startswith("t [20 3]:")
    assert f.with_row_ids().df.agg(F.max("__row_id")).first()[0] == 19
    assert f.set_dataset_name("u").name == "u" and f.ensure_array_backed().df.is_cached
    assert {"select_rows", "columnwise_concat", "k_fold_datasets", "descriptive_stats", "drop_missing"} <= set(dir(f))


def test_plain_data(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (None, None, None)], "i int, s string, v array<double>")
    assert frame.data_to_dataset(spark, frame.dataset_to_data(df)).collect() == df.collect()
    assert str(frame.to_double_array(df, "i", "s").tolist()) == "[nan, 1.0]"
    assert frame.string_table_keyset(df, "s").count() == 1 and frame.column_safe_name(("a", 1)) == "a-1"
    assert frame.column_stats(df, "i", ["sum", "n-elems"]) == {"sum": 1, "n-elems": 2}
    assert frame.datatype_to_sql_type("uint64").simpleString() == "decimal(20,0)" and frame.empty_dataset(spark).count() == 0
    assert frame.partitions_of(spark.range(10), 4, "id").agg(F.max("batch")).first()[0] == 2
