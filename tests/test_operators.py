"""Literal cases for what SQL doesn't show: order over blocks, edges, nulls, names, and errors."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import parsing, printing, scalars, stats
from weftline.operators import categorical, columns, joins, missing, modelling, reductions, reshape, rolling, rows, selectors, sets
from weftline.plans import order, pipeline
from weftline.sources import readers, writers
from weftline.streaming import incremental


def frame(spark, schema, *data):
    return spark.createDataFrame([tuple(r) if isinstance(r, (list, tuple)) else (r,) for r in data], schema)


def col(df, name, by=None):
    return [r[name] for r in (df.orderBy(by) if by else df).collect()]


@pytest.mark.parametrize("block", [None, 7])
def test_row_ids(spark, block):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"), F.when(F.col("id") < 3, None).otherwise(F.col("id")).alias("v"))
    got = order.with_row_ids(df, "k", block_rows=block)
    assert col(got, order.ROW_ID, "k") == list(range(100))
    with_nulls = order.with_row_ids(df, ["v", "k"], block_rows=block).orderBy(order.ROW_ID).collect()
    assert [r.v for r in with_nulls][:4] == [None, None, None, 3]
    assert order.with_row_ids(df.limit(0), "k").count() == 0


def test_carry_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_ROWS", 9)
    df = spark.range(60).select("id", F.when(F.col("id").isin(2, 40), F.col("id")).alias("v"))
    down = order.carry(df, "id", {"x": F.col("v")})
    assert col(down, "x", "id") == [None] * 2 + [2] * 38 + [40] * 20
    up = order.carry(df, "id", {"x": F.col("v")}, forward=False)
    assert col(up, "x", "id") == [2] * 3 + [40] * 38 + [None] * 19
    strict = order.carry(df, "id", {"x": F.col("v")}, strict=True)
    assert col(strict, "x", "id") == [None] * 3 + [2] * 38 + [40] * 19


def test_rolling_docs(spark, monkeypatch):
    v = [None, 2.0, 3.0, 4.0]
    df = frame(spark, "i int, v double", *enumerate(v))
    assert col(rolling.rolling(df, 2, {"m": rolling.mean("v")}, "i"), "m", "i") == [None, 2.0, 2.5, 3.5]
    big = spark.range(50).select("id", (F.col("id") * 1.0).alias("v"), F.lit(1).alias("g"))
    for position in ("center", "left", "right"):
        one = rolling.rolling(big, 10, {"m": rolling.mean("v"), "f": rolling.first("v"), "n": rolling.nth("v", 3), "s": rolling.standard_deviation("v")}, "id", position)
        blocks = rolling.rolling(big, 10, {"m": rolling.mean("v"), "f": rolling.first("v"), "n": rolling.nth("v", 3), "s": rolling.standard_deviation("v")}, "id", position, block_rows=11)
        groups = rolling.rolling(big, 10, {"m": rolling.mean("v"), "f": rolling.first("v"), "n": rolling.nth("v", 3), "s": rolling.standard_deviation("v")}, "id", position, partition_by="g")
        lo, hi = rolling.bounds(10, position)
        want = []
        for i in range(50):
            w = pd.Series([float(min(max(j, 0), 49)) for j in range(i + lo, i + hi + 1)])
            want.append((w.mean(), w[0], w[3], w.std()))
        for got in (one, blocks, groups):
            for r, x in zip(got.orderBy("id").collect(), want):
                assert [r.m, r.f, r.n, r.s] == pytest.approx(list(x), abs=1e-6)


def test_rolling_variable_and_ties(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("t"), F.col("id").alias("v"))
    right = rolling.rolling(df, {"column": "t", "size": 10}, {"m": rolling.mean("v")}, "t", "right")
    assert col(right, "m", "t")[:2] == [4.5, 5.5]
    left = rolling.rolling(df, {"column": "t", "size": 10}, {"m": rolling.mean("v")}, "t", "left")
    assert col(left, "m", "t")[:3] == [0.0, 0.5, 1.0]
    centre = rolling.rolling(df, {"column": "t", "size": 10}, {"m": rolling.mean("v")}, "t")
    assert col(centre, "m", "t")[:3] == [2.0, 2.5, 3.0]
    ties = frame(spark, "t bigint, i int, v double", (1, 0, 1.0), (1, 1, 2.0), (2, 2, 4.0))
    got = rolling.rolling(ties, {"column": "t", "size": 2}, {"s": rolling.sum("v")}, ["t", "i"], "right")
    assert col(got, "s", "i") == [7.0, 6.0, 4.0]


@pytest.mark.parametrize("position", ["right", "left", "center"])
def test_rolling_variable_blocks(spark, monkeypatch, position):
    rows = [(i, (i * 7) % 60 if i % 11 else None, float(i * i % 17) if i % 5 else None) for i in range(200)]
    df = frame(spark, "i int, t int, v double", *rows)
    made = {k: getattr(rolling, k)("v") for k in ("sum", "mean", "min", "max", "variance", "first", "last")} | {"nth": rolling.nth("v", 2)}
    want = []
    lo, hi = {"right": (0, 5), "left": (-5, 0), "center": (-3, 2)}[position]
    for i, t, _ in rows:
        hit = sorted((u, j, v) for j, u, v in rows if t is not None and u is not None and t + lo <= u <= t + hi and (position == "center" or (u, j) == (t, i) or ((u, j) > (t, i)) == (position == "right")))
        at, v = [x for *_, x in hit], pd.Series([x for *_, x in hit if x is not None], dtype=float)
        some = len(v) > 0
        want.append((v.sum() if some else None, v.mean() if some else None, v.min() if some else None, v.max() if some else None, v.var() if len(v) > 1 else None, at[0] if at else None, at[-1] if at else None, at[2] if len(at) > 2 else None))
    monkeypatch.setattr(rolling, "BLOCK_ROWS", 30)
    for by in ((), "g"):
        got = rolling.rolling(df.withColumn("g", F.lit(1)), {"column": "t", "size": 6}, made, ["t", "i"], position, partition_by=by).orderBy("i").collect()
        assert [r.i for r in got] == list(range(200))
        for r, x in zip(got, want):
            assert tuple(r[k] for k in made) == pytest.approx(x, abs=1e-9)


@pytest.mark.parametrize("position", ["right", "left", "center"])
def test_rolling_variable_by_tables(spark, monkeypatch, position):
    rows = [(i, (i * 7) % 60 if i % 11 else None, [float(i * i % 17), None, math.nan][0 if i % 5 else 1 + i % 2]) for i in range(200)]
    df = frame(spark, "i int, t int, v double", *rows)
    made = {k: getattr(rolling, k)("v") for k in ("sum", "mean", "min", "max")}
    monkeypatch.setattr(rolling, "BLOCK_ROWS", 60)
    for by in ("t", ["t", "i"]):
        tables = rolling.rolling(df, {"column": "t", "size": 6}, made, by, position)
        frames = rolling.rolling(df, {"column": "t", "size": 6}, made | {"first": rolling.first("v")}, by, position).drop("first")
        plan = tables._jdf.queryExecution().toString()
        assert "RangeFrame" not in plan and tables.columns == frames.columns and tables.dtypes == frames.dtypes
        for x, y in zip(tables.orderBy("i").collect(), frames.orderBy("i").collect(), strict=True):
            assert tuple(x[k] for k in ("i", "t", *made)) == pytest.approx(tuple(y[k] for k in ("i", "t", *made)), abs=1e-9)


def test_variances_of_large_values(spark):
    df = spark.range(30).select("id", (F.col("id") % 3 + 1e9).alias("v"), F.lit(1).alias("g"))
    sd = {"s": rolling.variance("v")}
    plain = pd.Series([i % 3 + 1e9 for i in range(30)])
    for got in (rolling.expanding(df, sd, "id", block_rows=7), rolling.expanding(df, sd, "id", "g")):
        assert col(got, "s", "id")[1:] == pytest.approx([plain[: i + 1].var() for i in range(1, 30)], abs=1e-6)
    got = col(rolling.rolling(df, 3, sd, "id", "left"), "s", "id")
    assert got[2:] == pytest.approx([1.0] * 28, abs=1e-6) and got[0] == pytest.approx(0.0, abs=1e-6)


def test_many_cuts(spark, monkeypatch):
    cuts = [F.lit(3 * i) for i in range(1, 12)]
    df = spark.range(40)
    tree = df.select(order.cut_number(F.col("id"), cuts).alias("n")).collect()
    monkeypatch.setattr(order, "TREE", 3)
    assert df.select(order.cut_number(F.col("id"), cuts).alias("n")).collect() == tree
    ids = order.with_row_ids(spark.range(500).select((F.col("id") * 37 % 500).alias("x")), "x", "n", 20)
    assert all(r.x == r.n for r in ids.collect())


def test_expanding_blocks(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") * 1.0).alias("v"))
    reducers = {"s": rolling.sum("v"), "m": rolling.mean("v"), "lo": rolling.min("v"), "hi": rolling.max("v"), "sd": rolling.standard_deviation("v"), "f": rolling.first("v")}
    one, many = (rolling.expanding(df, reducers, "id", block_rows=b).orderBy("id").collect() for b in (None, 6))
    for a, b in zip(one, many):
        for k in reducers:
            assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], abs=1e-6)


def test_asof_vectors(spark):
    left = spark.range(10).select(F.col("id").alias("a"))
    right = spark.range(10).select((F.col("id") * 2 - 5).alias("b"))
    for op, pick in {"<": lambda a, b: min((x for x in b if a < x), default=None), "<=": lambda a, b: min((x for x in b if a <= x), default=None), ">": lambda a, b: max((x for x in b if a > x), default=None), ">=": lambda a, b: max((x for x in b if a >= x), default=None)}.items():
        got = joins.left_join_asof(("a", "b"), left, right, op)
        assert col(got, "b", "a") == [pick(a, [2 * i - 5 for i in range(10)]) for a in range(10)]
    near = joins.left_join_asof(("a", "b"), left, spark.range(10).select((F.col("id") * 3 - 5).alias("b")), "nearest")
    assert col(near, "b", "a") == [1, 1, 1, 4, 4, 4, 7, 7, 7, 10]
    ties = joins.left_join_asof(("a", "b"), left.where("a = 1"), frame(spark, "b bigint, w int", (1, 1), (1, 2)), "<=", tie=["w"])
    assert ties.first().w == 1
    lost = joins.left_join_asof("k", frame(spark, "k bigint", 1, None), frame(spark, "k bigint, w int", (None, 5)), ">=")
    assert sorted((r.k is None, r.w) for r in lost.collect()) == [(False, None), (True, None)]


def test_join_names_and_nulls(spark):
    a, b = frame(spark, "k int, v int", (None, 3), (2, 4)), frame(spark, "k int, v int", (None, 6), (4, 7))
    inner = joins.inner_join("k", a, b)
    assert inner.columns == ["k", "v", "right.v"] and [tuple(r) for r in inner.collect()] == [(None, 3, 6)]
    assert joins.left_join("k", a, b).columns == ["k", "v", "right.k", "right.v"]
    outer = joins.pd_merge(a, b, "outer", "k")
    assert outer.count() == 3 and outer.columns == ["k", "v", "right.v"]
    right = joins.pd_merge(a, b, "right", "k")
    assert right.columns == ["k", "v", "left.v"]
    assert joins.pd_merge(a, b, "cross").count() == 4
    assert set(joins.hash_join("k", a, b, True, True)) == {"inner", "left-outer", "right-outer"}
    r = joins.range_join(frame(spark, "x double", 1.0, 5.0, 9.0), frame(spark, "lo double, hi double", (0.0, 5.0), (8.0, 9.5)), "x", "lo", "hi", 2.0)
    assert sorted(col(r, "x")) == [1.0, 5.0, 9.0]


def test_ties_stand_alike_both_ways(spark):
    df = frame(spark, "t int, i int, v double", (1, 0, None), (1, 1, 5.0), (2, 2, None), (2, 3, 7.0), (3, 4, None)).coalesce(1)
    for by in ((), "g"):
        given = df.withColumn("g", F.lit(1))
        down, up = (col(missing.replace_missing(given, "v", k, order="t", partition_by=by), "v", "i") for k in ("down", "up"))
        # of a null and a value at one place one is before the other, going down and up
        assert down == [None, 5.0, 5.0, 7.0, 7.0] and up == [5.0, 5.0, 7.0, 7.0, None]


def test_missing_strategies(spark):
    df = frame(spark, "i int, a double", *enumerate([None, 1.0, None, None, None, 5.0, None]))
    want = {"down": [None, 1, 1, 1, 1, 5, 5], "up": [1, 1, 5, 5, 5, 5, None], "downup": [1, 1, 1, 1, 1, 5, 5], "updown": [1, 1, 5, 5, 5, 5, 5], "mid": [1, 1, 1, 1, 5, 5, 5], "lerp": [1, 1, 2, 3, 4, 5, 5], "midpoint": [1, 1, 3, 3, 3, 5, 5]}
    for strategy, values in want.items():
        assert col(missing.replace_missing(df, "a", strategy, order="i"), "a", "i") == values, strategy
    assert col(missing.replace_missing(df, "a", "down", 9.0, "i"), "a", "i")[0] == 9.0
    assert col(missing.replace_missing(df, "a", "value", F.avg), "a", "i")[0] == 3.0
    drawn = col(missing.replace_missing(df, "a", "abb"), "a", "i")
    assert set(drawn) <= {1.0, 5.0}
    times = frame(spark, "i int, d date", (0, dt.date(2020, 1, 1)), (1, None), (2, dt.date(2020, 1, 3)))
    assert col(missing.replace_missing(times, "d", "lerp", order="i"), "d", "i")[1] == dt.date(2020, 1, 2)
    assert col(missing.set_missing(df, "a", [1], "i"), "a", "i") == [None] * 5 + [5.0, None]
    with pytest.raises(ValueError):
        missing.replace_missing(df, "a", "down")


def test_fill_range(spark):
    df = frame(spark, "a int, b int", (1, 2), (5, 2), (10, None), (15, 4), (20, 8))
    got = missing.fill_range_replace(df, "a", 2).orderBy("a").collect()
    keys = [r.a for r in got]
    assert max(b - a for a, b in zip(keys, keys[1:])) <= 2 and keys[0] == 1 and keys[-1] == 20


def test_sets(spark):
    a, b = frame(spark, "x int, y int", (1, 2), (1, 2), (2, None)), frame(spark, "x int, y int", (1, 2), (3, 3), (2, None))
    assert sets.union(a, b).count() == 4
    assert sets.union(a, b, multiplicity="min").count() == 3
    assert sets.intersection(a, b).count() == 2
    assert sets.difference(a, frame(spark, "x int, y int", (2, None))).count() == 2
    assert {tuple(r) for r in sets.reduce_intersection([a, b], "n").collect()} == {(1, 2, 1), (2, None, 1)}
    assert sets.concat(a, None, frame(spark, "x bigint", 7)).schema["x"].dataType.simpleString() == "bigint"


def test_reductions(spark):
    df = frame(spark, "k string, v double, n int", ("a", 1.0, 1), ("a", math.nan, 1), ("b", 3.0, None), (None, 4.0, 2))
    r = reductions
    got = {x.k: x for x in r.group_by_column_agg("k", {"s": r.sum("v"), "m": r.maximum("v"), "n": r.count_distinct("n"), "f": r.first_value("v", "v")}, df).collect()}
    assert got["a"].s == 1.0 and got["a"].m == 1.0 and got["b"].n == 1 and None in got
    udaf = r.reducer("v", lambda: 0.0, lambda acc, v: acc + v, lambda x, y: x + y, float, "double")
    assert {x.k: x.t for x in r.group_by_column_agg("k", {"t": udaf}, df.where("v > 0 AND NOT isnan(v)")).collect()} == {"a": 1.0, "b": 3.0, None: 4.0}
    res = r.group_by_column_agg("g", {"m": r.reservoir_desc_stat("v", 5, "mean"), "d": r.reservoir_dataset(3, ["v"])}, spark.range(100).selectExpr("id % 2 AS g", "id * 1.0D AS v"))
    assert all(len(x.d) == 3 and 0 <= x.m < 100 for x in res.collect())
    est = r.aggregate({"c": r.prob_set_cardinality("id"), "q": r.prob_quantiles("id", [0.25, 0.75]), "p": r.prob_pmfs("id", [100.0, 500.0])}, spark.range(1000)).first()
    assert abs(est.c - 1000) < 50 and abs(est.q[0] - 250) < 40 and abs(est.p[1] - 0.4) < 0.05
    assert r.group_by_column(df, "k").count().count() == 3
    idx = r.group_by_column_indexes(frame(spark, "i int, g int", (0, 1), (1, 2), (2, 1)), "g", "i")
    assert {x.key: x.row_ids for x in idx.collect()} == {1: [0, 2], 2: [1]}


def test_columns(spark):
    df = frame(spark, "a int, b double, c string", (1, 2.0, "x"), (None, 3.0, None))
    assert columns.select_columns_by_index(df, [-1, 0]).columns == ["c", "a"]
    assert columns.unordered_select(df, ["c", "a"]).columns == ["a", "c"]
    assert columns.rename_columns(df, {"a": "z"}).columns == ["z", "b", "c"]
    with pytest.raises(ValueError):
        columns.rename_columns(df, ["q"])
    with pytest.raises(KeyError):
        columns.select_columns(df, ["nope"])
    assert columns.extend_with_empty(df, 2).count() == 4
    assert col(columns.column_map(df, "s", lambda a, b: a + b, ["a", "b"], "double"), "s") == [3.0, None]
    assert col(columns.update_elemwise(df, "c", lambda x: x * 2, "string"), "c") == ["xx", None]
    assert columns.empty_column_names(df.withColumn("e", F.lit(None).cast("int"))) == ["e"]
    assert columns.columns_with_missing_seq(df) == [{"column-name": "a", "missing-count": 1}, {"column-name": "c", "missing-count": 1}]
    up = columns.update(df, ["b"], lambda d: d.withColumn("b", F.col("b") * 10))
    assert up.columns == ["a", "b", "c"] and col(up, "b") == [20.0, 30.0]
    both = columns.append_columns(df.select("b"), frame(spark, "z int", 7), "b", "z")
    assert [tuple(r) for r in both.orderBy("b").collect()] == [(2.0, 7), (3.0, None)]
    assert columns.column_to_dataset(df.select("b"), "b", lambda v: {"h": v / 2}, "h double").count() == 2
    assert selectors.target(modelling.set_inference_target(df, "a")).columns == ["a"]
    assert selectors.missing(df).columns == ["a", "c"] and selectors.no_missing(df).columns == ["b"]
    assert selectors.intersection(df, df.select("c")) == ["c"] and selectors.difference(df, df.select("c")) == ["a", "b"]
    assert columns.column_map_m(df, "t", "b * 2").columns[-1] == "t"


def test_rows(spark):
    df = frame(spark, "i int, v double", (0, 0.0), (1, math.nan), (2, None), (3, 5.0))
    assert col(rows.filter_column(df, "v"), "i") == [3]
    assert col(rows.filter_rows(df, lambda r: r["i"] > 1), "i") == [2, 3]
    assert col(rows.select_rows(df, [3, 0, 0, -1], "i"), "i") == [3, 0, 0, 3]
    assert col(rows.select_rows(df, [True, False, True, False], "i"), "i") == [0, 2]
    assert sorted(col(rows.drop_rows(df, [-1], "i"), "i")) == [0, 1, 2]
    assert col(rows.tail(df, "i", 2), "i") == [2, 3]
    assert col(rows.reverse_rows(df, "i"), "i") == [3, 2, 1, 0]
    assert rows.sample(df, 10, True, 3, "i").count() == 10 and rows.sample(df, 2).count() == 2
    assert col(rows.missing_rows(df, "i"), "row_id") == [2]
    assert col(rows.unique_by(df, F.col("i") % 2, "i", "last"), "i", "i") == [2, 3]
    assert rows.shuffle(df, 1).count() == 4 and rows.rand_nth(df).count() == 1


def test_reshape(spark):
    df = frame(spark, "k string, a int, b int", ("x", 1, 2), ("y", 3, 4))
    assert {tuple(r) for r in reshape.columnwise_concat(df, ["a", "b"]).collect()} == {("x", "a", 1), ("x", "b", 2), ("y", "a", 3), ("y", "b", 4)}
    assert {tuple(r) for r in reshape.transpose_by_key(df, "k").collect()} == {("a", 1, 3), ("b", 2, 4)}
    arr = frame(spark, "i int, v array<int>", (0, [1, 2]), (1, None), (2, []))
    assert [tuple(r) for r in reshape.unroll_column(arr, "v", "n").collect()] == [(0, 0, 1), (0, 1, 2)]
    fib = reshape.induction(spark.range(6), lambda d: {"f": 1 if len(d) < 3 else int(d.f.iloc[-2] + d.f.iloc[-3])}, "f bigint", "id")
    assert col(fib, "f", "id") == [1, 1, 2, 3, 5, 8]
    assert reshape.pmap_ds(df, lambda p: p.assign(a=p.a + 1)).agg(F.sum("a")).first()[0] == 6


def test_categorical(spark):
    df = frame(spark, "c string", "b", "a", None, "b")
    num = categorical.categorical_to_number(df, "c", ["b"])
    assert col(num, "c") == [0.0, 1.0, None, 0.0]
    assert col(categorical.reverse_map_categorical_xforms(num), "c") == ["b", "a", None, "b"]
    hot = categorical.categorical_to_one_hot(df, "c")
    assert hot.columns == ["c-a", "c-b"] and col(hot, "c-b") == [1, 0, 0, 1]
    assert col(categorical.reverse_map_categorical_xforms(hot), "c") == ["b", "a", None, "b"]
    with pytest.raises(Exception, match="unknown category"):
        categorical.transform_categorical_map(frame(spark, "c string", "z"), categorical.fit_categorical_map(df, "c")).collect()


def test_modelling(spark):
    df = spark.range(59)
    folds = modelling.k_fold_datasets(df, 5, "id")
    assert sorted(f["test-ds"].count() for f in folds) == [11, 12, 12, 12, 12]
    assert sorted(r.id for f in folds for r in f["test-ds"].collect()) == list(range(59))
    split = modelling.train_test_split(df, "id")
    assert (split["train-ds"].count(), split["test-ds"].count()) == (41, 18)
    p = frame(spark, "a double, b double", (0.2, 0.8), (0.5, 0.5))
    assert col(modelling.probability_distributions_to_label_column(p, "y"), "y") == ["b", "a"]
    wide = spark.range(50).selectExpr("id * 1.0D AS x", "id * 2.0D AS y", "rand(1) AS z")
    fit = modelling.fit_pca(wide)
    assert fit.n_components == 1 and modelling.transform_pca(wide, fit).columns == ["pca-0"]
    model = modelling.train_regression(modelling.trainer("linear-regression"), wide.select("x", "y"), "y")
    assert modelling.evaluate_regression(model, wide)["r2"] > 0.99
    labelled = categorical.categorical_to_number(wide.selectExpr("x", "CASE WHEN x > 25 THEN 'hi' ELSE 'lo' END AS c"), "c")
    labelled = modelling.set_inference_target(labelled, "c")
    assert modelling.model_type(labelled) == {"c": "classification"} and modelling.feature_ecount(labelled) == 1 and modelling.num_inference_classes(labelled) == 2
    clf = modelling.train_classification(modelling.trainer("logistic-regression"), labelled)
    assert modelling.predict_classification(clf, labelled).where("prediction = 'hi'").count() > 20
    assert set(col(modelling.labels(labelled), "c")) == {"hi", "lo"}


def test_stats(spark):
    df = frame(spark, "i int, v double, s string", (0, 1.0, "a"), (1, None, "b"), (2, 3.0, "b"))
    got = {r["col-name"]: r for r in stats.descriptive_stats(df, "i").collect()}
    assert got["v"]["n-missing"] == 1 and got["v"]["mean"] == 2.0 and got["s"]["mode"] == "b" and got["s"]["first"] == "a" and got["s"]["last"] == "b"
    assert "mean" not in [k for d in stats.brief(df.select("i", "s"), "i") if d["col-name"] == "s" for k in d]
    xy = frame(spark, "x double, y double", *[(float(i), float((i * 7) % 11)) for i in range(20)])
    want = pd.DataFrame({"x": [float(i) for i in range(20)], "y": [float((i * 7) % 11) for i in range(20)]})
    assert stats.correlation(xy, "x", "y", "spearman") == pytest.approx(want.x.rank().corr(want.y.rank()))
    con = sum((a - c) * (b - d) > 0 for i, (a, b) in enumerate(want.values) for c, d in want.values[:i])
    dis = sum((a - c) * (b - d) < 0 for i, (a, b) in enumerate(want.values) for c, d in want.values[:i])
    ties = sum(b == d for i, (a, b) in enumerate(want.values) for c, d in want.values[:i])
    assert stats.correlation(xy, "x", "y", "kendall") == pytest.approx((con - dis) / math.sqrt(190 * (190 - ties)))
    line = stats.interpolate_loess(spark.range(20).selectExpr("id * 1.0D AS x", "id * 2.0D AS y"), "x", "y")
    assert all(abs(r["y-loess"] - r.y) < 1e-6 for r in line.collect())
    centred, means = stats.mean_center_columns(xy, ["x"])
    assert means["x"] == 9.5 and centred.agg(F.sum("x")).first()[0] == 0.0


def test_parsing(spark):
    df = frame(spark, "a string, b string, c string, d string, e string, f string", ("1", "true", "1.5", "2020-01-02", "x", "300000"), ("NA", "false", "3", "Mar 4 2021", "2", "4"), ("", "true", None, "na", "3", "5"))
    assert parsing.infer(df) == {"a": "smallint", "b": "boolean", "c": "double", "d": "date", "e": "string", "f": "int"}
    got = parsing.parsed(df, parsing.infer(df)).collect()
    assert got[0].a == 1 and got[1].a is None and got[1].d == dt.date(2021, 3, 4)
    assert parsing.infer(frame(spark, "t string", "x" * 2000)) == {"t": "text"}
    assert col(parsing.parse_column(frame(spark, "b string", "Yes", "f", "?"), "b", "boolean", relaxed=True), "b-unparsed") == [None, None, "?"]
    with pytest.raises(Exception, match="can't parse"):
        parsing.parse_column(frame(spark, "b string", "?"), "b", "int").collect()
    d = frame(spark, "x string", "PT1H2M3S", "-P1DT2S", "1:02:03", "no").select(parsing.parse_duration(F.col("x")).alias("d"))
    assert col(d, "d") == [dt.timedelta(hours=1, minutes=2, seconds=3), -dt.timedelta(days=1, seconds=2), dt.timedelta(hours=1, minutes=2, seconds=3), None]
    t = frame(spark, "x string", "2020-01-02 03:04", "01/02/2020 3:04 PM").select(parsing.parse_local_date_time(F.col("x")).alias("t"))
    assert col(t, "t") == [dt.datetime(2020, 1, 2, 3, 4), dt.datetime(2020, 1, 2, 15, 4)]
    assert scalars.call("+", F.lit(1), 2, 3) is not None


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nid,,name,name\n1,2.5,x,y\n2,NA,\"q,r\",z\n")
    got = readers.read_dataset(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "column-1", "name", "name-1"] and [r.name for r in got.orderBy("id").collect()] == ["x", "q,r"]
    (tmp_path / "b.csv").write_text("a;b\n1;2\n3;4\n")
    assert readers.read_dataset(spark, str(tmp_path / "b.csv"), n_rows=1).columns == ["a", "b"]
    df = frame(spark, "a int, b string", (1, "x"), (2, None))
    for end in ("parquet", "json", "csv.gz", "tsv", "orc"):
        writers.write_dataset(df, str(tmp_path / f"out.{end}"))
        kind = {"json": "jsonl"}.get(end)
        back = readers.read_dataset(spark, str(tmp_path / f"out.{end}"), kind)
        assert back.count() == 2, end
    for end in ("arrow", "arrows"):
        writers.write_dataset(df, str(tmp_path / f"t.{end}"))
        assert sorted((r.a, r.b) for r in readers.read_dataset(spark, str(tmp_path / f"t.{end}")).collect()) == [(1, "x"), (2, None)]
    writers.write_zip({"one": df, "two.tsv": df}, str(tmp_path / "z.zip"))
    assert readers.read_zip(spark, str(tmp_path / "z.zip"), "a bigint, b string").count() == 4
    assert readers.read_dataset(spark, {"a": [1, 2, 3], "b": [1], "c": 9}).collect()[1] == (2, None, 9)
    assert readers.read_dataset(spark, [{"a": 1}, {"a": 2.5, "b": "x"}]).collect()[0] == (1.0, None)
    nested = spark.createDataFrame([(1, [{"k": 1}, {"k": 2}])], "id int, v array<struct<k:int>>")
    assert [tuple(r) for r in readers.flatten_nested(nested).collect()] == [(1, 1), (None, 2)]
    df.coalesce(1).write.parquet(str(tmp_path / "m.parquet"))
    part = next(p for p in (tmp_path / "m.parquet").iterdir() if p.suffix == ".parquet")
    assert readers.parquet_metadata(str(part))[0]["columns"][0]["name"] == "a"
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.nope")


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(100).selectExpr("id % 3 AS k", "id AS v", "timestamp_seconds(id * 60) AS ts").repartition(4).write.parquet(src)
    stream = incremental.read_stream(spark, src, "k bigint, v bigint, ts timestamp", files_per_trigger=1)
    seen: dict = {}
    agg = incremental.group_by_column_agg_stream(stream, "k", {"s": reductions.sum("v"), "n": reductions.row_count()})
    incremental.run_to_end(agg, str(tmp_path / "cp"), lambda df, i: seen.update({r.k: (r.s, r.n) for r in df.collect()}))
    assert seen == {k: (float(sum(range(k, 100, 3))), len(range(k, 100, 3))) for k in range(3)}
    wins: dict = {}
    w = incremental.windowed_agg_stream(incremental.read_stream(spark, src, "k bigint, v bigint, ts timestamp"), "ts", "10 minutes", {"n": reductions.row_count()})
    incremental.run_to_end(w, str(tmp_path / "cp2"), lambda df, i: wins.update({r.window_start: r.n for r in df.collect()}))
    assert sum(wins.values()) == 100 and len(wins) == 10
    p = incremental.mapseq_parser(spark)
    p({"a": 1})
    p({"a": 2, "b": "x"})
    assert p().count() == 2


def test_pipeline_and_printing(spark):
    df = spark.range(10).selectExpr("id * 1.0D AS x")
    scale = pipeline.fitted("scale", stats.fit_std_scale, stats.transform_std_scale)
    ctx = pipeline.fit(df, pipeline.lift(rows.filter_rows, "x > 1"), scale)
    assert pipeline.transform(df, ctx, scale)["data"].count() == 10
    text = printing.dataset_to_str(df.orderBy("x").limit(2), "t", types=True)
    assert text.splitlines()[0] == "t [2 1]:" and "double" in text
    assert printing.row_at(df, -1, "x") == {"x": 9.0} and printing.row_at(df, 2, "x") == {"x": 2.0}
    assert printing.format_sequence([1.0, 2.5, None]) == ["1.0", "2.5", ""]
    assert printing.shape(df) == [1, 10]


def test_windows_have_partitions(spark):
    """Row ids never need a window over a whole table."""
    plan = order.with_row_ids(spark.range(10), "id")._jdf.queryExecution().toString()
    assert "windowspecdefinition(__block" in plan


def test_csv_late_columns_and_headers(spark, tmp_path):
    """Columns first seen late, headers and preambles of each file, and a data row that equals the header."""

    late = tmp_path / "late.csv"
    late.write_text("".join(f"{i},{i}\n" for i in range(80)) + "3,4,5,6\n")
    got = readers.read_csv(spark, str(late), header=False)
    assert got.columns == [f"column-{i}" for i in range(4)] and got.count() == 81
    assert got.where("`column-3` = 6").count() == 1
    wide = tmp_path / "wide.csv"
    wide.write_text('x,y\n1,2\n3,4,5\nx,y\n"a,b",7\n')
    got = readers.read_csv(spark, str(wide))
    assert got.columns == ["x", "y", "column-2"] and sorted(r.x for r in got.collect()) == ["1", "3", "a,b", "x"]
    folder = tmp_path / "two"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_text(f"junk one\nn,s\n{i},a\n{i + 10},b\n")
    got = readers.read_csv(spark, str(folder), skip_rows=1)
    assert sorted((r.n, r.s) for r in got.collect()) == [(0, "a"), (1, "a"), (10, "b"), (11, "b")]


def test_kendall_of_many_values(spark):
    """More distinct values than classes give the same as all pairs do."""

    rng = np.random.default_rng(3)
    x = rng.integers(0, 400, 500).astype(float)
    y = np.where(rng.random(500) < 0.3, 0, x + rng.integers(0, 400, 500)).astype(float)
    at = np.triu_indices(500, 1)
    sx, sy = (np.sign(v[:, None] - v[None])[at] for v in (x, y))
    want = (sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum())
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert stats.kendall(df, "x", "y") == pytest.approx(want) and stats.kendall(df, "x", "y", cells=7) == pytest.approx(want)


def test_csv_headers_go_without_a_shuffle(spark, tmp_path, monkeypatch):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text("a,b\n\n" + "".join(f"{i * 300 + j},{'x' if j < 299 else 'a,b'[:1]}\n" for j in range(300)) + "a,b\n" * (i == 2))
    got = readers.read_csv(spark, str(folder))
    assert got.count() == 901 and got.where("a = 'a' and b = 'b'").count() == 1 and dict(got.dtypes) == {"a": "string", "b": "string"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_types_by_rows_after_the_first(spark):
    late = lambda first, last: parsing.infer(frame(spark, "x string", *[(first,)] * 300, (last,)))["x"]
    want = {("1", "40000"): "int", ("1", "3000000000"): "bigint", ("1", "99999999999999999999"): "double", ("1", "-32768"): "smallint", ("1", "1.5"): "double", ("1", "x"): "string", ("2020-01-02", "2020-01-02T03:04:05Z"): "string", ("2020-01-02T03:04:05Z", "NA"): "timestamp", (None, "7"): "smallint", (None, None): "boolean"}
    assert {k: late(*k) for k in want} == want
