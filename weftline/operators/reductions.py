"""Reducers, which are aggregate expressions with a name, and the aggregations that run them in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.order import Order, c, names

Agg = Callable[[DataFrame], Column]


def _double(df: DataFrame, x: str) -> Column:
    """As a double, with NaN as null."""
    v = c(x).cast("double")
    return F.nanvl(v, F.lit(None).cast("double")) if isinstance(df.schema[x].dataType, (T.FloatType, T.DoubleType)) else v


def sum(x: str) -> Agg:
    return lambda df: F.sum(_double(df, x))


def mean(x: str) -> Agg:
    return lambda df: F.avg(_double(df, x))


def row_count() -> Agg:
    return lambda df: F.count(F.lit(1))


def maximum(x: str) -> Agg:
    return lambda df: F.max(_double(df, x))


def minimum(x: str) -> Agg:
    return lambda df: F.min(_double(df, x))


def first_value(x: str, order: Order) -> Agg:
    """The value of the first row in order, null too."""
    return lambda df: F.min_by(F.struct(c(x).alias("v")), F.struct(*[c(o) for o in names(order)]))["v"]


def last_value(x: str, order: Order) -> Agg:
    return lambda df: F.max_by(F.struct(c(x).alias("v")), F.struct(*[c(o) for o in names(order)]))["v"]


def distinct(x: str, finalizer: Callable[[Column], Column] | None = None) -> Agg:
    """Sorted distinct values without null."""
    return lambda df: (finalizer or (lambda a: a))(F.array_sort(F.collect_set(c(x))))


def distinct_int32(x: str, finalizer: Callable[[Column], Column] | None = None) -> Agg:
    return lambda df: (finalizer or (lambda a: a))(F.array_sort(F.collect_set(c(x).cast("int"))))


def count_distinct(x: str) -> Agg:
    """Nulls count as one value."""
    return lambda df: F.count_distinct(c(x)) + F.max(c(x).isNull().cast("int"))


def prob_set_cardinality(x: str, lg_k: int = 12) -> Agg:
    return lambda df: F.hll_sketch_estimate(F.hll_sketch_agg(c(x), F.lit(lg_k)))


def prob_quantile(x: str, q: float, k: int = 128) -> Agg:
    return lambda df: F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(_double(df, x), F.lit(k)), F.lit(float(q)))


def prob_quantiles(x: str, qs: Sequence[float], k: int = 128) -> Agg:
    return lambda df: F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(_double(df, x), F.lit(k)), F.array(*[F.lit(float(q)) for q in qs]))


def prob_median(x: str, k: int = 128) -> Agg:
    return prob_quantile(x, 0.5, k)


def prob_interquartile_range(x: str, k: int = 128) -> Agg:
    """Both quartiles come from one sketch, which the planner sees are equal."""
    return lambda df: prob_quantile(x, 0.75, k)(df) - prob_quantile(x, 0.25, k)(df)


def prob_cdf(x: str, at: float, k: int = 128) -> Agg:
    return lambda df: F.kll_sketch_get_rank_double(F.kll_sketch_agg_double(_double(df, x), F.lit(k)), F.lit(float(at)))


def prob_cdfs(x: str, at: Sequence[float], k: int = 128) -> Agg:
    return lambda df: F.array(*[prob_cdf(x, v, k)(df) for v in at])


def prob_pmfs(x: str, at: Sequence[float], k: int = 128) -> Agg:
    """Shares between neighbouring values, the first below the first value; what lies above the last has none."""
    ranks = lambda df: [prob_cdf(x, v, k)(df) for v in at]
    return lambda df: F.array(*[r if i == 0 else r - ranks(df)[i - 1] for i, r in enumerate(ranks(df))])


def hll_reducer(x: str, lg_k: int = 12) -> Agg:
    """The sketch itself, for union with others."""
    return lambda df: F.hll_sketch_agg(c(x), F.lit(lg_k))


def doubles_sketch_reducer(x: str, k: int = 128, finalizer: Callable[[Column], Column] | None = None) -> Agg:
    return lambda df: (finalizer or (lambda s: s))(F.kll_sketch_agg_double(_double(df, x), F.lit(k)))


@dataclass(frozen=True)
class Reservoir:
    """A uniform sample of size rows of each group, the least of seeded random numbers."""

    size: int
    columns: tuple[str, ...]
    finish: Callable[[Column], Column]
    seed: int = 0


def reservoir_desc_stat(x: str, size: int, stat: str, seed: int = 0) -> Reservoir:
    done = {
        "mean": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0)),
        "min": F.array_min,
        "max": F.array_max,
        "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v),
        "median": lambda a: _median(F.array_sort(a)),
        "n-elems": F.size,
        "standard-deviation": lambda a: F.sqrt(_variance(a)),
        "variance": lambda a: _variance(a),
    }[stat]
    return Reservoir(size, (x,), lambda rows: done(F.transform(F.filter(rows, lambda r: r[x].isNotNull()), lambda r: r[x].cast("double"))), seed)


def _variance(a: Column) -> Column:
    n = F.size(a)
    m = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(n, F.lit(0))
    return F.aggregate(F.transform(a, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda s, v: s + v) / F.nullif(n - 1, F.lit(0))


def _median(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def reservoir_dataset(size: int, columns: Iterable[str], seed: int = 0) -> Reservoir:
    return Reservoir(size, tuple(columns), lambda rows: rows, seed)


def reducer(columns: str | Sequence[str], init: Callable[[], object], step: Callable, merge: Callable, finish: Callable, dtype: str) -> Callable:
    """A Python reducer over values of one or more columns. Batches of a group fold on the workers; merge joins the folds."""
    cols = [columns] if isinstance(columns, str) else list(columns)

    def run(*series: pd.Series) -> object:
        acc = init()
        for row in zip(*series):
            acc = step(acc, *row)
        return finish(merge(init(), acc))

    run.__annotations__ = {"series": pd.Series, "return": object}
    udf = F.pandas_udf(run, dtype, F.PandasUDFType.GROUPED_AGG)
    return lambda df: udf(*[c(x) for x in cols])


def expression_reducer(build: Callable[[DataFrame], Column]) -> Agg:
    """A reducer from any aggregate expression: the form that combines before the shuffle."""
    return build


def _source(ds) -> DataFrame:
    """One table, or several that are read as one."""
    if isinstance(ds, DataFrame):
        return ds
    out, *more = list(ds)
    for d in more:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def group_by_column_agg(keys: Order, aggs: Mapping[str, Agg | Reservoir], ds, index_filter: Column | str | None = None) -> DataFrame:
    """Groups by one or several columns, nulls being a group, and reduces in one pass. ds may be several tables."""
    df, keys = _source(ds), names(keys)
    if index_filter is not None:
        df = df.filter(index_filter)
    plain = {k: a for k, a in aggs.items() if not isinstance(a, Reservoir)}
    drawn = {k: a for k, a in aggs.items() if isinstance(a, Reservoir)}
    made = [a(df).alias(k) for k, a in plain.items()]
    out = df.groupBy(*[c(k) for k in keys]).agg(*made) if made else df.select(*[c(k) for k in keys]).distinct()
    for name, r in drawn.items():
        part = _reservoir(df, keys, name, r)
        on = F.lit(True)
        for k in keys:
            on = on & out[f"`{k}`"].eqNullSafe(part[f"`{k}`"])
        out = out.join(part, on, "left").select(*[out[f"`{x}`"] for x in out.columns], part[f"`{name}`"])
    return out


def _reservoir(df: DataFrame, keys: list[str], name: str, r: Reservoir) -> DataFrame:
    """Each task first thins a group to size, so that no group comes together whole."""
    drawn = df.withColumn("__r", F.rand(r.seed)).withColumn("__t", F.spark_partition_id())
    thin = Window.partitionBy(*[c(k) for k in keys], "__t").orderBy("__r")
    final = Window.partitionBy(*[c(k) for k in keys]).orderBy("__r")
    kept = drawn.withColumn("__n", F.row_number().over(thin)).where(F.col("__n") <= r.size).withColumn("__n", F.row_number().over(final)).where(F.col("__n") <= r.size)
    return kept.groupBy(*[c(k) for k in keys]).agg(r.finish(F.collect_list(F.struct(*[c(x) for x in r.columns]))).alias(name))


def aggregate(aggs: Mapping[str, Agg], ds, index_filter: Column | str | None = None) -> DataFrame:
    """One row over all."""
    df = _source(ds)
    if index_filter is not None:
        df = df.filter(index_filter)
    return df.agg(*[a(df).alias(k) for k, a in aggs.items()])


def group_by(df: DataFrame, key: Column | Callable[[DataFrame], Column], fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None):
    """Groups by an expression: grouped data to aggregate, or with fn each group's table on a worker, for groups that fit there."""
    key = key(df) if callable(key) and not isinstance(key, Column) else key
    grouped = df.groupBy(key)
    return grouped if fn is None else grouped.applyInPandas(fn, schema)


def group_by_column(df: DataFrame, name: str, fn=None, schema: str | None = None):
    return group_by(df, c(name), fn, schema)


def group_by_indexes(df: DataFrame, key: Column, order: Order, block_rows: int | None = None) -> DataFrame:
    """key and row_ids, sorted, of each group; ids count in order."""
    from weftline.plans.order import ROW_ID, with_row_ids

    return with_row_ids(df, order, ROW_ID, block_rows).groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(ROW_ID)).alias("row_ids"))


def group_by_column_indexes(df: DataFrame, name: str, order: Order) -> DataFrame:
    return group_by_indexes(df, c(name), order)
