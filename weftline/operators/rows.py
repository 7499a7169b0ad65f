"""Filters, row selection, sorts and limits. Places of rows are places in an order that the caller names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.columns import _any
from weftline.operators.selectors import Selector, resolve
from weftline.plans.order import ROW_ID, Order, c, names, with_row_ids


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[dict], bool]) -> DataFrame:
    """An expression or SQL text, which can be pushed to the scan; a Python predicate over row dicts runs on batches and can't."""
    if not callable(predicate) or isinstance(predicate, Column):
        return df.filter(predicate)

    def run(batches):
        for b in batches:
            yield b[[bool(predicate(r)) for r in b.to_dict("records")]]

    return df.mapInPandas(run, df.schema)


def truthy(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c(name), F.lit(False))
    out = c(name).isNotNull()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        out = out & ~F.isnan(c(name))
    return out & (c(name) != 0) if isinstance(kind, T.NumericType) else out


def filter_column(df: DataFrame, name: str, predicate=None) -> DataFrame:
    """Rows whose value a function of the column holds for, or which equal a constant; without either, which are true: not 0, NaN, false or null."""
    if predicate is None:
        return df.filter(truthy(df, name))
    return df.filter(predicate(c(name)) if callable(predicate) and not isinstance(predicate, Column) else predicate if isinstance(predicate, Column) else c(name) == predicate)


def select_rows(df: DataFrame, rows, order: Order | None = None) -> DataFrame:
    """Row ids (from the end if negative; an id given twice gives two rows), booleans in order, one id, or a condition."""
    if isinstance(rows, (Column, str)):
        return df.filter(rows)
    if order is None:
        raise ValueError("row ids need an order")
    rows = [rows] if isinstance(rows, int) and not isinstance(rows, bool) else list(rows)
    if rows and isinstance(rows[0], bool):
        rows = [i for i, keep in enumerate(rows) if keep]
    ids = with_row_ids(df, order)
    if any(r < 0 for r in rows):
        n = df.count()
        rows = [r + n if r < 0 else r for r in rows]
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "__place int, __want bigint")
    return ids.join(wanted, F.col(ROW_ID) == F.col("__want")).orderBy("__place").select(*[c(x) for x in df.columns])


def drop_rows(df: DataFrame, rows: int | Iterable[int], order: Order) -> DataFrame:
    rows = [rows] if isinstance(rows, int) else list(rows)
    n = df.count() if any(r < 0 for r in rows) else 0
    gone = df.sparkSession.createDataFrame([(r + n if r < 0 else r,) for r in rows], "__want bigint")
    return with_row_ids(df, order).join(gone, F.col(ROW_ID) == F.col("__want"), "left_anti").select(*[c(x) for x in df.columns])


remove_rows = drop_rows


def any_missing(df: DataFrame, selector: Selector = None) -> Column:
    return _any([c(x).isNull() for x in resolve(df, selector)] or [F.lit(False)])


def missing_rows(df: DataFrame, order: Order) -> DataFrame:
    """Ids of rows with a null."""
    return with_row_ids(df, order).filter(any_missing(df)).select(F.col(ROW_ID).alias("row_id"))


def drop_missing(df: DataFrame, selector: Selector = None) -> DataFrame:
    return df.filter(~any_missing(df, selector))


def select_missing(df: DataFrame, selector: Selector = None) -> DataFrame:
    return df.filter(any_missing(df, selector))


def reverse_rows(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*[c(x).desc_nulls_last() for x in names(order)])


def head(df: DataFrame, order: Order, n: int = 5) -> DataFrame:
    return df.orderBy(*[c(x) for x in names(order)]).limit(n)


def tail(df: DataFrame, order: Order, n: int = 5) -> DataFrame:
    return reverse_rows(df, order).limit(n).orderBy(*[c(x) for x in names(order)])


def take_nth(df: DataFrame, n: int, order: Order) -> DataFrame:
    return with_row_ids(df, order).filter(F.col(ROW_ID) % n == 0).drop(ROW_ID)


def shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed))


def sample(df: DataFrame, n: int, replacement: bool = False, seed: int | None = None, order: Order | None = None) -> DataFrame:
    """n rows exactly, or all if there are fewer. With replacement, n draws, for which an order is needed."""
    if not replacement:
        return df.orderBy(F.rand(seed)).limit(n)
    count = df.count()
    draws = df.sparkSession.range(n).select(F.floor(F.rand(seed) * count).alias("__want")) if count else df.sparkSession.createDataFrame([], "__want bigint")
    return with_row_ids(df, order).join(draws, F.col(ROW_ID) == F.col("__want")).select(*[c(x) for x in df.columns])


def rand_nth(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(1)


def _placed(x: Column, descending: bool, nan_strategy: str) -> list[Column]:
    """Where nulls and NaN go: first, last, or an error."""
    if nan_strategy == "exception":
        return [F.when(x.isNull(), F.raise_error(F.lit("null in a sort key"))).otherwise(x)]
    return [x.desc_nulls_first() if nan_strategy == "first" else x.desc_nulls_last()] if descending else [x.asc_nulls_first() if nan_strategy == "first" else x.asc_nulls_last()]


def sort_by(df: DataFrame, key: Column | Callable[[DataFrame], Column], descending: bool = False, nan_strategy: str = "first") -> DataFrame:
    return df.orderBy(*_placed(key(df) if callable(key) and not isinstance(key, Column) else key, descending, nan_strategy))


def sort_by_column(df: DataFrame, name: str, descending: bool = False, nan_strategy: str = "first") -> DataFrame:
    return df.orderBy(*_placed(c(name), descending, nan_strategy))


def min_n_by_column(df: DataFrame, name: str, n: int, order: Order, descending: bool = False) -> DataFrame:
    """The n least (greatest) by a column, ties by order, and then in the order given."""
    by = c(name).desc_nulls_last() if descending else c(name).asc_nulls_last()
    return df.orderBy(by, *[c(x) for x in names(order)]).limit(n).orderBy(*[c(x) for x in names(order)])


def unique_by(df: DataFrame, key: Column | Iterable[Column], order: Order, keep: str = "first") -> DataFrame:
    """One row of each key, the first or last in the order given. Nulls are one key."""
    keys = [key] if isinstance(key, Column) else list(key)
    by = [c(x).asc_nulls_first() if keep == "first" else c(x).desc_nulls_last() for x in names(order)]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unique_by_column(df: DataFrame, name: str, order: Order, keep: str = "first") -> DataFrame:
    return unique_by(df, c(name), order, keep)


def unique(df: DataFrame, name: str) -> DataFrame:
    return df.select(c(name)).distinct()
