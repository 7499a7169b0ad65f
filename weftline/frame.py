"""A table with a name and the order of its rows, on which all operators are methods.

Frame(df, order) passes its order to each operator that takes one, and wraps what comes back.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import parsing, printing, stats
from weftline.operators import categorical, columns, joins, missing, modelling, reductions, reshape, rolling, rows, selectors, sets
from weftline.plans.order import ROW_ID, Order, c, names, with_row_ids
from weftline.sources import writers

#: Names that more than one module has are taken from the first.
MODULES = (columns, rows, sets, reshape, missing, categorical, modelling, rolling, stats, parsing, printing, selectors)


def _operators() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        for name, fn in vars(m).items():
            if inspect.isfunction(fn) and not name.startswith("_") and fn.__module__ == m.__name__:
                first = next(iter(inspect.signature(fn).parameters), "")
                if first in ("df", "dfs", "a"):
                    out.setdefault(name, fn)
    for name, fn in vars(columns).items():
        if inspect.isfunction(fn) and fn.__module__ == columns.__name__ and not name.startswith("_"):
            out.setdefault(name, fn)
    return out


OPERATORS = _operators()


class Frame:
    def __init__(self, df: DataFrame, order: Order = (), name: str = "_unnamed"):
        self.df, self.order, self.name = df, names(order), name

    def _with(self, got):
        if isinstance(got, DataFrame):
            kept = self.order if set(self.order) <= set(got.columns) else []
            return Frame(got, kept, self.name)
        return got

    def __getattr__(self, name: str):
        fn = OPERATORS.get(name)
        if fn is None:
            raise AttributeError(name)
        takes_order = "order" in inspect.signature(fn).parameters

        @functools.wraps(fn)
        def call(*args, **kwargs):
            if takes_order and "order" not in kwargs and self.order:
                kwargs["order"] = self.order
            plain = [a.df if isinstance(a, Frame) else a for a in args]
            return self._with(fn(self.df, *plain, **{k: v.df if isinstance(v, Frame) else v for k, v in kwargs.items()}))

        return call

    def __dir__(self):
        return sorted({*super().__dir__(), *OPERATORS})

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, name: str):
        if name not in self.df.columns:
            raise KeyError(name)
        return c(name)

    def __str__(self) -> str:
        src = self.df.orderBy(*[c(o) for o in self.order]) if self.order else self.df
        return printing.dataset_to_str(src, self.name)

    def set_dataset_name(self, name: str) -> Frame:
        return Frame(self.df, self.order, name)

    def inner_join(self, key, other: Frame | DataFrame) -> Frame:
        return self._joined(joins.inner_join, key, other)

    def left_join(self, key, other: Frame | DataFrame) -> Frame:
        return self._joined(joins.left_join, key, other)

    def right_join(self, key, other: Frame | DataFrame) -> Frame:
        return self._joined(joins.right_join, key, other)

    def left_join_asof(self, key, other: Frame | DataFrame, op: str = "<=", **kwargs) -> Frame:
        return self._with(joins.left_join_asof(key, self.df, _plain(other), op, **kwargs))

    def pd_merge(self, other: Frame | DataFrame, how: str = "inner", **kwargs) -> Frame:
        return self._with(joins.pd_merge(self.df, _plain(other), how, **kwargs))

    def _joined(self, fn, key, other) -> Frame:
        right = other.name if isinstance(other, Frame) and other.name != "_unnamed" else "right"
        return self._with(fn(key, self.df, _plain(other), "left" if self.name == "_unnamed" else self.name, right))

    def group_by_column_agg(self, keys: Order, aggs, **kwargs) -> Frame:
        return self._with(reductions.group_by_column_agg(keys, aggs, self.df, **kwargs))

    def aggregate(self, aggs, **kwargs) -> Frame:
        return self._with(reductions.aggregate(aggs, self.df, **kwargs))

    def write(self, path: str, **kwargs) -> None:
        writers.write_dataset(self.df, path, **kwargs)

    def ensure_array_backed(self) -> Frame:
        """Keeps the table in memory and on disk; a lost part is computed again."""
        return Frame(self.df.persist(StorageLevel.MEMORY_AND_DISK), self.order, self.name)

    def with_row_ids(self, name: str = ROW_ID) -> Frame:
        return Frame(with_row_ids(self.df, self.order, name), [name], self.name)


def _plain(x) -> DataFrame:
    return x.df if isinstance(x, Frame) else x


def dataset_to_data(df: DataFrame) -> dict:
    """Names, types, metadata and values of a table that the driver can hold."""
    table = df.toArrow()
    return {"version": 2, "columns": [{"name": f.name, "type": f.dataType.simpleString(), "metadata": f.metadata, "data": table.column(i).to_pylist()} for i, f in enumerate(df.schema)]}


def data_to_dataset(spark, data: dict) -> DataFrame:
    schema = T.StructType([T.StructField(x["name"], T._parse_datatype_string(x["type"]), True, x["metadata"]) for x in data["columns"]])
    return spark.createDataFrame(list(zip(*[x["data"] for x in data["columns"]])), schema)


def to_double_array(df: DataFrame, column: str, order: Order = (), error_on_missing: bool = False) -> np.ndarray:
    """A column on the driver as doubles; null is NaN, or an error."""
    src = df.orderBy(*[c(o) for o in names(order)]) if names(order) else df
    out = src.select(c(column).cast("double").alias("x")).toPandas()["x"].to_numpy(np.float64)
    if error_on_missing and np.isnan(out).any():
        raise ValueError(f"{column} has missing values")
    return out


def string_table_keyset(df: DataFrame, column: str) -> DataFrame:
    return df.select(c(column)).where(c(column).isNotNull()).distinct()


def column_stats(df: DataFrame, column: str, wanted: list[str]) -> dict:
    """Statistics of a column by name."""
    from weftline.functions.scalars import REDUCTIONS

    return df.agg(*[REDUCTIONS[s](c(column)).alias(s) for s in wanted]).first().asDict()


def column_safe_name(name) -> str:
    """A column name of any value: tuples' parts are joined by dashes."""
    return "-".join(map(str, name)) if isinstance(name, (tuple, list)) else str(name)


#: Spark types by name of a datatype. Unsigned types widen to the next that holds them.
TYPES = {
    "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double",
    "string": "string", "text": "string", "keyword": "string", "symbol": "string", "uuid": "string", "local-date": "date", "packed-local-date": "date", "epoch-days": "date", "local-time": "bigint", "instant": "timestamp", "packed-instant": "timestamp",
    "epoch-milliseconds": "timestamp", "epoch-microseconds": "timestamp", "local-date-time": "timestamp_ntz", "zoned-date-time": "timestamp", "duration": "interval day to second", "packed-duration": "interval day to second",
}


def datatype_to_sql_type(name: str) -> T.DataType:
    return T._parse_datatype_string(TYPES[name])


memoize = functools.lru_cache


def empty_dataset(spark) -> DataFrame:
    return spark.createDataFrame([], T.StructType())


def partitions_of(df: DataFrame, rows_each: int, order: Order) -> DataFrame:
    """df with the number of the batch of rows_each rows, in order, that a row is in."""
    return with_row_ids(df, order).withColumn("batch", F.floor(F.col(ROW_ID) / rows_each)).drop(ROW_ID)
