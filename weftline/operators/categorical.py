"""Categories as numbers and as 0/1 columns. Fitted maps are small dataclasses and are kept in column metadata."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.selectors import Selector, resolve
from weftline.plans.order import c

#: Categories of a column at most: a map is a literal in the plan.
MOST = 100_000


@dataclass(frozen=True)
class CategoricalMap:
    src_column: str
    lookup: dict
    dtype: str = "double"


@dataclass(frozen=True)
class OneHotMap:
    src_column: str
    table: dict
    dtype: str = "tinyint"


def _values(df: DataFrame, column: str) -> list:
    got = df.where(c(column).isNotNull()).select(c(column)).distinct().limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"{column} has over {MOST} categories")
    return sorted(r[0] for r in got)


def create_categorical_map(lookup: Mapping, src_column: str, dtype: str = "double") -> CategoricalMap:
    return CategoricalMap(src_column, dict(lookup), dtype)


def fit_categorical_map(df: DataFrame, column: str, pairs: Iterable = (), dtype: str = "double") -> CategoricalMap:
    """Numbers for values: pairs given first (a value alone takes the next number), then the rest, sorted, the free ones."""
    lookup: dict = {}
    for i, p in enumerate(pairs):
        k, v = p if isinstance(p, tuple) else (p, i)
        lookup[k] = v
    free = (i for i in range(MOST * 2) if i not in set(lookup.values()))
    for v in _values(df, column):
        if v not in lookup:
            lookup[v] = next(free)
    return CategoricalMap(column, lookup, dtype)


def _looked_up(x: Column, table: Mapping, what: str) -> Column:
    if not table:
        return F.when(x.isNotNull(), F.raise_error(F.lit(f"unknown {what}")))
    pairs = [F.lit(y) for kv in table.items() for y in kv]
    m = F.create_map(*pairs)
    return F.when(x.isNotNull(), F.coalesce(F.try_element_at(m, x), F.raise_error(F.concat(F.lit(f"unknown {what}: "), x.cast("string")))))


def transform_categorical_map(df: DataFrame, fit: CategoricalMap) -> DataFrame:
    """Values become numbers; null stays null; a value that isn't in the map is an error."""
    made = _looked_up(c(fit.src_column), fit.lookup, "category").cast(fit.dtype)
    meta = {"categorical": json.dumps({"lookup": [[k, v] for k, v in fit.lookup.items()], "dtype": fit.dtype}, default=str)}
    meta |= {k: v for k, v in (df.schema[fit.src_column].metadata or {}).items() if k != "categorical"}
    return df.withColumn(fit.src_column, made).withMetadata(fit.src_column, meta)


def invert_categorical_map(df: DataFrame, fit: CategoricalMap) -> DataFrame:
    back = {float(v): k for k, v in fit.lookup.items()}
    out = df.withColumn(fit.src_column, _looked_up(c(fit.src_column).cast("double"), back, "number"))
    meta = {k: v for k, v in (df.schema[fit.src_column].metadata or {}).items() if k != "categorical"}
    return out.withMetadata(fit.src_column, meta)


def fit_one_hot(df: DataFrame, column: str, values: Iterable = (), dtype: str = "tinyint") -> OneHotMap:
    """Names <column>-<value> for values, those given first."""
    order = list(dict.fromkeys([*values, *_values(df, column)]))
    return OneHotMap(column, {v: f"{column}-{v}" for v in order}, dtype)


def transform_one_hot(df: DataFrame, fit: OneHotMap) -> DataFrame:
    """A 0/1 column for each value in place of the column; null is 0 in all."""
    meta = {"one-hot": json.dumps({"column": fit.src_column, "table": [[k, v] for k, v in fit.table.items()]}, default=str)}
    made = [F.when(c(fit.src_column) == F.lit(v), 1).otherwise(0).cast(fit.dtype).alias(n, metadata=meta) for v, n in fit.table.items()]
    return df.select(*[c(x) for x in df.columns if x != fit.src_column], *made)


def invert_one_hot_map(df: DataFrame, fit: OneHotMap) -> DataFrame:
    own = set(fit.table.values())
    value = F.coalesce(*[F.when(c(n) == 1, F.lit(v)) for v, n in fit.table.items()])
    return df.select(*[c(x) for x in df.columns if x not in own], value.alias(fit.src_column))


def dataset_categorical_maps(df: DataFrame) -> list[CategoricalMap]:
    out = []
    for f in df.schema:
        if held := (f.metadata or {}).get("categorical"):
            m = json.loads(held)
            out.append(CategoricalMap(f.name, {k: v for k, v in m["lookup"]}, m["dtype"]))
    return out


def dataset_one_hot_maps(df: DataFrame) -> list[OneHotMap]:
    found = {(f.metadata or {}).get("one-hot"): None for f in df.schema}
    return [OneHotMap(m["column"], {k: v for k, v in m["table"]}) for m in (json.loads(x) for x in found if x)]


def reverse_map_categorical_xforms(df: DataFrame) -> DataFrame:
    for m in dataset_categorical_maps(df):
        df = invert_categorical_map(df, m)
    for m in dataset_one_hot_maps(df):
        df = invert_one_hot_map(df, m)
    return df


def categorical_to_number(df: DataFrame, selector: Selector, pairs: Iterable = (), dtype: str = "double") -> DataFrame:
    for x in resolve(df, selector):
        df = transform_categorical_map(df, fit_categorical_map(df, x, pairs, dtype))
    return df


def categorical_to_one_hot(df: DataFrame, selector: Selector, values: Iterable = (), dtype: str = "tinyint") -> DataFrame:
    for x in resolve(df, selector):
        df = transform_one_hot(df, fit_one_hot(df, x, values, dtype))
    return df
