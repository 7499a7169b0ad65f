"""Reshaping tables, and functions over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.order import Order, c, names


def columnwise_concat(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """A row for each of the columns: the others, the column's name and its value, in the widest type."""
    ids = [x for x in df.columns if x not in columns]
    return df.unpivot([c(x) for x in ids], [c(x) for x in columns], name, value)


def column_labeled_mapseq(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return columnwise_concat(df, columns, "label", "value")


def unroll_column(df: DataFrame, name: str, index: str | None = None) -> DataFrame:
    """A row for each element of an array column; a column of single values is as arrays of one. Null and empty arrays have no rows; elements may be null. With index, the element's place."""
    x = c(name) if isinstance(df.schema[name].dataType, T.ArrayType) else F.when(c(name).isNotNull(), F.array(c(name)))
    others = [c(o) for o in df.columns if o != name]
    return df.select(*others, F.posexplode(x).alias(index, name)) if index else df.select(*others, F.explode(x).alias(name))


def transpose_by_key(df: DataFrame, key: str, names_to: str = "col", keys: Sequence | None = None) -> DataFrame:
    """Values of key become columns, and other columns' names rows. keys, if given, spares the pass that finds them."""
    long = columnwise_concat(df, [x for x in df.columns if x != key], names_to, "__value")
    pivot = long.groupBy(c(names_to)).pivot(key, list(keys)) if keys is not None else long.groupBy(c(names_to)).pivot(key)
    return pivot.agg(F.first("__value"))


def _merged_schema(df: DataFrame, schema: str) -> tuple[T.StructType, list[str]]:
    new = T._parse_datatype_string(schema)
    fields = [new[f.name] if f.name in new.names else f for f in df.schema] + [f for f in new if f.name not in df.columns]
    return T.StructType(fields), new.names


def row_map(df: DataFrame, fn: Callable[[dict], dict] | dict[str, Column], schema: str | None = None) -> DataFrame:
    """Columns from each row, beside or in place of those there: expressions by name, or with schema a Python function from dict to dict that runs on batches."""
    if schema is None:
        return df.withColumns(fn)
    full, new = _merged_schema(df, schema)

    def run(batches):
        for b in batches:
            made = [fn(r) or {} for r in b.to_dict("records")]
            yield b.assign(**{x: pd.Series([m.get(x) for m in made], index=b.index, dtype=object) for x in new})[full.names]

    return df.mapInPandas(run, full)


def row_mapcat(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Each row as often as fn has dicts for it, which add columns or replace them; none, no row."""
    full, _ = _merged_schema(df, schema)

    def run(batches):
        for b in batches:
            rows = [r | m for r in b.to_dict("records") for m in (fn(r) or ())]
            yield pd.DataFrame(rows, columns=full.names)

    return df.mapInPandas(run, full)


def pmap_ds(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType | None = None) -> DataFrame:
    """fn of each batch of rows."""

    def run(batches):
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema or df.schema)


def induction(df: DataFrame, fn: Callable[[pd.DataFrame], dict], schema: str, order: Order, partition_by: Order = ()) -> DataFrame:
    """Row by row, in order, columns from fn of all rows so far, those it has made included. Serial in its nature: a group's rows come together in one task; without partition_by the whole table is the group, and has to fit there."""
    full, new = _merged_schema(df, schema)
    groups = names(partition_by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(names(order), kind="stable").reset_index(drop=True)
        out: list[dict] = []
        for r in pdf.to_dict("records"):
            out.append(r | {x: None for x in new if x not in r})
            out[-1] |= fn(pd.DataFrame(out))
        return pd.DataFrame(out, columns=full.names)

    return df.groupBy(*([c(g) for g in groups] or [F.lit("all")])).applyInPandas(run, full)


def bind(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps one after another."""
    for s in steps:
        df = df.transform(s)
    return df
