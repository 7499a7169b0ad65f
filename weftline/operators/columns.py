"""Projections and operations on columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.selectors import Selector, missing_counts, resolve
from weftline.plans.order import ROW_ID, Order, c, with_row_ids


def value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def select(df: DataFrame, columns="all", rows="all", order: Order | None = None) -> DataFrame:
    """Columns (names, 'all', or a map of old to new names) by rows (ids, booleans, a condition or 'all'). Row ids need an order."""
    from weftline.operators.rows import select_rows

    out = df if isinstance(rows, str) and rows == "all" else select_rows(df, rows, order)
    if isinstance(columns, Mapping):
        return out.select(*[c(k).alias(v) for k, v in columns.items()])
    return out.select(*[c(x) for x in resolve(out, columns)])


def _at(df: DataFrame, index: int | Iterable[int]) -> list[str]:
    return [df.columns[i] for i in ([index] if isinstance(index, int) else index)]


def select_columns(df: DataFrame, selector: Selector) -> DataFrame:
    return df.select(*[c(x) for x in resolve(df, selector)])


def select_columns_by_index(df: DataFrame, index: int | Iterable[int]) -> DataFrame:
    """By place, from the end if negative; repeats count once."""
    return df.select(*[c(x) for x in dict.fromkeys(_at(df, index))])


def select_by_index(df: DataFrame, columns, rows, order: Order) -> DataFrame:
    names = "all" if isinstance(columns, str) else _at(df, columns)
    return select(df, names, rows, order)


def unordered_select(df: DataFrame, columns: Iterable[str], rows="all", order: Order | None = None) -> DataFrame:
    """Chosen columns in df's own order."""
    chosen = set(columns)
    return select(df, [x for x in df.columns if x in chosen], rows, order)


def remove_column(df: DataFrame, name: str) -> DataFrame:
    """A name that isn't there changes nothing."""
    return df.select(*[c(x) for x in df.columns if x != name])


def remove_columns(df: DataFrame, selector: Selector) -> DataFrame:
    gone = set(resolve(df, selector)) if callable(selector) or isinstance(selector, DataFrame) else {selector} if isinstance(selector, str) else set(selector or ())
    return df.select(*[c(x) for x in df.columns if x not in gone])


def drop_columns(df: DataFrame | None, selector: Selector) -> DataFrame | None:
    return None if df is None else remove_columns(df, selector)


def rename_columns(df: DataFrame, new: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """A map renames those it has; a list renames all and must have as many."""
    if isinstance(new, Mapping):
        return df.select(*[c(x).alias(new.get(x, x)) for x in df.columns])
    if len(new) != len(df.columns):
        raise ValueError(f"{len(new)} names for {len(df.columns)} columns")
    return df.toDF(*new)


def add_or_update_column(df: DataFrame, name: str, x) -> DataFrame:
    return df.withColumn(name, value(x))


add_column = new_column = add_or_update_column


def assoc_ds(df: DataFrame | None, spark=None, **columns) -> DataFrame:
    """Adds or replaces several columns; single values go to all rows. Without a table, a table of one row."""
    if df is None:
        return spark.range(1).select(*[value(x).alias(k) for k, x in columns.items()])
    return df.withColumns({k: value(x) for k, x in columns.items()})


def update_column(df: DataFrame, name: str, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(name, fn(c(name)))


def update_columns(df: DataFrame, selector: Selector, fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({x: fn(c(x)) for x in resolve(df, selector)})


update_columnwise = update_columns


def update_elemwise(df: DataFrame, selector: Selector, fn: Callable, dtype: T.DataType | str | None = None) -> DataFrame:
    """fn of each value: an expression of the column if no dtype is given, else a Python function that runs on Arrow batches. Nulls stay null."""
    cols = resolve(df, selector)
    if dtype is None:
        return df.withColumns({x: F.when(c(x).isNotNull(), fn(c(x))) for x in cols})
    udf = F.pandas_udf(lambda s: s.map(fn, na_action="ignore"), dtype)
    udf.func.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumns({x: udf(c(x)) for x in cols})


def order_column_names(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    chosen = set(wanted)
    return [x for x in df.columns if x in chosen]


def extend_with_empty(df: DataFrame, n: int) -> DataFrame:
    """n more rows of nulls."""
    nulls = df.sparkSession.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(nulls)


def check_empty(df: DataFrame) -> DataFrame | None:
    return df if df.columns else None


def append_columns(df: DataFrame, other: DataFrame, order: Order, other_order: Order) -> DataFrame:
    """Columns of other beside those of df, row by row in the orders given; the shorter side ends in nulls."""
    if clash := set(df.columns) & set(other.columns):
        raise ValueError(f"columns of both: {sorted(clash)}")
    lhs, rhs = with_row_ids(df, order, ROW_ID), with_row_ids(other, other_order, "__other_id")
    return lhs.join(rhs, F.col(ROW_ID) == F.col("__other_id"), "full").select(*[c(x) for x in df.columns + other.columns])


def filter_dataset(df: DataFrame, selector: Selector) -> DataFrame:
    return select_columns(df, selector)


def update(df: DataFrame, selector: Selector, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fn of the chosen columns, which come back in place of them; fn keeps rows as they are and only adds expressions."""
    own = resolve(df, selector)
    hidden = {x: f"__keep_{i}" for i, x in enumerate(df.columns) if x not in own}
    out = fn(df.select(*[c(x) for x in own], *[c(x).alias(h) for x, h in hidden.items()]))
    new = [x for x in out.columns if x not in hidden.values()]
    kept = [c(hidden[x]).alias(x) if x in hidden else c(x) for x in df.columns if x in hidden and x not in new or x in new]
    return out.select(*kept, *[c(x) for x in new if x not in df.columns])


def column_map(df: DataFrame, name: str, fn: Callable, selector: Selector, dtype: T.DataType | str | None = None, missing: str = "any") -> DataFrame:
    """A column from others: an expression of them, or with dtype a Python function of values on Arrow batches. missing: the result is null if any input is ('any'), all are ('all'), or as fn says ('none')."""
    cols = resolve(df, selector)
    if dtype is None:
        made = fn(*[c(x) for x in cols])
    else:
        rows = lambda *s: pd.Series([None if (missing == "any" and any(pd.isna(v) for v in r)) or (missing == "all" and all(pd.isna(v) for v in r)) else fn(*r) for r in zip(*s)])
        rows.__annotations__ = {"return": pd.Series}
        made = F.pandas_udf(rows, dtype, F.PandasUDFType.SCALAR)(*[c(x) for x in cols])
    nulls = [c(x).isNull() for x in cols]
    if missing == "any" and nulls:
        made = F.when(~_any(nulls), made)
    elif missing == "all" and nulls:
        made = F.when(~_all(nulls), made)
    return df.withColumn(name, made)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out


def column_map_m(df: DataFrame, name: str, body: str) -> DataFrame:
    """A column from a SQL expression over the others."""
    return df.withColumn(name, F.expr(body))


def column_cast(df: DataFrame, column: str | tuple[str, str], dtype, fn: Callable[[Column], Column] | None = None, strict: bool = True) -> DataFrame:
    """A cast of column, or of the first of a pair into the second. What can't be cast is an error, or null if not strict."""
    src, dst = (column, column) if isinstance(column, str) else column
    made = fn(c(src)) if fn else c(src)
    return df.withColumn(dst, made.cast(dtype) if strict else made.try_cast(dtype))


def column_to_dataset(df: DataFrame, column: str, fn: Callable, schema: str | None = None) -> DataFrame:
    """A table with the fields that fn makes of each value: a struct expression, or with schema a Python function to a dict."""
    if schema is None:
        return df.select(fn(c(column)).alias("s")).select("s.*")

    def run(batches):
        for b in batches:
            yield pd.DataFrame([fn(v) for v in b.iloc[:, 0]], columns=names)

    names = T._parse_datatype_string(schema).names
    return df.select(c(column)).mapInPandas(run, schema)


def assoc_metadata(df: DataFrame, selector: Selector, **entries) -> DataFrame:
    out = df
    for x in resolve(df, selector):
        out = out.withMetadata(x, (out.schema[x].metadata or {}) | entries)
    return out


def empty_column_names(df: DataFrame) -> list[str]:
    """Columns that hold nulls only."""
    if not df.columns:
        return []
    n = df.agg(*[F.count(c(x)) for x in df.columns]).first()
    return [x for x, k in zip(df.columns, n) if k == 0]


def remove_empty_columns(df: DataFrame) -> DataFrame:
    return remove_columns(df, empty_column_names(df))


def columns_with_missing_seq(df: DataFrame) -> list[dict] | None:
    out = [{"column-name": k, "missing-count": v} for k, v in missing_counts(df).items() if v]
    return out or None
