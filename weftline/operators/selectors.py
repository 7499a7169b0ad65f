"""Column selectors: names, predicates over the schema, and those that need the data."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.order import c

Selector = str | Iterable[str] | DataFrame | Callable[[DataFrame], object] | None
DATETIMES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def resolve(df: DataFrame, selector: Selector) -> list[str]:
    """Names in the order of df for a predicate or 'all'; in the order given, without repeats, for names. A name that isn't there is an error."""
    if selector is None or (isinstance(selector, str) and selector == "all"):
        return df.columns
    if callable(selector) and not isinstance(selector, DataFrame):
        selector = selector(df)
    if isinstance(selector, DataFrame):
        selector = selector.columns
    out = list(dict.fromkeys([selector] if isinstance(selector, str) else selector))
    if missing := [x for x in out if x not in df.columns]:
        raise KeyError(f"no such columns: {missing}")
    return out


def column_filter(df: DataFrame, keep: Callable[[T.StructField], bool]) -> DataFrame:
    return df.select(*[c(f.name) for f in df.schema if keep(f)])


def metadata_filter(df: DataFrame, keep: Callable[[dict], bool]) -> DataFrame:
    return column_filter(df, lambda f: keep(f.metadata or {}))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, DATETIMES) or type(kind).__name__ == "TimeType"


def numeric(df: DataFrame) -> DataFrame:
    return column_filter(df, lambda f: is_numeric(f.dataType))


def categorical(df: DataFrame) -> DataFrame:
    """Neither numeric nor boolean nor a time; a column coded as numbers by fit_categorical_map still counts."""
    return column_filter(df, lambda f: bool((f.metadata or {}).get("categorical")) or not (is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) or is_datetime(f.dataType)))


def of_datatype(df: DataFrame, kind: T.DataType | str) -> DataFrame:
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    return column_filter(df, lambda f: f.dataType == kind)


def boolean(df: DataFrame) -> DataFrame:
    return column_filter(df, lambda f: isinstance(f.dataType, T.BooleanType))


def string(df: DataFrame) -> DataFrame:
    return column_filter(df, lambda f: isinstance(f.dataType, T.StringType))


def datetime(df: DataFrame) -> DataFrame:
    return column_filter(df, lambda f: is_datetime(f.dataType))


def target(df: DataFrame) -> DataFrame:
    return metadata_filter(df, lambda m: bool(m.get("inference-target")))


def feature(df: DataFrame) -> DataFrame:
    return metadata_filter(df, lambda m: not m.get("inference-target"))


def prediction(df: DataFrame) -> DataFrame:
    return metadata_filter(df, lambda m: m.get("column-type") == "prediction")


def probability_distribution(df: DataFrame) -> DataFrame:
    return metadata_filter(df, lambda m: m.get("column-type") == "probability-distribution")


def missing_counts(df: DataFrame, selector: Selector = None) -> dict[str, int]:
    """How many nulls each column has, in one pass."""
    cols = resolve(df, selector)
    return dict(zip(cols, df.agg(*[F.count_if(c(x).isNull()) for x in cols]).first())) if cols else {}


def missing(df: DataFrame) -> DataFrame:
    n = missing_counts(df)
    return column_filter(df, lambda f: n[f.name] > 0)


def no_missing(df: DataFrame) -> DataFrame:
    n = missing_counts(df)
    return column_filter(df, lambda f: n[f.name] == 0)


def intersection(lhs: DataFrame, rhs: DataFrame) -> list[str]:
    """rhs names that lhs has too."""
    return [x for x in rhs.columns if x in lhs.columns]


def union(lhs: DataFrame, rhs: DataFrame) -> list[str]:
    return lhs.columns + [x for x in rhs.columns if x not in lhs.columns]


def difference(lhs: DataFrame, rhs: DataFrame) -> list[str]:
    return [x for x in lhs.columns if x not in rhs.columns]
