"""Missing values, which are nulls."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.selectors import Selector, is_datetime, is_numeric, resolve
from weftline.plans.order import ROW_ID, Order, c, carry, names, with_row_ids

STRATEGIES = ("mid", "nearest", "midpoint", "lerp", "down", "up", "downup", "updown", "value", "abb")


def replace_missing(df: DataFrame, selector: Selector = None, strategy: str = "mid", value=None, order: Order | None = None, partition_by: Order = (), seed: int = 0) -> DataFrame:
    """Fills nulls of the columns.

    down: the value before; up: the one after; downup, updown: the other where there is none; value fills what is left.
    mid or nearest: the nearer one by rows, the first half of a run (the larger, if odd) the one before. lerp: on the line
    between both, by rows; midpoint: their mean; both like nearest at the ends, and like down for what is neither number nor time.
    value: a value, a map of values by column, or a function of the column to an aggregate. abb: values drawn from a draw of
    those there.
    """
    cols = resolve(df, selector)
    if strategy == "value":
        return _with_values(df, cols, value)
    if strategy == "abb":
        return _with_draws(df, cols, seed)
    if order is None:
        raise ValueError("this strategy needs an order")
    kept, order = list(df.columns), names(order)
    if strategy in ("down", "up", "downup", "updown"):
        out = df
        if strategy != "up":
            out = carry(out, order, {f"__d_{x}": c(x) for x in cols}, True, False, partition_by)
        if strategy != "down":
            out = carry(out, order, {f"__u_{x}": c(x) for x in cols}, False, False, partition_by)
        pick = {"down": "d", "up": "u", "downup": "du", "updown": "ud"}[strategy]
        fall = _fallback(df, cols, value)
        made = {x: F.coalesce(*[c(f"__{k}_{x}") for k in pick], *fall[x]) for x in cols}
        return out.select(*[made[x].alias(x) if x in made else c(x) for x in kept])
    if names(partition_by):
        w = Window.partitionBy(*[c(p) for p in names(partition_by)]).orderBy(*[c(o) for o in order])
        ids = df.withColumn(ROW_ID, F.row_number().over(w).cast("bigint"))
    else:
        ids = with_row_ids(df, order)
    near = {x: F.when(c(x).isNotNull(), F.struct(c(ROW_ID).alias("i"), c(x).alias("v"))) for x in cols}
    out = carry(ids, [ROW_ID], {f"__d_{x}": near[x] for x in cols}, True, False, partition_by)
    out = carry(out, [ROW_ID], {f"__u_{x}": F.when(c(x).isNotNull(), F.struct(c(ROW_ID).alias("i"), c(x).alias("v"))) for x in cols}, False, False, partition_by)
    made = {x: _between(df.schema[x].dataType, strategy, c(x), c(f"__d_{x}"), c(f"__u_{x}")) for x in cols}
    return out.select(*[made[x].alias(x) if x in made else c(x) for x in kept])


def _between(kind: T.DataType, strategy: str, x: Column, prev: Column, nxt: Column) -> Column:
    i = F.col(ROW_ID)
    lone = F.coalesce(prev["v"], nxt["v"])
    if strategy in ("mid", "nearest"):
        return F.when(x.isNotNull(), x).when(prev.isNull() | nxt.isNull(), lone).when(i - prev["i"] <= nxt["i"] - i, prev["v"]).otherwise(nxt["v"])
    if not (is_numeric(kind) or is_datetime(kind)):
        return F.coalesce(x, lone)
    a, b = _number(kind, prev["v"]), _number(kind, nxt["v"])
    share = (i - prev["i"]) / (nxt["i"] - prev["i"]) if strategy == "lerp" else F.lit(0.5)
    return F.when(x.isNotNull(), x).when(prev.isNull() | nxt.isNull(), lone).otherwise(_back(kind, a + (b - a) * share))


def _number(kind: T.DataType, x: Column) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_millis(x.cast("timestamp")).cast("double")
    return F.unix_millis(x).cast("double") if isinstance(kind, T.TimestampType) else x.cast("double")


def _back(kind: T.DataType, x: Column) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.floor(x).cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_millis(F.floor(x).cast("bigint")).cast(kind)
    return (F.round(x) if isinstance(kind, T.IntegralType) else x).cast(kind)


def _fallback(df: DataFrame, cols: list[str], value) -> dict[str, list[Column]]:
    if value is None:
        return {x: [] for x in cols}
    if isinstance(value, Mapping):
        return {x: [F.lit(value[x]).cast(df.schema[x].dataType)] if x in value else [] for x in cols}
    if callable(value) and not isinstance(value, Column):
        got = df.agg(*[value(c(x)) for x in cols]).first()
        return {x: [F.lit(v).cast(df.schema[x].dataType)] for x, v in zip(cols, got)}
    return {x: [(value if isinstance(value, Column) else F.lit(value)).cast(df.schema[x].dataType)] for x in cols}


def _with_values(df: DataFrame, cols: list[str], value) -> DataFrame:
    fall = _fallback(df, cols, value)
    return df.withColumns({x: F.coalesce(c(x), *fall[x]) for x in cols})


def _with_draws(df: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """Approximate Bayesian bootstrap: of the n values that are there n are drawn with replacement, and each null one of those. The j-th draw is the value at hash(j) of n, so that no drawn value need be held."""
    out = df
    for k, x in enumerate(cols):
        there = with_row_ids(df.where(c(x).isNotNull()).select(c(x).alias("__v")), "__v", "__at")
        n = there.count()
        if n:
            draw = F.pmod(F.xxhash64(F.lit(seed + k), F.floor(F.rand(seed + 31 * k + 1) * n)), F.lit(n))
            # rows that need none go to as many places as there are of them
            at = F.when(c(x).isNull(), draw).otherwise(-1 - F.floor(F.rand(seed + 31 * k + 2) * (1 << 40)).cast("bigint"))
            out = out.withColumn("__at", at).join(there, "__at", "left").select(*[F.coalesce(c(x), F.col("__v")).alias(x) if y == x else c(y) for y in df.columns])
    return out


def replace_missing_value(df: DataFrame, value, selector: Selector = None) -> DataFrame:
    return _with_values(df, resolve(df, selector), value)


def set_missing(df: DataFrame, name: str, rows: list[int], order: Order) -> DataFrame:
    """df with null in the rows of these ids."""
    gone = df.sparkSession.createDataFrame([(r,) for r in rows], "__want bigint").distinct()
    out = with_row_ids(df, order).join(gone, F.col(ROW_ID) == F.col("__want"), "left")
    return out.select(*[F.when(F.col("__want").isNull(), c(x)).alias(x) if x == name else c(x) for x in df.columns])


def is_missing(name: str) -> Column:
    return c(name).isNull()


def union_missing(columns: list[str]) -> Column:
    """Rows with a null in any of the columns."""
    out = F.lit(False)
    for x in columns:
        out = out | c(x).isNull()
    return out


def intersect_missing(columns: list[str]) -> Column:
    """Rows with nulls in all of the columns."""
    out = F.lit(bool(columns))
    for x in columns:
        out = out & c(x).isNull()
    return out


def fill_range_replace(df: DataFrame, column: str, max_span: float, strategy: str | None = "down", value=None) -> DataFrame:
    """Adds rows so that neighbours in column are at most max_span apart, evenly between them, and fills the other columns by strategy, or leaves them null. max_span: seconds for times, days for dates. Null keys go."""
    kind = df.schema[column].dataType
    rows = df.where(c(column).isNotNull())
    key = {T.TimestampType: lambda x: F.unix_micros(x) / 1e6, T.DateType: lambda x: F.unix_date(x).cast("double")}.get(type(kind), lambda x: x.cast("double"))
    marked = carry(rows, [column], {"__prev": F.struct(key(c(column)).alias("k"))}, True, True)
    gap = key(c(column)) - F.col("__prev.k")
    n = F.when(F.col("__prev").isNotNull() & (gap > max_span), F.ceil(gap / max_span) - 1).otherwise(0)
    back = {T.TimestampType: lambda x: F.timestamp_micros((x * 1e6).cast("bigint")), T.DateType: lambda x: F.date_from_unix_date(F.floor(x).cast("int"))}.get(type(kind), lambda x: x.cast("double"))
    whole = isinstance(kind, T.IntegralType)
    own = rows.select(*[c(x).cast("double").alias(x) if whole and x == column else c(x) for x in df.columns])
    steps = marked.withColumn("__n", n).where("__n > 0").select(F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__i"), "__n", F.col("__prev.k").alias("__a"), gap.alias("__g"))
    extra = steps.select(*[back(F.col("__a") + F.col("__g") * F.col("__i") / (F.col("__n") + 1)).alias(x) if x == column else F.lit(None).cast(df.schema[x].dataType).alias(x) for x in df.columns])
    out = own.unionByName(extra)
    others = [x for x in df.columns if x != column]
    return replace_missing(out, others, strategy, value, column) if strategy and others else out
