"""Rolling and expanding windows. A reducer is a pair of its kind and its column, made by the functions below.

Without partition_by a window runs over the whole table; rows are then dealt to blocks of neighbours, and each block also
gets the rows that its windows reach into.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.plans.order import BLOCK, ROW_ID, Order, c, cut_number, in_blocks, names, with_row_ids

BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Reducer:
    kind: str
    column: str
    n: int = 0


def _maker(kind: str):
    def make(column: str) -> Reducer:
        return Reducer(kind, column)

    make.__name__ = kind
    return make


mean, sum, min, max, variance, standard_deviation, first, last = map(_maker, ("mean", "sum", "min", "max", "variance", "standard_deviation", "first", "last"))


def nth(column: str, n: int) -> Reducer:
    """The n-th value of the window, from 0."""
    return Reducer("nth", column, n)


def _clean(df: DataFrame, x: str) -> Column:
    v = c(x)
    return F.nanvl(v, F.lit(None).cast(df.schema[x].dataType)) if isinstance(df.schema[x].dataType, (T.FloatType, T.DoubleType)) else v


def bounds(n: int, position: str) -> tuple[int, int]:
    """First and last row of a window of n, from its row."""
    return {"center": (-(n // 2), n - n // 2 - 1), "left": (1 - n, 0), "right": (0, n - 1)}[position]


def rolling(df: DataFrame, window: int | Mapping, reducers: Mapping[str, Reducer], order: Order, position: str = "center", edge_mode: str = "clamp", partition_by: Order = (), block_rows: int | None = None) -> DataFrame:
    """df with a column for each reducer over windows of a number of rows, or, for a map {column, size}, of neighbours in a number or time column.

    Windows of rows are always full: slots before the first row and after the last repeat its value (clamp) or are 0 (zero).
    Nulls and NaN in a window are left out. A window by a column starts at its own row: going right it holds rows whose
    distance is under size, going left the same, and in the centre half of it on either side.
    """
    if isinstance(window, Mapping):
        return _variable(df, window["column"], window["size"], reducers, order, position, partition_by)
    lo, hi = bounds(window, position)
    parts = [c(p) for p in names(partition_by)]
    cols = sorted({r.column for r in reducers.values()})
    kept = list(df.columns)
    order = names(order)
    if parts:
        whole = Window.partitionBy(*parts).orderBy(*[c(o) for o in order])
        all_rows = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        base = df.withColumns({"__i": F.row_number().over(whole) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*parts))} | {f"__f{k}": F.first(_clean(df, x)).over(all_rows) for k, x in enumerate(cols)} | {f"__l{k}": F.last(_clean(df, x)).over(all_rows) for k, x in enumerate(cols)})
        over = whole
        own = None
    else:
        size = block_rows or BLOCK_ROWS
        size = size if size > window else window
        ids = with_row_ids(df, order, "__i", block_rows)
        at = F.struct(*[c(o) for o in order])
        ends = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.struct(_clean(df, x).alias("v")), at)["v"].alias(f"{k}{i}") for i, x in enumerate(cols) for k, f in (("f", F.min_by), ("l", F.max_by))]).first()
        top = (ends["n"] - 1) // size if ends["n"] else 0
        span = F.sequence(F.greatest(F.floor((F.col("__i") - hi) / size), F.lit(0)), F.least(F.floor((F.col("__i") - lo) / size), F.lit(top)))
        base = ids.withColumns({"__n": F.lit(ends["n"])} | {f"__{k}{i}": F.lit(ends[f"{k}{i}"]).cast(df.schema[x].dataType) for i, x in enumerate(cols) for k in "fl"}).withColumn("__b", F.explode(span))
        over = Window.partitionBy("__b").orderBy("__i")
        own = F.col("__b") == F.floor(F.col("__i") / size)
    frame = over.rowsBetween(lo, hi)
    before, after = F.greatest(-(F.col("__i") + lo), F.lit(0)), F.greatest(F.col("__i") + hi - F.col("__n") + 1, F.lit(0))
    made = {}
    for out, r in reducers.items():
        k, v = cols.index(r.column), _clean(df, r.column)
        zero = edge_mode == "zero"
        first_, last_ = (F.lit(0), F.lit(0)) if zero else (F.col(f"__f{k}"), F.col(f"__l{k}"))
        made[out] = _fixed(r, v, frame, over, lo, hi, before, after, first_, last_, zero)
    done = base.withColumns(made)
    return (done if own is None else done.where(own)).select(*[c(x) for x in kept], *[c(x) for x in made])


def _fixed(r: Reducer, v: Column, frame, over, lo: int, hi: int, before: Column, after: Column, first_: Column, last_: Column, zero: bool) -> Column:
    d = v.cast("double")
    weight = lambda x: F.when(x.isNotNull(), 1).otherwise(0)
    n = F.count(v).over(frame) + before * weight(first_) + after * weight(last_)
    edge = lambda f: before * F.coalesce(f(first_.cast("double")), F.lit(0.0)) + after * F.coalesce(f(last_.cast("double")), F.lit(0.0))
    total = F.coalesce(F.sum(d).over(frame), F.lit(0.0)) + edge(lambda x: x)
    if r.kind == "sum":
        return F.when(n > 0, total)
    if r.kind == "mean":
        return total / F.nullif(n, F.lit(0))
    if r.kind in ("variance", "standard_deviation"):
        m = total / F.nullif(n, F.lit(0))
        inside = F.count(v).over(frame)
        apart = inside * F.coalesce(F.var_pop(d).over(frame) + (F.avg(d).over(frame) - m) * (F.avg(d).over(frame) - m), F.lit(0.0)) + edge(lambda x: (x - m) * (x - m))
        var = F.when(n > 1, apart / (n - 1))
        return var if r.kind == "variance" else F.sqrt(var)
    if r.kind in ("min", "max"):
        pick, both = (F.min, F.least) if r.kind == "min" else (F.max, F.greatest)
        return both(pick(v).over(frame), F.when(before + after > 0, F.lit(0).cast("double"))) if zero else pick(v).over(frame)
    slot = {"first": 0, "last": hi - lo}.get(r.kind, r.n)
    off = lo + slot
    moved = F.lag(v, -off).over(over) if off < 0 else F.lead(v, off).over(over)
    i = F.col("__i") + off
    return F.when(i < 0, first_).when(i >= F.col("__n"), last_).otherwise(moved)


def _variable(df: DataFrame, column: str, size: float, reducers: Mapping[str, Reducer], order: Order, position: str, partition_by: Order) -> DataFrame:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key, reach = F.unix_micros(c(column).cast("timestamp")), round(size * 1_000_000)  # size in seconds
    elif isinstance(kind, T.DateType):
        key, reach = F.unix_date(c(column)).cast("bigint"), round(size)
    elif isinstance(kind, T.IntegralType):
        key, reach = c(column).cast("bigint"), round(size)
    else:
        key, reach = F.round(c(column).cast("double") * 1_000_000).cast("bigint"), round(size * 1_000_000)
    lo, hi = {"right": (0, reach - 1), "left": (1 - reach, 0), "center": (-(reach // 2), reach - reach // 2 - 1)}[position]
    parts, order, kept = [c(p) for p in names(partition_by)], names(order), list(df.columns)
    at = F.struct(*[c(o) for o in order])
    base = df.withColumns({"__k": key, "__at": at})
    if parts:
        own = None
    else:
        count = base.where("__k IS NOT NULL").count()
        blocks = count // BLOCK_ROWS + 1
        cuts = base.approxQuantile("__k", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
        cuts = sorted({int(x) for x in cuts})
        cell = lambda x: F.when(x.isNotNull(), cut_number(x, [F.lit(v).cast("bigint") for v in cuts]))
        # rows without a key see none, so that any block will do
        alone = F.array((-1 - F.pmod(F.xxhash64("__at"), F.lit(blocks))).cast("int"))
        base = base.withColumn("__b", F.explode(F.coalesce(F.sequence(cell(F.col("__k") - hi), cell(F.col("__k") - lo)), alone)))
        parts, own = [F.col("__b")], (F.col("__b") == cell(F.col("__k"))) | F.col("__k").isNull()
        if _by_arrow(df) and all(_plain(df, r) for r in reducers.values()):
            return _by_tables(base, own, df, reducers, kept, lo, hi, position)
    # of rows at its own place a window holds those from its own row on, in its direction
    by_key, ties = Window.partitionBy(*parts).orderBy("__k"), Window.partitionBy(*parts, "__k").orderBy("__at")
    near, far = {
        "right": (ties.rangeBetween(Window.currentRow, Window.unboundedFollowing), by_key.rangeBetween(1, hi)),
        "left": (ties.rangeBetween(Window.unboundedPreceding, Window.currentRow), by_key.rangeBetween(lo, -1)),
        "center": (by_key.rangeBetween(lo, hi), None),
    }[position]
    far = None if reach < 2 else far
    made = {out: F.when(F.col("__k").isNotNull(), _of(r, _clean(df, r.column), near, far)) for out, r in reducers.items()}
    done = base.withColumns(made)
    return (done if own is None else done.where(own)).select(*[c(x) for x in kept], *[c(x) for x in made])


def _by_arrow(df: DataFrame) -> bool:
    """Whether all columns can go through Arrow."""
    try:
        to_arrow_schema(df.schema)
    except PySparkTypeError:
        return False
    return True


def _plain(df: DataFrame, r: Reducer) -> bool:
    """Whether tables of doubles give the reducer as native frames do: sums and means of numbers, extremes of doubles."""
    kind = df.schema[r.column].dataType
    return isinstance(kind, T.NumericType) if r.kind in ("sum", "mean") else r.kind in ("min", "max") and isinstance(kind, T.DoubleType)


def _by_tables(base: DataFrame, own: Column, df: DataFrame, reducers: Mapping[str, Reducer], kept: list[str], lo: int, hi: int, position: str) -> DataFrame:
    """The reducers over blocks of base, whatever number of rows a window holds: a native frame goes through all rows of a window for each row.

    A block's rows in order have tables by powers of two: each cuts the rows in halves that meet in the middle, and holds what
    stands from each row to its middle. A window is two entries of the table in which its ends first part, so that no sum is a
    difference of others, and a row costs the logarithm of its window's rows.
    """
    cols = sorted({r.column for r in reducers.values()})
    given = base.withColumns({"__own": F.coalesce(own, F.lit(False))} | {f"__v{i}": _clean(df, x).cast("double") for i, x in enumerate(cols)})
    row = F.struct(*[c(x) for x in kept])
    slim = given.select("__b", "__k", F.dense_rank().over(Window.partitionBy("__b", "__k").orderBy("__at")).alias("__tie"), "__own", F.when(F.col("__own"), row).alias("__row"), *[f"__v{i}" for i in range(len(cols))])
    made = {out: (r.kind, cols.index(r.column)) for out, r in reducers.items()}
    fields = [T.StructField("__row", T.StructType([df.schema[x] for x in kept])), *[T.StructField(x, T.DoubleType()) for x in made]]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        null = np.array(table["__k"].is_null().to_numpy())
        key = table["__k"].fill_null(0).to_numpy()
        tie = table["__tie"].to_numpy()
        order = np.lexsort((tie, key, null))
        n = len(order) - int(null.sum())
        key, tie, mine = key[order[:n]], tie[order[:n]], table["__own"].to_numpy()[order]
        at = np.flatnonzero(mine[:n])
        start = np.searchsorted(key, key[at] + lo)
        stop = np.searchsorted(key, key[at] + hi, side="right")
        if position != "center":
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])]) if n else np.zeros(0, np.int64)
            peers = np.searchsorted(new, at, side="right")
            start, stop = (new[peers - 1], stop) if position == "right" else (start, np.r_[new, n][peers])
        values = [table[f"__v{i}"].to_numpy()[order[:n]].astype(float) for i in range(len(cols))]
        out = {}
        for name, (kind, i) in made.items():
            v, there = values[i], ~np.isnan(values[i])
            counts = np.r_[0, np.cumsum(there)]
            count = counts[stop] - counts[start]
            rest, join = {"min": (np.inf, np.minimum), "max": (-np.inf, np.maximum)}.get(kind, (0.0, np.add))
            got = _over(np.where(there, v, rest), start, stop, join, rest)
            if kind == "mean":
                got = got / np.maximum(count, 1)
            full = np.zeros(int(mine.sum()))
            full[: len(at)] = got
            mask = np.ones(len(full), bool)
            mask[: len(at)] = count == 0
            out[name] = pa.array(full, pa.float64(), mask=mask)
        rows = table["__row"].take(pa.array(order[np.flatnonzero(mine)]))
        return pa.table({"__row": rows, **out})

    done = slim.groupBy("__b").applyInArrow(run, T.StructType(fields))
    return done.select(*[c("__row")[x].alias(x) for x in kept], *[c(x) for x in made])


def _over(v: np.ndarray, start: np.ndarray, stop: np.ndarray, join: np.ufunc, rest: float) -> np.ndarray:
    """join over v[start:stop] for each start and stop; rest is what changes nothing."""
    out = np.full(len(start), rest)
    last = stop - 1
    single = last == start
    out[single] = v[start[single]]
    level = np.where(last > start, np.frexp((start ^ last).astype(float))[1], 0)
    for k in np.unique(level[level > 0]):
        half = 1 << (int(k) - 1)
        size = -(-len(v) // (2 * half))
        both = np.concatenate([v, np.full(size * 2 * half - len(v), rest)]).reshape(size, 2, half)
        left = join.accumulate(both[:, 0, ::-1], axis=1)[:, ::-1].ravel()
        right = join.accumulate(both[:, 1], axis=1).ravel()
        w = level == k
        s, e = start[w], last[w]
        cell = s // (2 * half) * half
        out[w] = join(left[cell + s % (2 * half)], right[cell + e % (2 * half) - half])
    return out


def _of(r: Reducer, v: Column, near, far) -> Column:
    """A reducer over the rows of a frame, or of two that have no row in common."""
    d = v.cast("double")
    frames = [near] if far is None else [near, far]
    joined = lambda f: [f(w) for w in frames]
    if r.kind in ("min", "max"):
        got = joined(lambda w: (F.min if r.kind == "min" else F.max)(v).over(w))
        return got[0] if far is None else (F.least if r.kind == "min" else F.greatest)(*got)
    if r.kind in ("first", "last", "nth"):
        slot = F.struct("__k", "__at", v.alias("v"))
        if r.kind == "nth":
            lists = joined(lambda w: F.collect_list(slot).over(w))
            return F.get(F.array_sort(F.concat(*lists)), F.lit(r.n))["v"]
        pick, both = (F.min, F.least) if r.kind == "first" else (F.max, F.greatest)
        got = joined(lambda w: pick(slot).over(w))
        return (got[0] if far is None else both(*got))["v"]
    n = adder(*joined(lambda w: F.count(v).over(w)))
    total = adder(*joined(lambda w: F.coalesce(F.sum(d).over(w), F.lit(0.0))))
    m = total / F.nullif(n, F.lit(0))
    if r.kind == "sum":
        return F.when(n > 0, total)
    if r.kind == "mean":
        return m
    apart = adder(*joined(lambda w: F.count(v).over(w) * F.coalesce(F.var_pop(d).over(w) + (F.avg(d).over(w) - m) * (F.avg(d).over(w) - m), F.lit(0.0))))
    var = F.when(n > 1, apart / (n - 1))
    return var if r.kind == "variance" else F.sqrt(var)


def adder(first_: Column, *more: Column) -> Column:
    for x in more:
        first_ = first_ + x
    return first_


def expanding(df: DataFrame, reducers: Mapping[str, Reducer], order: Order, partition_by: Order = (), block_rows: int | None = None) -> DataFrame:
    """df with a column for each reducer over all rows up to each. Blocks keep running sums and take what the blocks before them sum to."""
    order, kept = names(order), list(df.columns)
    by = [c(o) for o in order]
    if names(partition_by):
        base, over, groups = df, Window.partitionBy(*[c(p) for p in names(partition_by)]).orderBy(*by), None
    else:
        base, over = in_blocks(df, order, block_rows), Window.partitionBy(BLOCK).orderBy(*by)
        groups = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    over = over.rowsBetween(Window.unboundedPreceding, 0)
    spread = sorted({r.column for r in reducers.values() if r.kind in ("variance", "standard_deviation")})
    # squares are of distances from the mean of all rows, so that large values leave them their digits
    centre = df.agg(*[F.avg(_clean(df, x).cast("double")).alias(x) for x in spread]).first().asDict() if spread and groups is not None else {}

    def part(k: str, x: str) -> Column:
        v = _clean(df, x)
        away = v.cast("double") - F.lit(centre.get(x) or 0.0)
        return {"n": F.count(v), "s": F.sum(v.cast("double")), "t": F.sum(away), "q": F.sum(away * away), "lo": F.min(v), "hi": F.max(v)}[k]

    join = {"n": F.sum, "s": F.sum, "t": F.sum, "q": F.sum, "lo": F.min, "hi": F.max}
    squares = "ntq" if groups is not None else ""
    need = {"sum": "ns", "mean": "ns", "variance": squares, "standard_deviation": squares, "min": ["lo"], "max": ["hi"], "last": [], "first": []}
    wanted = sorted({(r.column, k) for r in reducers.values() for k in need[r.kind]})
    running = {f"__{k}_{x}": part(k, x).over(over) for x, k in wanted}
    done = base.withColumns(running)
    if groups is not None:
        sums = base.groupBy(F.col(BLOCK).alias("__b")).agg(F.lit(1).alias("__one"), *[part(k, x).alias(f"__p{k}_{x}") for x, k in wanted])
        sums = sums.select("__b", *[join[k](c(f"__p{k}_{x}")).over(groups).alias(f"__p{k}_{x}") for x, k in wanted])
        done = done.join(F.broadcast(sums), F.col(BLOCK) == F.col("__b"))
    pick = {"n": lambda a, b: a + F.coalesce(b, F.lit(0)), "s": lambda a, b: F.coalesce(a + b, a, b), "t": lambda a, b: F.coalesce(a + b, a, b), "q": lambda a, b: F.coalesce(a + b, a, b), "lo": F.least, "hi": F.greatest}

    def got(x: str, k: str) -> Column:
        return c(f"__{k}_{x}") if groups is None else pick[k](c(f"__{k}_{x}"), c(f"__p{k}_{x}"))

    start = None if groups is None or not any(r.kind == "first" for r in reducers.values()) else df.agg(*[F.min_by(F.struct(_clean(df, x).alias("v")), F.struct(*by))["v"].alias(x) for x in {r.column for r in reducers.values() if r.kind == "first"}]).first()
    made = {}
    for out, r in reducers.items():
        x = r.column
        if r.kind == "last":
            made[out] = _clean(df, x)
        elif r.kind == "first":
            made[out] = F.first(_clean(df, x)).over(over) if start is None else F.lit(start[x]).cast(df.schema[x].dataType)
        elif r.kind in ("min", "max"):
            made[out] = got(x, "lo" if r.kind == "min" else "hi")
        elif r.kind == "sum":
            made[out] = got(x, "s")
        elif r.kind == "mean":
            made[out] = got(x, "s") / F.nullif(got(x, "n"), F.lit(0))
        else:
            if groups is None:
                v = _clean(df, x).cast("double")
                var = F.when(F.count(v).over(over) > 1, F.var_samp(v).over(over))
            else:
                n, t = got(x, "n"), got(x, "t")
                var = F.when(n > 1, F.greatest(got(x, "q") - t * t / n, F.lit(0.0)) / (n - 1))
            made[out] = var if r.kind == "variance" else F.sqrt(var)
    return done.select(*[c(x) for x in kept], *[v.alias(k) for k, v in made.items()])


def row_ids(df: DataFrame, order: Order) -> DataFrame:
    return with_row_ids(df, order, ROW_ID)
