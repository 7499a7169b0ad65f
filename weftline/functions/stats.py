"""Descriptive statistics, correlation, scaling and smoothing."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.selectors import Selector, is_datetime, is_numeric, numeric, resolve
from weftline.plans.order import Order, c, names

DEFAULT_STATS = ("n-valid", "n-missing", "min", "mean", "mode", "max", "standard-deviation", "skew", "first", "last")
NUMBER_STATS = ("quartile-1", "median", "quartile-3", "variance", "kurtosis", "sum")


def all_descriptive_stats_names() -> list[str]:
    return ["col-name", "datatype", *DEFAULT_STATS, *NUMBER_STATS]


supported_column_stats = all_descriptive_stats_names


def _text(x, kind: T.DataType):
    return x.cast("string")


def descriptive_stats(df: DataFrame, order: Order, stats: Iterable[str] = DEFAULT_STATS, selector: Selector = None) -> DataFrame:
    """A row for each column: name, type and statistics, from one pass (modes take another). Min, mean and the like are numbers, of times their milliseconds; mode, first and last are texts. first and last are by order."""
    stats, cols = list(stats), resolve(df, selector)
    at = F.struct(*[c(o) for o in names(order)])
    aggs, layout = [], []
    for i, x in enumerate(cols):
        kind = df.schema[x].dataType
        v = c(x)
        if is_datetime(kind) and not isinstance(kind, T.DayTimeIntervalType) and type(kind).__name__ != "TimeType":
            n = F.unix_millis(v.cast("timestamp")).cast("double")
        elif is_numeric(kind):
            n = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
        else:
            n = None
        there = n if n is not None else v
        made = {
            "n-valid": F.count(there), "n-missing": F.count_if(there.isNull()),
            "min": F.min(n) if n is not None else None, "max": F.max(n) if n is not None else None, "mean": F.avg(n) if n is not None else None,
            "standard-deviation": F.stddev_samp(n) if n is not None else None, "variance": F.var_samp(n) if n is not None else None, "skew": F.skewness(n) if n is not None else None, "kurtosis": F.kurtosis(n) if n is not None else None, "sum": F.sum(n) if n is not None else None,
            "quartile-1": F.percentile(n, F.lit(0.25)) if n is not None else None, "median": F.percentile(n, F.lit(0.5)) if n is not None else None, "quartile-3": F.percentile(n, F.lit(0.75)) if n is not None else None,
            "mode": F.mode(v, deterministic=True).cast("string") if n is None or is_numeric(kind) else None,
            "first": F.min_by(F.struct(v.cast("string").alias("v")), at)["v"], "last": F.max_by(F.struct(v.cast("string").alias("v")), at)["v"],
        }
        for s in stats:
            if made.get(s) is not None:
                aggs.append(made[s].alias(f"a{i}_{s}"))
        layout.append((x, kind.simpleString(), {s for s in stats if made.get(s) is not None}))
    wide = df.agg(*aggs)
    kinds = {s: "bigint" if s.startswith("n-") else "string" if s in ("mode", "first", "last") else "double" for s in stats}
    rows = [F.struct(F.lit(x).alias("col-name"), F.lit(kind).alias("datatype"), *[(c(f"a{i}_{s}") if s in has else F.lit(None)).cast(kinds[s]).alias(s) for s in stats]) for i, (x, kind, has) in enumerate(layout)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def brief(df: DataFrame, order: Order) -> list[dict]:
    """Statistics as dicts without nulls."""
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in descriptive_stats(df, order).collect()]


def _ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Average ranks of each column. A column's ranks come from its distinct values, counted and summed up in blocks."""
    from weftline.plans.order import BLOCK, in_blocks

    out = df
    for i, x in enumerate(cols):
        counts = in_blocks(df.where(c(x).isNotNull()).groupBy(c(x).alias("__v")).count(), "__v")
        w = Window.partitionBy(BLOCK).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        before = counts.groupBy(F.col(BLOCK).alias("__b")).agg(F.sum("count").alias("__s")).select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
        ranked = counts.join(F.broadcast(before), F.col(BLOCK) == F.col("__b")).select(F.col("__v").alias(f"__v{i}"), (F.sum("count").over(w) + F.col("__s") - (F.col("count") - 1) / 2).alias(f"__rank_{i}"))
        out = out.join(ranked, c(x) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    return out.select(*[F.col(f"__rank_{i}").alias(x) for i, x in enumerate(cols)])


def correlation_table(df: DataFrame, kind: str = "pearson", selector: Selector = None) -> DataFrame:
    """lhs, rhs, correlation of each pair of numeric columns, the strongest first. Rows with a null in either column of a pair don't count for it. pearson and spearman (of average ranks) take one pass for all pairs; kendall is tau-b, from counts of distinct pairs."""
    cols = [x for x in resolve(df, selector) if x in numeric(df).columns]
    if kind == "kendall":
        rows = [(a, b, kendall(df, a, b)) for i, a in enumerate(cols) for b in cols[i + 1 :]]
        out = df.sparkSession.createDataFrame(rows, "lhs string, rhs string, correlation double")
        return out.orderBy(F.abs("correlation").desc_nulls_last(), "lhs", "rhs")
    src = _ranks(df, cols) if kind == "spearman" else df
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "lhs string, rhs string, correlation double")
    wide = src.agg(*[F.corr(c(a).cast("double"), c(b).cast("double")).alias(f"k{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("lhs"), F.lit(b).alias("rhs"), F.col(f"k{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.abs("correlation").desc_nulls_last(), "lhs", "rhs")


def correlation(df: DataFrame, lhs: str, rhs: str, kind: str = "pearson") -> float | None:
    return correlation_table(df, kind, [lhs, rhs]).first()["correlation"]


def _agreement(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Sum over pairs of sign(dx) * sign(dy), by weight: pairs in order less pairs out of order, counted while merging."""
    rank = np.unique(y, return_inverse=True)[1]
    out = 0.0
    for sign, r in ((-1, rank), (1, -rank)):  # pairs that fall, then pairs that rise; of equal x none does either
        order = np.lexsort([r, x])
        v, w, at = r[order], weight[order], np.arange(len(x))
        width = 1
        while width < len(x):
            pair, left = at // (2 * width), (at // width) % 2 == 0
            by = np.lexsort([~left, v, pair])  # of equals the left ones first: they don't count
            lw = np.where(left, w, 0.0)[by]
            upto = np.cumsum(lw)
            end = np.searchsorted(pair[by], pair[by], side="right") - 1
            out += sign * float(((upto[end] - upto) * np.where(left, 0.0, w)[by]).sum())
            width *= 2
    return out


def kendall(df: DataFrame, lhs: str, rhs: str, cells: int = 512) -> float | None:
    """Tau-b, of all values. Both sides are cut into at most cells classes: pairs that differ in both classes are counted from how many rows each two classes hold, others inside the classes, each in a task."""
    rows = df.where(c(lhs).isNotNull() & c(rhs).isNotNull()).select(c(lhs).cast("double").alias("x"), c(rhs).cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    cuts = [sorted(set(rows.approxQuantile(v, [i / cells for i in range(cells + 1)], 1e-4))) for v in ("x", "y")]
    if not all(cuts):
        return None
    # a class holds what is at its lower end, or above it up to the next: common values are classes of their own
    place = lambda v, at: 2 * F.size(F.filter(F.array(*[F.lit(k) for k in at]), lambda k: k <= F.col(v))) - F.array_contains(F.array(*[F.lit(k) for k in at]), F.col(v)).cast("int")
    dealt = rows.withColumns({"i": place("x", cuts[0]), "j": place("y", cuts[1])})

    def inside(name: str):
        def run(key, part):
            x, y, w = (part[k].to_numpy() for k in ("x", "y", "w"))
            total = _agreement(x, y, w)
            if name == "y":  # pairs of one cell have been counted by the other side
                for _, cell in part.groupby("i"):
                    total -= _agreement(*(cell[k].to_numpy() for k in ("x", "y", "w")))
            return pd.DataFrame({"s": [total]})

        return run

    # a class of one value has no pair that differs in it
    some = lambda k, v: dealt.join(dealt.groupBy(k).agg((F.min(v) < F.max(v)).alias("some")).where("some").select(k), k)
    s = sum(some(k, v).groupBy(k).applyInPandas(inside(v), "s double").agg(F.sum("s")).first()[0] or 0.0 for k, v in (("i", "x"), ("j", "y")))
    got = dealt.groupBy("i", "j").agg(F.sum("w").alias("w")).collect()
    m = np.zeros((2 * len(cuts[0]) + 1, 2 * len(cuts[1]) + 1))
    for r in got:
        m[r.i, r.j] = r.w
    later = lambda a: a[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    s += (m[:-1, :-1] * later(m)[1:, 1:]).sum()
    flip = m[:, ::-1]
    s -= (flip[:-1, :-1] * later(flip)[1:, 1:]).sum()
    n = m.sum()
    ties = [rows.groupBy(v).agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * (F.col("w") - 1) / 2)).first()[0] for v in ("x", "y")]
    pairs = n * (n - 1) / 2
    below = np.sqrt((pairs - ties[0]) * (pairs - ties[1]))
    return float(s / below) if below else None


def fit_std_scale(df: DataFrame, selector: Selector = None, mean: bool = True, stddev: bool = True) -> dict[str, dict[str, float]]:
    cols = [x for x in resolve(df, selector) if is_numeric(df.schema[x].dataType)]
    got = df.agg(*[f(c(x).cast("double")) for x in cols for f in (F.avg, F.stddev_samp)]).first() if cols else []
    return {x: {"mean": got[2 * i] if mean else None, "standard-deviation": got[2 * i + 1] if stddev else None} for i, x in enumerate(cols)}


def transform_std_scale(df: DataFrame, fitted: dict) -> DataFrame:
    """(x - mean) / deviation; a deviation of 0 divides by 1."""
    return df.withColumns({x: (c(x).cast("double") - F.lit(f["mean"] or 0.0)) / F.lit(f["standard-deviation"] or 1.0) for x, f in fitted.items()})


def fit_minmax(df: DataFrame, selector: Selector = None, min: float = -0.5, max: float = 0.5) -> dict:
    cols = [x for x in resolve(df, selector) if is_numeric(df.schema[x].dataType)]
    got = df.agg(*[f(c(x).cast("double")) for x in cols for f in (F.min, F.max)]).first() if cols else []
    return {"min": min, "max": max, "column-data": {x: {"min": got[2 * i], "max": got[2 * i + 1]} for i, x in enumerate(cols)}}


def transform_minmax(df: DataFrame, fitted: dict) -> DataFrame:
    """Onto the range given; a column of one value goes to its lower end."""
    lo, span = fitted["min"], fitted["max"] - fitted["min"]
    made = {}
    for x, f in fitted["column-data"].items():
        width = (f["max"] or 0.0) - (f["min"] or 0.0)
        made[x] = (c(x).cast("double") - F.lit(f["min"] or 0.0)) / F.lit(width or 1.0) * span + lo
    return df.withColumns(made)


def mean_center_columns(df: DataFrame, selector: Selector = None, means: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    means = means or {x: f["mean"] for x, f in fit_std_scale(df, selector, True, False).items()}
    return df.withColumns({x: c(x).cast("double") - F.lit(m) for x, m in means.items()}), means


def loess(x: np.ndarray, y: np.ndarray, bandwidth: float = 0.75, iterations: int = 4, accuracy: float = 1e-12) -> np.ndarray:
    """Local linear regression with tricube weights of the nearest share of points, made robust by bisquare weights of the residuals."""
    n = len(x)
    k = max(2, min(n, int(bandwidth * n)))
    fit, robust = np.zeros(n), np.ones(n)
    for it in range(iterations + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            reach = np.partition(d, k - 1)[k - 1]
            w = robust * np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0) if reach > 0 else robust * (d == 0)
            total = w.sum()
            if total <= 0:
                fit[i] = y[i]
                continue
            mx, my = (w * x).sum() / total, (w * y).sum() / total
            var = (w * (x - mx) ** 2).sum()
            fit[i] = my + ((w * (x - mx) * (y - my)).sum() / var * (x[i] - mx) if var > accuracy else 0)
        rest = np.abs(y - fit)
        scale = 6 * np.median(rest)
        if it == iterations or scale < accuracy:
            break
        robust = np.where(rest < scale, (1 - (rest / scale) ** 2) ** 2, 0)
    return fit


def interpolate_loess(df: DataFrame, x: str, y: str, bandwidth: float = 0.75, iterations: int = 4, result: str | None = None, partition_by: Order = ()) -> DataFrame:
    """df with y smoothed over x. Rows of a group, or without partition_by of the table, come together in one task and have to fit there; rows with a null in either keep a null."""
    result = result or f"{y}-loess"
    schema = T.StructType([*df.schema.fields, T.StructField(result, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.to_numeric(pdf[x]).astype(float), pd.to_numeric(pdf[y]).astype(float)
        ok = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(pdf), np.nan)
        if ok.sum() > 1:
            out[ok] = loess(a[ok].to_numpy(), b[ok].to_numpy(), bandwidth, iterations)
        return pdf.assign(**{result: out})

    return df.groupBy(*([c(p) for p in names(partition_by)] or [F.lit("all")])).applyInPandas(run, schema)
