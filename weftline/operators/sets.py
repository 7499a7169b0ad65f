"""Set operations on whole rows with multiplicity, and concatenation. Null is a value like others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.order import c


def _counts(dfs: Sequence[DataFrame]) -> tuple[DataFrame, list[str]]:
    """Each distinct row of all tables with how often each has it."""
    cols = dfs[0].columns
    hidden = [f"__n{i}" for i in range(len(dfs))]
    rows = [d.select(*[c(x) for x in cols], *[F.lit(int(i == j)).alias(h) for j, h in enumerate(hidden)]) for i, d in enumerate(dfs)]
    both = reduce(DataFrame.unionByName, rows)
    return both.groupBy(*[c(x) for x in cols]).agg(*[F.sum(h).alias(h) for h in hidden]), hidden


def _reduced(dfs: Sequence[DataFrame], times: Callable[..., Column], count: str | None) -> DataFrame:
    counted, hidden = _counts(dfs)
    n = times(*[F.col(h) for h in hidden])
    cols = [c(x) for x in dfs[0].columns]
    if count:
        return counted.select(*cols, n.alias(count)).where(c(count) > 0)
    return counted.withColumn("__n", n).where("__n > 0").select(*cols, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__k")).select(*cols)


def reduce_union(dfs: Sequence[DataFrame], count: str | None = None, multiplicity: str = "max") -> DataFrame:
    """Rows of any table, as often as in that which has most of them; or, with multiplicity 'min', for rows of several as often as in that which has fewest. With count, once and with that number."""
    if len(dfs) == 1 and count is None:
        return dfs[0]
    if multiplicity == "min":
        return _reduced(dfs, lambda *n: F.least(*[F.nullif(x, F.lit(0)) for x in n]) if len(n) > 1 else n[0], count)
    return _reduced(dfs, lambda *n: F.greatest(*n) if len(n) > 1 else n[0], count)


def union(*dfs: DataFrame, multiplicity: str = "max") -> DataFrame:
    return reduce_union(dfs, None, multiplicity)


def reduce_intersection(dfs: Sequence[DataFrame], count: str | None = None) -> DataFrame:
    """Rows of all tables, as often as in that which has fewest of them."""
    if count is None:
        return reduce(lambda a, b: a.intersectAll(b.select(*[c(x) for x in a.columns])), dfs)
    return _reduced(dfs, lambda *n: F.least(*n) if len(n) > 1 else n[0], count)


def intersection(*dfs: DataFrame) -> DataFrame:
    return reduce_intersection(dfs)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b hasn't at all; repeats in a stay."""
    hidden = b.select(*[c(x).alias(f"__r{i}") for i, x in enumerate(a.columns)]).distinct()
    on = reduce(lambda p, q: p & q, [a[f"`{x}`"].eqNullSafe(hidden[f"__r{i}"]) for i, x in enumerate(a.columns)])
    return a.join(hidden, on, "left_anti")


def concat(*dfs: DataFrame | None) -> DataFrame:
    """Rows of all tables; a column that one hasn't is null there, and types widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d for d in dfs if d is not None])


concat_copying = concat_inplace = concat
