"""Row order without a window over all rows in one task.

An ordered table is cut into blocks at literal boundaries taken from a sample. Window functions run inside blocks; what a
row needs from other blocks is a number or a value a block, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about, and blocks at most; beyond that (3 * 10^10 rows) blocks grow and their sorts spill.
BLOCK_ROWS, MAX_BLOCKS = 2_000_000, 16_384
#: Cuts up to which a number is found by a tree of comparisons rather than by two rows of them.
TREE = 255
BLOCK, ROW_ID = "__block", "__row_id"

Order = str | Sequence[str]


def names(cols: Order) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def c(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name}`")


def in_blocks(df: DataFrame, order: Order, block_rows: int | None = None) -> DataFrame:
    """df with a block number that grows with order; nulls come first."""
    order, size = names(order), block_rows or BLOCK_ROWS
    count = df.count()
    n = min(MAX_BLOCKS, -(-count // size))
    if n < 2:
        return df.withColumn(BLOCK, F.lit(0))
    each = 100 if n <= 256 else 25
    picked = df.select(*[c(o).alias(f"k{i}") for i, o in enumerate(order)]).sample(min(1.0, each * n / count), seed=7).sort(*[f"k{i}" for i in range(len(order))]).collect()
    cuts = sorted({i * len(picked) // n for i in range(1, n)} - {0})
    kinds = [df.schema[o].dataType for o in order]
    key = F.struct(*[c(o).alias(f"k{i}") for i, o in enumerate(order)])
    bounds = [F.struct(*[F.lit(v).cast(k).alias(f"k{j}") for j, (v, k) in enumerate(zip(picked[i], kinds))]) for i in cuts]
    return df.withColumn(BLOCK, cut_number(key, bounds))


def cut_number(x: Column, cuts: Sequence[Column]) -> Column:
    """How many of the cuts, which ascend, are at or below x."""
    if len(cuts) > TREE:
        step = isqrt(len(cuts))
        rows = [F.array(*cuts[i : i + step]) for i in range(0, len(cuts), step)]
        row = F.size(F.filter(F.array(*cuts[::step]), lambda v: v <= x))
        inside = F.size(F.filter(F.element_at(F.array(*rows), F.greatest(row, F.lit(1))), lambda v: v <= x))
        return F.when(row == 0, 0).otherwise((row - 1) * step + inside)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def with_row_ids(df: DataFrame, order: Order, name: str = ROW_ID, block_rows: int | None = None) -> DataFrame:
    """df with ids 0, 1, ... in the order given: a number inside the block plus what the blocks before it hold."""
    order = names(order)
    cut = in_blocks(df, order, block_rows)
    sizes = {r[0]: r[1] for r in cut.groupBy(BLOCK).count().collect()}
    before, total = [], 0
    for b in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(b, 0)
    inside = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*[c(o) for o in order])) - 1
    return cut.withColumn(name, inside.cast("bigint") + F.element_at(F.array(*[F.lit(x).cast("bigint") for x in before]), F.col(BLOCK) + 1)).drop(BLOCK)


def carry(df: DataFrame, order: Order, fills: dict[str, Column], forward: bool = True, strict: bool = False, partition_by: Order = ()) -> DataFrame:
    """df with columns that hold the last value that isn't null at or before each row (after it, if not forward; without the row itself, if strict).

    With partition_by the window runs inside its groups. Without, it runs inside blocks, and a block's first rows take
    what the blocks before them end with. Going back, rows go by their number in the order, so that ties stand as they do going forward.
    """
    order = names(order)
    keys = [c(o).asc_nulls_first() for o in order]
    span = (Window.unboundedPreceding, -1 if strict else 0)
    given = df.withColumns({f"__v_{k}": v for k, v in fills.items()})

    def window(rows: DataFrame, *parts: Column) -> tuple[DataFrame, Window]:
        over = Window.partitionBy(*parts)
        if not forward:
            rows = rows.withColumn("__row_at", F.row_number().over(over.orderBy(*keys)))
        return rows, over.orderBy(*(keys if forward else [F.col("__row_at").desc()])).rowsBetween(*span)

    if names(partition_by):
        given, w = window(given, *[c(p) for p in names(partition_by)])
        return given.withColumns({k: F.last(f"__v_{k}", True).over(w) for k in fills}).drop("__row_at", *[f"__v_{k}" for k in fills])
    cut, w = window(in_blocks(given, order), F.col(BLOCK))
    at = F.struct(*[c(o).alias(f"k{i}") for i, o in enumerate(order)])
    pick = F.max_by if forward else F.min_by
    ends = cut.groupBy(BLOCK).agg(*[pick(F.when(F.col(f"__v_{k}").isNotNull(), F.struct(F.col(f"__v_{k}").alias("v"))), F.when(F.col(f"__v_{k}").isNotNull(), at)).alias(f"__e_{k}") for k in fills])
    between = Window.orderBy(F.col(BLOCK) if forward else F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(BLOCK).alias("__b"), *[F.last(f"__e_{k}", True).over(between).alias(f"__e_{k}") for k in fills])
    out = cut.withColumns({f"__i_{k}": F.last(f"__v_{k}", True).over(w) for k in fills}).join(F.broadcast(ends), F.col(BLOCK) == F.col("__b"), "left")
    out = out.withColumns({k: F.coalesce(f"__i_{k}", F.col(f"__e_{k}.v")) for k in fills})
    return out.drop(BLOCK, "__b", "__row_at", *[f"{p}{k}" for p in ("__v_", "__i_", "__e_") for k in fills])
