"""Joins. Keys match null with null. Which side is broadcast, or how a join is carried out, is left to the planner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.order import Order, c, carry, names


def _free(name: str, taken: set[str], prefix: str) -> str:
    """A name for a column of the second side that isn't taken: itself, with the side's name before it, or with a number after that."""
    out, n = name, 0
    while out in taken:
        out = f"{prefix}.{name}" if n == 0 else f"{prefix}.{name}-{n}"
        n += 1
    return out


def _keys(key) -> tuple[list[str], list[str]]:
    """One name, a pair of (left, right) names or lists of them, or a list of names that both have."""
    if isinstance(key, str):
        return [key], [key]
    if isinstance(key, tuple):
        return names(key[0]), names(key[1])
    return list(key), list(key)


def _renamed(df: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    hidden = {x: f"__{prefix}_{i}" for i, x in enumerate(df.columns)}
    return df.select(*[c(x).alias(h) for x, h in hidden.items()]), hidden


def _on(lk: list[str], rk: list[str], lh: dict[str, str], rh: dict[str, str]) -> Column:
    out = None
    for a, b in zip(lk, rk, strict=True):
        x = F.col(lh[a]).eqNullSafe(F.col(rh[b]))
        out = x if out is None else out & x
    return out


def _join(key, lhs: DataFrame, rhs: DataFrame, how: str, drop_right_key: bool, left_name: str, right_name: str) -> DataFrame:
    lk, rk = _keys(key)
    left, lh = _renamed(lhs, "l")
    right, rh = _renamed(rhs, "r")
    out = left.join(right, _on(lk, rk, lh, rh), how)
    taken, cols = set(), []
    for df, hidden, name, keys in ((lhs, lh, left_name, lk), (rhs, rh, right_name, rk)):
        for x in df.columns:
            if drop_right_key and hidden is rh and x in keys:
                continue
            new = _free(x, taken, name)
            taken.add(new)
            cols.append(F.col(hidden[x]).alias(new))
    return out.select(*cols)


def inner_join(key, lhs: DataFrame, rhs: DataFrame, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """The right key goes."""
    return _join(key, lhs, rhs, "inner", True, left_name, right_name)


def left_join(key, lhs: DataFrame, rhs: DataFrame, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """The right key stays, under the right side's name, and is null where nothing matched."""
    return _join(key, lhs, rhs, "left", False, left_name, right_name)


def right_join(key, lhs: DataFrame, rhs: DataFrame, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """The left key stays and is null where nothing matched."""
    return _join(key, lhs, rhs, "right", False, left_name, right_name)


def hash_join(key, lhs: DataFrame, rhs: DataFrame, lhs_missing: bool = False, rhs_missing: bool = False, left_name: str = "left", right_name: str = "right") -> dict[str, DataFrame]:
    """inner, and as asked left-outer and right-outer."""
    out = {"inner": inner_join(key, lhs, rhs, left_name, right_name)}
    if lhs_missing:
        out["left-outer"] = left_join(key, lhs, rhs, left_name, right_name)
    if rhs_missing:
        out["right-outer"] = right_join(key, lhs, rhs, left_name, right_name)
    return out


def pd_merge(lhs: DataFrame, rhs: DataFrame, how: str = "inner", on: Order | None = None, left_on: Order | None = None, right_on: Order | None = None, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Join on several keys: inner, left, right, outer or cross. Keys of the same name are one column; without keys, the names that both have."""
    if how == "cross":
        left, lh = _renamed(lhs, "l")
        right, rh = _renamed(rhs, "r")
        taken = set(lhs.columns)
        cols = [F.col(lh[x]).alias(x) for x in lhs.columns]
        for x in rhs.columns:
            new = _free(x, taken, right_name)
            taken.add(new)
            cols.append(F.col(rh[x]).alias(new))
        return left.crossJoin(right).select(*cols)
    if on is not None:
        lk = rk = names(on)
    elif left_on is not None:
        lk, rk = names(left_on), names(right_on)
    else:
        lk = rk = [x for x in lhs.columns if x in rhs.columns]
    if not lk or len(lk) != len(rk):
        raise ValueError("no keys to merge on, or not as many on either side")
    shared = {a for a, b in zip(lk, rk) if a == b}
    left, lh = _renamed(lhs, "l")
    right, rh = _renamed(rhs, "r")
    out = left.join(right, _on(lk, rk, lh, rh), {"outer": "full"}.get(how, how))
    one = {"inner": lambda x: F.col(lh[x]), "left": lambda x: F.col(lh[x]), "right": lambda x: F.col(rh[x]), "outer": lambda x: F.coalesce(F.col(lh[x]), F.col(rh[x]))}[how]
    sides = [(lhs, lh, left_name), (rhs, rh, right_name)]
    if how == "right":
        sides.reverse()
    taken, cols = set(), []
    for df, hidden, side in sides:
        for x in df.columns:
            if x in shared:
                if x not in taken:
                    taken.add(x)
                    cols.append(one(x).alias(x))
                continue
            new = _free(x, taken, side)
            taken.add(new)
            cols.append(F.col(hidden[x]).alias(new))
    return out.select(*cols)


def semi_join(key, lhs: DataFrame, rhs: DataFrame, anti: bool = False) -> DataFrame:
    """Left rows with a match, or without one."""
    lk, rk = _keys(key)
    left, lh = _renamed(lhs, "l")
    right, rh = _renamed(rhs.select(*[c(k) for k in dict.fromkeys(rk)]), "r")
    return left.join(right, _on(lk, rk, lh, rh), "left_anti" if anti else "left_semi").select(*[F.col(lh[x]).alias(x) for x in lhs.columns])


ASOF = {"<": ("forward", True), "<=": ("forward", False), ">": ("backward", True), ">=": ("backward", False)}


def left_join_asof(on: str | tuple[str, str], lhs: DataFrame, rhs: DataFrame, asof_op: str = "<=", partition_by: Order = (), tie: Sequence[str] = (), right_name: str = "right") -> DataFrame:
    """Each left row with one right row: by left < right the next one after it, by <= the next at or after it, by > and >= the last before it, by nearest the closer of the two.

    Of equal right times, going forward the first counts and going backward the last, in the order of tie; of two equally
    near ones the later. Null times match nothing; left rows all stay. Both sides are laid on one line and the right
    rows carried along it, so that the work is a sort, whatever the times.
    """
    lk, rk = (on, on) if isinstance(on, str) else on
    parts = names(partition_by)
    taken, cols = set(lhs.columns), []
    for x in rhs.columns:
        if x in parts:
            continue
        new = _free(x, taken, right_name)
        taken.add(new)
        cols.append((x, new))
    ride = F.struct(*[c(x).alias(f"r{i}") for i, (x, _) in enumerate(cols)])
    row = F.struct(*[c(x) for x in lhs.columns])
    kind = rhs.select(ride.alias("s")).schema["s"].dataType.simpleString()
    own = lhs.select(row.alias("s")).schema["s"].dataType.simpleString()
    ties = [c(x).alias(f"__t{i}") for i, x in enumerate(tie)]
    no_ties = [F.lit(None).cast(rhs.schema[x].dataType).alias(f"__t{i}") for i, x in enumerate(tie)]
    groups = [c(x).alias(f"__p{i}") for i, x in enumerate(parts)]

    def line(side_of_left: int) -> DataFrame:
        left = lhs.where(c(lk).isNotNull()).select(*groups, c(lk).alias("__at"), F.lit(side_of_left).alias("__side"), *no_ties, row.alias("__row"), F.lit(None).cast(kind).alias("__ride"))
        right = rhs.where(c(rk).isNotNull()).select(*groups, c(rk).alias("__at"), F.lit(1).alias("__side"), *ties, F.lit(None).cast(own).alias("__row"), ride.alias("__ride"))
        return left.unionByName(right)

    order = ["__at", "__side", *[f"__t{i}" for i in range(len(tie))]]
    by = [f"__p{i}" for i in range(len(parts))]

    if asof_op == "nearest":
        both = carry(line(2), order, {"__prev": F.col("__ride")}, True, False, by)
        both = carry(both, order, {"__next": F.col("__ride")}, False, False, by).where("__row is not null")
        key = f"r{[x for x, _ in cols].index(rk)}"
        at = rhs.schema[rk].dataType
        d = lambda a, b: _number(at, F.col(a)) - _number(at, F.col(b))
        closer = F.col("__next").isNotNull() & (F.col("__prev").isNull() | (d(f"__next.{key}", "__at") <= d("__at", f"__prev.{key}")))
        out = both.withColumn("__got", F.when(closer, F.col("__next")).otherwise(F.col("__prev")))
    else:
        direction, strict = ASOF[asof_op]
        # left rows stand before the right rows of their time or after them, so that these count or don't
        side = (2 if strict else 0) if direction == "forward" else (0 if strict else 2)
        out = carry(line(side), order, {"__got": F.col("__ride")}, direction == "backward", False, by).where("__row is not null")
    made = out.select(*[F.col("__row")[x].alias(x) for x in lhs.columns], *[F.col("__got")[f"r{i}"].alias(new) for i, (_, new) in enumerate(cols)])
    lost = lhs.where(c(lk).isNull())
    return made.unionByName(lost, allowMissingColumns=True)


def _number(kind: T.DataType, x: Column) -> Column:
    """What distances are taken of: microseconds of times, days of dates, and numbers."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(x.cast("timestamp"))
    return F.unix_date(x) if isinstance(kind, T.DateType) else x


def range_join(lhs: DataFrame, rhs: DataFrame, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs in which a left number lies in a right interval [lo, hi]: intervals are cut into cells of width, which join by equality. Choose width near the usual interval."""
    cells = rhs.withColumn("__cell", F.explode(F.sequence(F.floor(c(lo) / width), F.floor(c(hi) / width))))
    return lhs.withColumn("__cell", F.floor(c(at) / width)).join(cells, "__cell").where((c(at) >= c(lo)) & (c(at) <= c(hi))).drop("__cell")
