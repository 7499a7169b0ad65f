"""Accessors of tables, and their printed form."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.order import ROW_ID, Order, c, names, with_row_ids


def row_count(df: DataFrame) -> int:
    return df.count()


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def shape(df: DataFrame) -> list[int]:
    """[columns, rows]"""
    return [len(df.columns), df.count()]


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def rows(df: DataFrame, nil_missing: bool = True) -> Iterator[dict]:
    """Row dicts, a partition of them at a time; without nil_missing nulls have no entry."""
    for r in df.toLocalIterator():
        d = r.asDict()
        yield d if nil_missing else {k: v for k, v in d.items() if v is not None}


def rowvecs(df: DataFrame) -> Iterator[list]:
    return (list(r) for r in df.toLocalIterator())


def row_at(df: DataFrame, i: int, order: Order) -> dict | None:
    """The row of an id, from the end if negative."""
    if i < 0:
        got = df.orderBy(*[c(o).desc_nulls_last() for o in names(order)]).limit(-i).collect()
        return got[-1].asDict() if len(got) == -i else None
    got = with_row_ids(df, order).where(F.col(ROW_ID) == i).drop(ROW_ID).first()
    return got.asDict() if got else None


def rowvec_at(df: DataFrame, i: int, order: Order) -> list | None:
    got = row_at(df, i, order)
    return None if got is None else list(got.values())


def format_sequence(xs: Iterable, digits: int = 8, threshold: int = 1_000_000) -> list[str]:
    """Numbers with as many significant digits as tell them apart, and exponents where one is too long for plain digits."""
    xs = list(xs)
    real = [x for x in xs if isinstance(x, float) and math.isfinite(x)]
    wide = any(x and (abs(x) >= threshold * 10 or abs(x) < 1 / threshold) for x in real)
    texts = {x: f"{x:.{digits - 1}E}" if wide else f"{x:.{digits}g}" for x in real}
    places = max((len(t.partition(".")[2]) for t in texts.values() if "E" not in t and "e" not in t), default=0)
    out = []
    for x in xs:
        if x is None:
            out.append("")
        elif isinstance(x, float):
            out.append("NaN" if math.isnan(x) else "Infinity" if x == math.inf else "-Infinity" if x == -math.inf else texts[x] if wide else f"{x:.{places}f}")
        else:
            out.append(str(x))
    return out


def dataset_to_str(df: DataFrame, name: str = "_unnamed", n: int = 25, width: int = 60, types: bool = False, line_policy: str = "single") -> str:
    """A name and shape, then the first rows as a table of text: numbers to the right, cells cut at width."""
    got, total = df.limit(n).collect(), df.count()
    lines = [f"{name} [{total} {len(df.columns)}]:", ""]
    cols = []
    for i, f in enumerate(df.schema):
        cells = format_sequence(r[i] for r in got)
        if line_policy == "single":
            cells = [x.split("\n")[0] for x in cells]
        cells = [x if len(x) <= width else x[: width - 1] + "…" for x in cells]
        head = [f.name, *([f.dataType.simpleString()] if types else [])]
        size = max(map(len, head + cells), default=0)
        right = f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")
        cols.append(([x.rjust(size) if right else x.ljust(size) for x in head + cells], size, right))
    if not cols:
        return lines[0]
    depth = 1 + bool(types)
    for k in range(depth):
        lines.append("| " + " | ".join(x[0][k] for x in cols) + " |")
    lines.append("|" + "|".join("-" * (s + 1) + (":" if r else "-") for _, s, r in cols) + "|")
    for k in range(depth, depth + len(got)):
        lines.append("| " + " | ".join(x[0][k] for x in cols) + " |")
    return "\n".join(lines)


def print_all(df: DataFrame, name: str = "_unnamed") -> None:
    print(dataset_to_str(df, name, n=df.count()))
