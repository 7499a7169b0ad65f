"""Scalar functions over columns. Each is a built-in expression, so that it stays in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "negate": lambda x: -x, "sq": lambda x: x * x, "cube": lambda x: x * x * x, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log1p": F.log1p,
    "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "round": F.round, "signum": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "to-degrees": F.degrees, "to-radians": F.radians, "logistic": lambda x: 1 / (1 + F.exp(-x)), "not": lambda x: ~x, "bit-not": F.bitwise_not,
    "nan?": F.isnan, "finite?": lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")), "infinite?": lambda x: F.abs(x) == float("inf"), "even?": lambda x: x % 2 == 0, "odd?": lambda x: x % 2 != 0, "pos?": lambda x: x > 0, "neg?": lambda x: x < 0, "zero?": lambda x: x == 0,
    "upper": F.upper, "lower": F.lower, "trim": F.trim, "length": F.length, "years": F.year, "months": F.month, "days": F.dayofmonth, "hours": F.hour, "minutes": F.minute, "day-of-week": F.dayofweek, "day-of-year": F.dayofyear, "week-of-year": F.weekofyear,
    "datetime->milliseconds": F.unix_millis, "milliseconds->datetime": F.timestamp_millis,
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "rem": lambda a, b: F.try_mod(a, b), "quot": lambda a, b: (a - F.try_mod(a, b)) / b, "pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "min": F.least, "max": F.greatest,
    "eq": lambda a, b: a.eqNullSafe(b), "not-eq": lambda a, b: ~a.eqNullSafe(b), "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    "bit-and": lambda a, b: a.bitwiseAND(b), "bit-or": lambda a, b: a.bitwiseOR(b), "bit-xor": lambda a, b: a.bitwiseXOR(b), "plus-days": F.date_add, "minus-days": F.date_sub, "plus-months": F.add_months, "between-days": lambda a, b: F.datediff(b, a),
}
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "reduce-+": F.sum, "reduce-*": F.product, "variance": F.var_samp, "standard-deviation": F.stddev_samp, "skew": F.skewness, "kurtosis": F.kurtosis, "median": F.median, "n-elems": lambda x: F.count(F.lit(1)),
}


def call(name: str, *args) -> Column:
    """A function by name: of one column, or, folded from the left, of two or more."""
    args = [a if isinstance(a, Column) else F.lit(a) for a in args]
    if len(args) == 1:
        return (UNARY | {"-": UNARY["negate"]})[name](args[0])
    out = args[0]
    for a in args[1:]:
        out = BINARY[name](out, a)
    return out
