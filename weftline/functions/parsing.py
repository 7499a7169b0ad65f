"""Parsing of text columns: the promotion of types by inference, and parsers for times and durations."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.order import c

#: Patterns of dates and times, tried in order. Fixed values.
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy-MM-d", "yyyy-M-d", "yyyy-MMM-d", "MM-dd-yyyy", "M-d-yyyy", "MMM-d-yyyy", "d-MMM-yyyy", "MMM d yyyy")
TIME_PATTERNS = ("HH:mm:ss.SSS", "HH:mm:ss", "HH:mm", "H:mm:ss", "H:mm", "hh:mm:ss a", "hh:mm a", "h:mm:ss a", "h:mm a", "HH:mm:ss:SSS")
#: Words for true and false where a column is declared boolean. Fixed values.
TRUE = ("t", "y", "yes", "true", "positive")
FALSE = ("f", "n", "no", "false", "negative")
#: Characters from which on text is a text column rather than strings. Fixed value.
TEXT_LENGTH = 1024
#: Rows that are held against all types first.
FIRST_ROWS = 200
#: Candidate types in the order of promotion.
LADDER = ("boolean", "smallint", "int", "bigint", "double", "uuid", "interval day to second", "date", "timestamp", "string")
#: Bits of the integer types.
INTEGERS = {"smallint": 16, "int": 32, "bigint": 64}
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INTEGER, REAL = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DURATION = r"^-?(P(?=.)(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?|\d+:\d{1,2}:\d{1,2}(:\d{1,3})?)$"


def present(x: Column, na: bool = True) -> Column:
    """The text, or null for what stands for a missing value: empty, or NA in any case."""
    blank = F.trim(x) == ""
    return F.when(~(blank | (F.lower(F.trim(x)) == "na") if na else blank), F.trim(x))


def parse_local_date(x: Column) -> Column:
    """A date by the first pattern that fits; / , . and blanks between parts count as dashes. Null if none does."""
    flat = F.regexp_replace(F.trim(x), r"[/,. -]+", "-")
    return F.coalesce(*[F.try_to_timestamp(flat, F.lit(p.replace(" ", "-"))).cast("date") for p in DATE_PATTERNS])


def parse_local_time(x: Column) -> Column:
    """Microseconds of the day by the first pattern that fits. Null if none does."""
    day = F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.upper(F.trim(x))), F.lit(f"yyyy-MM-dd {p}")) for p in TIME_PATTERNS])
    return F.unix_micros(day)


def parse_local_date_time(x: Column) -> Column:
    """ISO text, or a date and a time with a blank between them."""
    parts = F.regexp_extract(F.trim(x), r"^(\S+)[ T]+(.+)$", 1), F.regexp_extract(F.trim(x), r"^(\S+)[ T]+(.+)$", 2)
    mixed = F.timestamp_micros(F.unix_date(parse_local_date(parts[0])).cast("bigint") * 86_400_000_000 + parse_local_time(parts[1]))
    return F.coalesce(F.try_to_timestamp(x), mixed, parse_local_date(x).cast("timestamp")).cast("timestamp_ntz")


def parse_duration(x: Column) -> Column:
    """An interval from ISO 8601 (PnDTnHnMnS) or H:m:s:ms, with a sign before it or none. Null for other text."""
    t = F.trim(x)
    sign = F.when(t.startswith("-"), -1).otherwise(1)
    body = F.regexp_replace(t, "^[+-]", "")
    part = lambda rx, i=1: F.coalesce(F.regexp_extract(body, rx, i).try_cast("double"), F.lit(0.0))
    iso = part(r"(\d+)D") * 86400 + part(r"T.*?(\d+)H") * 3600 + part(r"T(?:\d+H)?(\d+)M") * 60 + part(r"(\d+(?:\.\d+)?)S")
    clock_rx = r"^(\d+):(\d{1,2}):(\d{1,2})(?::(\d{1,3}))?$"
    clock = part(clock_rx, 1) * 3600 + part(clock_rx, 2) * 60 + part(clock_rx, 3) + part(clock_rx, 4) / 1000
    seconds = F.when(body.startswith("P"), iso).otherwise(clock) * sign
    return F.when(t.rlike(DURATION), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))


def parse_boolean(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def parser(kind: str, fmt: str | None = None) -> Callable[[Column], Column]:
    """The parser of a declared type; null for what it can't parse. fmt: a pattern for dates and times."""
    if fmt is not None:
        return lambda x: F.try_to_timestamp(x, F.lit(fmt)).cast(kind)
    special = {"boolean": parse_boolean, "date": parse_local_date, "time": parse_local_time, "timestamp_ntz": parse_local_date_time, "duration": parse_duration, "interval day to second": parse_duration, "string": lambda x: x, "text": lambda x: x, "uuid": lambda x: F.when(x.rlike(UUID), F.lower(x))}
    return special.get(kind, lambda x: F.trim(x).try_cast(kind))


def _fits(kind: str, x: Column) -> Column:
    """Whether inference takes a text for a value of the type."""
    if kind == "boolean":
        return x.isin("true", "false")
    if kind in ("smallint", "int", "bigint"):
        return x.rlike(INTEGER) & x.try_cast(kind).isNotNull()
    if kind == "double":
        return x.rlike(REAL) | F.lower(x).isin("nan", "inf", "-inf", "infinity", "-infinity")
    if kind == "uuid":
        return x.rlike(UUID)
    if kind == "interval day to second":
        return x.rlike(DURATION)
    if kind == "date":
        return x.rlike(r"\d") & ~x.contains(":") & ~x.rlike(REAL) & parse_local_date(x).isNotNull()
    if kind == "timestamp":
        return x.rlike(r"\d{2}:\d{2}") & F.try_to_timestamp(x).isNotNull()
    return F.lit(True)


def infer(df: DataFrame, columns: list[str] | None = None, na: bool = True) -> dict[str, str]:
    """The narrowest type on the ladder that all values of each text column fit. A column of nulls only is boolean; one with a long text is 'text'.

    Types that the first rows rule out are not tried on the others; all rows are held against those left, in one pass.
    """
    cols = columns or df.columns
    first = [(i, v) for r in df.select(*[c(x) for x in cols]).take(FIRST_ROWS) for i, v in enumerate(r)]
    rows = df.sparkSession.createDataFrame(first, "i int, v string").select("i", present(F.col("v"), na).alias("v"))
    held = {r["i"]: r for r in rows.groupBy("i").agg(*[F.count_if(F.col("v").isNotNull() & ~_fits(k, F.col("v"))).alias(k) for k in LADDER[:-1]]).collect()}
    kinds = {i: [k for k in LADDER[:-1] if i not in held or held[i][k] == 0] for i in range(len(cols))}
    whole = {i: list(INTEGERS) for i in kinds if set(INTEGERS) & set(kinds[i])}
    given = df.select(*[present(c(x), na).alias(f"v{i}") for i, x in enumerate(cols)], *[F.length(c(x)).alias(f"l{i}") for i, x in enumerate(cols)])
    # an integer is read once, and its size tells the types that it fits; it needs no other try for a double
    given = given.withColumns({f"n{i}": F.when(F.col(f"v{i}").rlike(INTEGER), F.col(f"v{i}").try_cast("bigint")) for i in whole})

    def misses(i: int, kind: str) -> Column:
        v, n = F.col(f"v{i}"), F.col(f"n{i}")
        if kind in INTEGERS:
            most = 1 << INTEGERS[kind] - 1
            return v.isNotNull() & (n.isNull() | ~n.between(-most, most - 1))
        return v.isNotNull() & (n.isNull() if i in whole and kind == "double" else F.lit(True)) & ~_fits(kind, v)

    got = given.agg(*[F.count_if(misses(i, k)).alias(f"{i}_{k}") for i in kinds for k in kinds[i]], *[F.max(f"l{i}").alias(f"{i}_length") for i in kinds]).first()
    out = {}
    for i, x in enumerate(cols):
        kind = next((k for k in kinds[i] if got[f"{i}_{k}"] == 0), "string")
        out[x] = "text" if kind == "string" and (got[f"{i}_length"] or 0) >= TEXT_LENGTH else kind
    return out


def parsed(df: DataFrame, kinds: Mapping[str, str | tuple[str, str]], na: bool = True, errors: bool = False) -> DataFrame:
    """Text columns as the types given, pairs being a type and a pattern. What doesn't fit is null, and with errors kept in <column>-unparsed."""
    made = {}
    for x, kind in kinds.items():
        kind, fmt = (kind, None) if isinstance(kind, str) else kind
        raw = present(c(x), na)
        made[x] = parser("bigint" if kind == "packed" else kind, fmt)(raw)
        if errors:
            made[f"{x}-unparsed"] = F.when(raw.isNotNull() & made[x].isNull(), raw)
    out = df.withColumns(made)
    for x, kind in kinds.items():
        if kind in ("text", "uuid"):
            out = out.withMetadata(x, {"datatype": kind})
    return out


def parse_column(df: DataFrame, column: str, kind: str | tuple[str, str], relaxed: bool = False) -> DataFrame:
    """One text column parsed. Strict parsing raises on what doesn't fit; relaxed makes it null and keeps it beside."""
    if relaxed:
        return parsed(df, {column: kind}, errors=True)
    out = parsed(df, {column: kind}, errors=True)
    bad = c(f"{column}-unparsed")
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit(f"can't parse {column}: "), bad)).cast(out.schema[column].dataType)).otherwise(c(column))
    return out.withColumn(column, checked).drop(f"{column}-unparsed")
