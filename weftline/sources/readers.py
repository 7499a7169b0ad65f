"""Reading tables from files by their type."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.parsing import infer, parsed
from weftline.plans.order import c

#: Endings that say how a file is packed.
PACKED = (".gz", ".bz2", ".zst", ".snappy")
#: Characters of a field and columns of a file at most. Fixed values.
MAX_CHARS, MAX_COLUMNS = 65536, 8192


def file_type(path: str) -> str:
    name = path.rstrip("/").lower()
    for end in PACKED:
        name = name.removesuffix(end)
    return name.rpartition(".")[2]


def unique_names(raw: Iterable[str | None]) -> list[str]:
    """Names of a header: empty ones are column-<place>, and a repeated one gets a number."""
    out: list[str] = []
    for i, x in enumerate(raw):
        name = (x or "").strip().lstrip("﻿") or f"column-{i}"
        base, n = name, 1
        while name in out:
            name, n = f"{base}-{n}", n + 1
        out.append(name)
    return out


def _data_lines(spark: SparkSession, path: str, skip_rows: int, header: bool, comment: str | None) -> DataFrame:
    """value: the lines of all files but blank ones, comments, and of each file the first skip_rows and the header. Only a file's first split is numbered."""
    there = (F.trim("value") != "") & (~F.startswith("value", F.lit(comment)) if comment else F.lit(True))
    text = spark.read.text(path)
    if not skip_rows and not header:
        return text.where(there)
    text = text.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__i"))
    w = Window.partitionBy("__file").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    head = text.where("__from = 0").withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") > skip_rows).where(there)
    if header:
        head = head.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n > 1")
    return head.select("value").unionByName(text.where("__from > 0").where(there).select("value"))


def _count(value: Column, sep: str) -> Column:
    """Fields of a line: separators outside quotes, and one more."""
    bare = F.when(F.contains(value, F.lit('"')), F.regexp_replace(value, '"(?:[^"]|"")*"', "")).otherwise(value)
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _fields(lines: DataFrame, sep: str) -> int:
    """Fields of the line that has most."""
    return lines.agg(F.max(_count(F.col("value"), sep))).first()[0] or 0


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, parser: Mapping | str | None = None, columns: Iterable[str] | None = None, block: Iterable[str] = (), n_rows: int | None = None, skip_rows: int = 0, comment: str | None = "#", bad_rows: str = "PERMISSIVE", na: bool = True, multi_line: bool = False, key_fn: Callable[[str], str] | None = None) -> DataFrame:
    """Text by separator, types by inference where parser has none. A first pass takes the header and the separator from the first lines, a second the number of columns of all rows, a third the types; only then are rows parsed.

    parser: a type for all columns, or types, (type, pattern) pairs by column. bad_rows: PERMISSIVE, DROPMALFORMED or FAILFAST.
    skip_rows and the header count in each file. Columns beyond the header's are named by their place. With multi_line, where a
    line need not be a row, the first lines settle the columns and skip_rows is an error.
    """
    if multi_line and skip_rows:
        raise ValueError("skip_rows counts lines, which rows of multi_line are not")
    lines = [r.value for r in spark.read.text(path).limit(skip_rows + 50).collect()]
    lines = [x for x in lines[skip_rows:] if x.strip() and not (comment and x.startswith(comment))]
    if not lines:
        return spark.createDataFrame([], T.StructType())
    sep = sep or max(",\t;|", key=lambda s: (lines[0].count(s), s == ","))
    import csv

    first = next(csv.reader([lines[0]], delimiter=sep))
    options = {"sep": sep, "header": "false", "mode": bad_rows, "maxColumns": str(MAX_COLUMNS), "maxCharsPerColumn": str(MAX_CHARS), "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"'}
    if multi_line:
        width = max([len(first), *(len(r) for r in csv.reader(lines[: 1 if header else None], delimiter=sep))])
    else:
        # where no line, headers included, has more fields than the first, the reader itself leaves out each file's header
        plain = header and not skip_rows and bad_rows == "PERMISSIVE" and len(comment or "") < 2 and _fields(_data_lines(spark, path, 0, False, comment), sep) <= len(first)
        if plain:
            width = len(first)
        else:
            text = _data_lines(spark, path, skip_rows, header, comment)
            width = max(len(first), _fields(text, sep))
    labels = unique_names([*first, *[None] * (width - len(first))]) if header else [f"column-{i}" for i in range(width)]
    schema = T.StructType([T.StructField(x, T.StringType()) for x in labels])
    if multi_line or plain:
        reader = spark.read.schema(schema).options(**options | {"header": str(header).lower(), "multiLine": str(multi_line).lower()})
        rows = (reader.option("comment", comment) if comment else reader).csv(path)
    else:
        rows = text.select(F.from_csv("value", ", ".join(f"`{x.replace('`', '``')}` string" for x in labels), {k: v for k, v in options.items() if k not in ("header", "mode")} | {"mode": "PERMISSIVE" if bad_rows == "DROPMALFORMED" else bad_rows}).alias("r"), "value")
        if bad_rows == "DROPMALFORMED":
            rows = rows.where(_count(F.col("value"), sep) == width)
        rows = rows.select("r.*")
    keep = [x for x in (columns or labels) if x in labels and x not in set(block)]
    rows = rows.select(*[c(x) for x in keep])
    if n_rows is not None:
        rows = rows.limit(n_rows)
    kinds = {x: parser for x in keep} if isinstance(parser, str) else dict(parser or {})
    left = [x for x in keep if x not in kinds]
    kinds |= infer(rows, left, na) if left else {}
    out = parsed(rows, {x: kinds[x] for x in keep}, na)
    return out.toDF(*[key_fn(x) for x in out.columns]) if key_fn else out


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.json(path, multiLine=not lines)


def read_arrow(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """Arrow files, streams and feather; workers read the record batches, and the driver only the first file's schema."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("content")

    def tables(blob: bytes):
        try:
            return pa.ipc.open_file(io.BytesIO(blob))
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(io.BytesIO(blob))

    def batches_of(blob: bytes):
        r = tables(blob)
        return (r.get_batch(i) for i in range(r.num_record_batches)) if hasattr(r, "num_record_batches") else iter(r)

    if schema is None:
        first = files.limit(1).collect()
        if not first:
            raise FileNotFoundError(str(paths))
        plain = pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in tables(bytes(first[0].content)).schema])
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(plain)

    def run(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                for x in batches_of(blob):
                    cols = [a.dictionary_decode() if pa.types.is_dictionary(a.type) else a for a in x.columns]
                    yield pa.RecordBatch.from_arrays(cols, x.schema.names)

    return files.mapInArrow(run, schema)


def read_zip(spark: SparkSession, path: str, schema: str, parse: Callable[[str, bytes], pd.DataFrame] | None = None) -> DataFrame:
    """Entries of zip files as one table; parse makes a table of an entry, CSV if not given."""
    parse = parse or (lambda name, data: pd.read_csv(io.BytesIO(data), sep="\t" if name.endswith(".tsv") else ","))
    columns = T._parse_datatype_string(schema).names

    def run(batches):
        for b in batches:
            for blob in b["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in z.namelist():
                        yield parse(name, z.read(name))[columns]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_excel(spark: SparkSession, path: str, sheet=None) -> dict[str, DataFrame]:
    """A table for each sheet, if a reader for such files is installed. Whole doubles become integers."""
    try:
        sheets = pd.read_excel(path, sheet_name=sheet)
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl or xlrd") from e
    sheets = sheets if isinstance(sheets, dict) else {str(sheet): sheets}
    return {k: spark.createDataFrame(v.convert_dtypes(convert_string=False)) for k, v in sheets.items()}


def parquet_metadata(path: str) -> list[dict]:
    """Row groups of a Parquet file: rows, bytes, and each column's statistics."""
    from pyarrow import parquet

    meta = parquet.ParquetFile(path).metadata
    out = []
    for i in range(meta.num_row_groups):
        g = meta.row_group(i)
        cols = []
        for j in range(g.num_columns):
            s, x = g.column(j).statistics, g.column(j)
            cols.append({"name": x.path_in_schema, "compression": x.compression, "bytes": x.total_compressed_size, "min": s.min if s and s.has_min_max else None, "max": s.max if s and s.has_min_max else None, "nulls": s.null_count if s else None})
        out.append({"rows": g.num_rows, "bytes": g.total_byte_size, "columns": cols})
    return out


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, and lists as rows; single values stand on the first row of their list only."""
    while True:
        structs = [f.name for f in df.schema if isinstance(f.dataType, T.StructType)]
        if structs:
            df = df.select(*[c(f.name)[s.name].alias(f"{f.name}.{s.name}") if s is not None else c(f.name) for f in df.schema for s in (f.dataType if f.name in structs else [None])])
            continue
        lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        if not lists:
            return df
        joined = F.arrays_zip(*[c(x).alias(f"a{i}") for i, x in enumerate(lists)])
        rows = df.select(*[c(x) for x in df.columns if x not in lists], F.posexplode_outer(joined).alias("__pos", "__z"))
        first = F.coalesce(F.col("__pos"), F.lit(0)) == 0
        df = rows.select(*[F.col("__z")[f"a{lists.index(x)}"].alias(x) if x in lists else F.when(first, c(x)).alias(x) for x in df.columns])


def from_columns(spark: SparkSession, columns: Mapping[str, object]) -> DataFrame:
    """A table of columns: single values go to all rows, shorter columns end in nulls."""
    lists = {k: list(v) for k, v in columns.items() if isinstance(v, (list, tuple, range, pd.Series)) or hasattr(v, "__array__")}
    n = max(map(len, lists.values()), default=1 if columns else 0)
    full = {k: (lists[k] + [None] * (n - len(lists[k])) if k in lists else [v] * n) for k, v in columns.items()}
    return spark.createDataFrame(pa.table({k: pa.array([x.item() if hasattr(x, "item") else x for x in v]) for k, v in full.items()})) if columns else spark.createDataFrame([], T.StructType())


def from_maps(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """A table of dicts; a name that a row hasn't is null there, and whole numbers and others are doubles together."""
    rows = list(rows)
    cols = {k: [r.get(k) for r in rows] for k in dict.fromkeys(k for r in rows for k in r)}
    for k, v in cols.items():
        kinds = {type(x) for x in v if x is not None}
        if kinds == {int, float}:
            cols[k] = [None if x is None else float(x) for x in v]
        elif len(kinds) > 1:
            cols[k] = [None if x is None else str(x) for x in v]
    return from_columns(spark, cols)


def read_dataset(spark: SparkSession, src, file_type_: str | None = None, **options) -> DataFrame:
    """A table from a path, by its ending, from columns, from dicts, or from another table."""
    if isinstance(src, DataFrame):
        return src
    if isinstance(src, pd.DataFrame) or isinstance(src, pa.Table):
        return spark.createDataFrame(src)
    if isinstance(src, Mapping):
        return from_columns(spark, src)
    if not isinstance(src, str):
        return from_maps(spark, src)
    kind = file_type_ or file_type(src)
    if kind in ("csv", "txt"):
        return read_csv(spark, src, **options)
    if kind == "tsv":
        return read_csv(spark, src, "\t", **options)
    if kind in ("parquet", "nippy"):
        out = spark.read.parquet(src)
    elif kind in ("json", "jsonl", "ndjson", "transit-json"):
        out = read_json(spark, src, lines=kind != "json")
    elif kind in ("arrow", "arrows", "feather", "ipc"):
        out = read_arrow(spark, src)
    elif kind in ("libsvm", "svm"):
        out = spark.read.format("libsvm").load(src)
    elif kind == "zip":
        out = read_zip(spark, src, options.pop("schema"))
    elif kind == "orc":
        out = spark.read.orc(src)
    elif kind in ("xls", "xlsx"):
        out = next(iter(read_excel(spark, src).values()))
    else:
        raise ValueError(f"unknown file type: {kind}")
    columns, block, n = options.get("columns"), set(options.get("block", ())), options.get("n_rows")
    if columns or block:
        out = out.select(*[c(x) for x in (columns or out.columns) if x not in block])
    return out.limit(n) if n is not None else out
