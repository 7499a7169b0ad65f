"""Writing tables to files by their type."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.sources.readers import file_type

CODECS = {".gz": "gzip", ".bz2": "bzip2"}


def write_dataset(df: DataFrame, path: str, file_type_: str | None = None, mode: str = "errorifexists", single: bool = False, **options) -> None:
    """A folder of part files written by the tasks; single: one part, for small tables. Text types take their packing from the path's ending."""
    kind = file_type_ or file_type(path)
    out = (df.coalesce(1) if single else df).write.mode(mode)
    codec = next((v for k, v in CODECS.items() if path.endswith(k)), None)
    if codec:
        out = out.option("compression", codec)
    out = out.options(**options)
    if kind in ("csv", "txt"):
        out.csv(path, header=True, escape='"')
    elif kind == "tsv":
        out.csv(path, header=True, sep="\t", escape='"')
    elif kind in ("parquet", "nippy"):
        out.parquet(path)
    elif kind in ("json", "jsonl", "ndjson", "transit-json"):
        out.json(path)
    elif kind == "orc":
        out.orc(path)
    elif kind in ("arrow", "arrows", "feather"):
        write_arrow(df, path, stream=kind == "arrows")
    elif kind == "zip":
        write_zip({"data": df}, path)
    else:
        raise ValueError(f"unknown file type: {kind}")


def write_arrow(df: DataFrame, path: str, stream: bool = False, compression: str | None = None, batch_rows: int = 65536) -> None:
    """One Arrow file or stream, written by the driver, which gets a batch of rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    opts = pa.ipc.IpcWriteOptions(compression=compression)
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(path, schema, options=opts) as w:
        held: list[dict] = []
        for r in df.toLocalIterator(prefetchPartitions=True):
            held.append(r.asDict(recursive=True))
            if len(held) == batch_rows:
                w.write_batch(pa.RecordBatch.from_pylist(held, schema))
                held = []
        if held:
            w.write_batch(pa.RecordBatch.from_pylist(held, schema))


def write_zip(tables: Mapping[str, DataFrame], path: str) -> None:
    """An entry for each table, CSV unless its name has another ending; for tables that the driver can hold one at a time."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            text = io.StringIO()
            df.toPandas().to_csv(text, index=False, sep="\t" if name.endswith(".tsv") else ",")
            z.writestr(name if "." in name else f"{name}.csv", text.getvalue())


def to_json_strings(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*[F.col(f"`{x}`") for x in df.columns])).alias("value"))


def from_json_strings(df: DataFrame, schema: str) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(F.from_json("value", schema).alias("s")).select("s.*")
