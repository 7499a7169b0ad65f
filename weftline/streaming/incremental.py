"""The incremental surface: tables that grow, and aggregates kept over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.reductions import Agg, Reservoir
from weftline.plans.order import Order, c, names


class DatasetParser:
    """A table that grows by rows on the driver and can be had at any time; for rows that come one by one, not for bulk."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows = spark, []

    def add_row(self, row: Mapping) -> DatasetParser:
        self._rows.append(dict(row))
        return self

    def add_rows(self, rows: Iterable[Mapping]) -> DatasetParser:
        for r in rows:
            self.add_row(r)
        return self

    def __len__(self) -> int:
        return len(self._rows)

    def nth(self, i: int) -> dict:
        return self._rows[i]

    def clear(self) -> None:
        self._rows = []

    def snapshot(self) -> DataFrame:
        from weftline.sources.readers import from_maps

        return from_maps(self.spark, self._rows)


def mapseq_parser(spark: SparkSession) -> Callable:
    """A function that adds a row when it is given one, and gives the table when it is given none."""
    held = DatasetParser(spark)
    return lambda *row: held.add_row(row[0]) if row else held.snapshot()


def mapseq_reducer(spark: SparkSession) -> tuple[Callable, Callable, Callable]:
    """Start, step and finish of a fold of rows into a table."""
    return lambda: DatasetParser(spark), lambda acc, row: acc.add_row(row), lambda acc: acc.snapshot()


mapseq_rf = mapseq_reducer


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """A stream of files as they come into a folder."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def group_by_column_agg_stream(stream: DataFrame, keys: Order, aggs: Mapping[str, Agg], index_filter: Column | str | None = None) -> DataFrame:
    """The grouped aggregation as a streaming plan; its state grows with the groups. For update or complete mode."""
    if any(isinstance(a, Reservoir) for a in aggs.values()):
        raise ValueError("reservoirs don't run on streams")
    src = stream if index_filter is None else stream.filter(index_filter)
    return src.groupBy(*[c(k) for k in names(keys)]).agg(*[a(src).alias(k) for k, a in aggs.items()])


def windowed_agg_stream(stream: DataFrame, time: str, window: str, aggs: Mapping[str, Agg], keys: Order = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by windows of event time; rows later than late don't count, and windows older than that leave the state."""
    src = stream.withWatermark(time, late)
    span = F.window(c(time), window, slide) if slide else F.window(c(time), window)
    out = src.groupBy(span.alias("w"), *[c(k) for k in names(keys)]).agg(*[a(src).alias(k) for k, a in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c(x) for x in out.columns if x != "w"])


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over what is there now; sink gets each batch with its number, by which it can tell a batch that comes again."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def fold_batches(batches: Iterable[DataFrame], keys: Order, sums: Mapping[str, str]) -> DataFrame:
    """Sums (by name, of a column) and n over batches, each reduced before they are added up."""
    from functools import reduce

    ks = [c(k) for k in names(keys)]
    parts = [b.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c(x)).alias(o) for o, x in sums.items()]) for b in batches]
    return reduce(DataFrame.unionByName, parts).groupBy(*ks).agg(F.sum("n").alias("n"), *[F.sum(c(o)).alias(o) for o in sums])
