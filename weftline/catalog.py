"""Every operator of the survey's inventory by its name there: what carries it out here, or why nothing does.

Names that the inventory lists for several modules have one entry, qualified where they differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import frame
from weftline.functions import parsing, printing, scalars, stats
from weftline.operators import categorical, columns, joins, missing, modelling, reductions, reshape, rolling, rows, selectors, sets
from weftline.plans import order, pipeline
from weftline.sources import readers, writers
from weftline.streaming import incremental


def read_sequence(spark: SparkSession, paths: Iterable[str], load: Callable | None = None, schema: str | None = None, **options) -> DataFrame:
    """Several files as one table; with load, a function of each batch of rows on the workers."""
    out = sets.concat(*[readers.read_dataset(spark, p, **options) for p in paths])
    return reshape.pmap_ds(out, load, schema) if load else out


def write_sequence(tables: Iterable[DataFrame], path: str, **options) -> None:
    """Several tables as one: columns by name, types widened."""
    writers.write_dataset(sets.concat(*tables), path, **options)


def raw_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Lines of a text file as arrays of fields, none of them parsed."""
    return spark.read.text(path).select(F.split("value", f"[{sep}]", -1).alias("row"))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return rows.sample(df, n, seed=seed)


def decimal_column_metadata(df: DataFrame, column: str) -> dict:
    """Precision and scale of a decimal column, which its type fixes."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"{column} is {kind.simpleString()}")
    return {"precision": kind.precision, "scale": kind.scale, "bit-width": 128}


def rows_to_csv(df: DataFrame, path: str, sep: str = "\t", quote_all: bool = False) -> None:
    df.write.csv(path, header=True, sep=sep, quoteAll=quote_all, escape='"')


def prepend_with_empty(df: DataFrame, n: int) -> DataFrame:
    """n rows of nulls, which come first where nulls do."""
    return columns.extend_with_empty(df, n)


def column_kind(df: DataFrame, name: str) -> T.StructField:
    """A column's name, type and metadata."""
    return df.schema[name]


def set_column_name(df: DataFrame, name: str, new: str) -> DataFrame:
    return columns.rename_columns(df, {name: new})


def scan_missing(df: DataFrame, name: str) -> DataFrame:
    """Rows whose value is null or NaN."""
    x = order.c(name)
    return df.where(x.isNull() | F.isnan(x) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else x.isNull())


def compressed(df: DataFrame) -> DataFrame:
    """The table in Spark's columnar cache, which picks an encoding for each column's batches."""
    return df.cache()


BY_NAME: dict[str, Callable] = {
    # scans, sources and sinks
    "->dataset": readers.read_dataset, "->>dataset": readers.read_dataset, "write!": writers.write_dataset, "csv->dataset": readers.read_csv, "csv->dataset-seq": read_sequence, "rows->dataset-fn": readers.from_maps, "rows->csv!": rows_to_csv,
    "create-csv-parser": readers.read_csv, "csv->rows": raw_rows, "rows->dataset": readers.read_csv, "partition-all-rows": frame.partitions_of, "sample-rows": sample_rows, "parquet->ds": readers.read_dataset, "parquet->ds-seq": read_sequence,
    "parquet->metadata-seq": readers.parquet_metadata, "->row-group-supplier": readers.parquet_metadata, "ds->parquet": writers.write_dataset, "ds-seq->parquet": write_sequence, "stream->dataset": readers.read_arrow, "stream->dataset-seq": readers.read_arrow,
    "stream->dataset-iterable": readers.read_arrow, "dataset->stream!": writers.write_arrow, "dataset-seq->stream!": write_sequence, "decimal-column-metadata": decimal_column_metadata, "workbook->datasets": readers.read_excel, "sheet->dataset": readers.read_excel,
    "load-nippy": readers.read_dataset, "write-nippy!": writers.write_dataset, "dataset->transit": writers.write_dataset, "transit->dataset": readers.read_json, "dataset->transit-str": writers.to_json_strings, "transit-str->dataset": writers.from_json_strings,
    "zipfile->dataset-seq": readers.read_zip, "dataset-seq->zipfile!": writers.write_zip, "parse-svm-file": readers.read_dataset, "mapseq->dataset": readers.from_maps, "column-map->dataset": readers.from_columns, "ds->spark-dataset": readers.from_maps,
    "collect-spark-dataset->ds": frame.dataset_to_data, "datatype->sql-type": frame.datatype_to_sql_type,
    # projections and columns
    "select": columns.select, "select-by-index": columns.select_by_index, "unordered-select": columns.unordered_select, "select-columns": columns.select_columns, "select-columns-by-index": columns.select_columns_by_index, "remove-column": columns.remove_column,
    "remove-columns": columns.remove_columns, "drop-columns": columns.drop_columns, "rename-columns": columns.rename_columns, "add-column": columns.add_column, "new-column": columns.new_column, "add-or-update-column": columns.add_or_update_column,
    "assoc-ds": columns.assoc_ds, "update-column": columns.update_column, "update-columns": columns.update_columns, "order-column-names": columns.order_column_names, "extend-with-empty": columns.extend_with_empty, "check-empty": columns.check_empty,
    "append-columns": columns.append_columns, "filter-dataset": columns.filter_dataset, "update": columns.update, "update-columnwise": columns.update_columnwise, "update-elemwise": columns.update_elemwise, "column-map": columns.column_map, "column-map-m": columns.column_map_m,
    "column-cast": columns.column_cast, "column->dataset": columns.column_to_dataset, "assoc-metadata": columns.assoc_metadata, "remove-empty-columns": columns.remove_empty_columns, "empty-column-names": columns.empty_column_names,
    "column-filter": selectors.column_filter, "metadata-filter": selectors.metadata_filter, "categorical": selectors.categorical, "numeric": selectors.numeric, "of-datatype": selectors.of_datatype, "boolean": selectors.boolean, "string": selectors.string, "datetime": selectors.datetime,
    "target": selectors.target, "feature": selectors.feature, "prediction": selectors.prediction, "probability-distribution": selectors.probability_distribution, "missing (columns)": selectors.missing, "no-missing": selectors.no_missing,
    "intersection (columns)": selectors.intersection, "union (columns)": selectors.union, "difference (columns)": selectors.difference,
    # filters and rows
    "filter": rows.filter_rows, "filter-column": rows.filter_column, "select-rows": rows.select_rows, "drop-rows": rows.drop_rows, "remove-rows": rows.remove_rows, "missing": rows.missing_rows, "drop-missing": rows.drop_missing, "select-missing": rows.select_missing,
    "columns-with-missing-seq": columns.columns_with_missing_seq, "reverse-rows": rows.reverse_rows, "head": rows.head, "tail": rows.tail, "take-nth": rows.take_nth, "shuffle": rows.shuffle, "sample": rows.sample, "rand-nth": rows.rand_nth, "simplify-row-indexes": rows.select_rows,
    # joins
    "hash-join": joins.hash_join, "inner-join": joins.inner_join, "left-join": joins.left_join, "right-join": joins.right_join, "pd-merge": joins.pd_merge, "left-join-asof": joins.left_join_asof, "hash-join-algo": joins.hash_join, "asof-lt": joins.left_join_asof, "asof-gt": joins.left_join_asof, "asof-nearest": joins.left_join_asof,
    # grouping and aggregation
    "group-by": reductions.group_by, "group-by-column": reductions.group_by_column, "group-by->indexes": reductions.group_by_indexes, "group-by-column->indexes": reductions.group_by_column_indexes, "group-by-column-consumer": reductions.group_by_column, "group-by-column-agg": reductions.group_by_column_agg,
    "group-by-column-agg-rf": incremental.group_by_column_agg_stream, "aggregate": reductions.aggregate, "sum": reductions.sum, "mean": reductions.mean, "row-count": reductions.row_count, "maximum": reductions.maximum, "maximum-rf": reductions.maximum, "first-value": reductions.first_value,
    "distinct": reductions.distinct, "distinct-int32": reductions.distinct_int32, "count-distinct": reductions.count_distinct, "prob-set-cardinality": reductions.prob_set_cardinality, "prob-quantile": reductions.prob_quantile, "prob-quantiles": reductions.prob_quantiles, "prob-median": reductions.prob_median,
    "prob-interquartile-range": reductions.prob_interquartile_range, "prob-cdf": reductions.prob_cdf, "prob-cdfs": reductions.prob_cdfs, "prob-pmfs": reductions.prob_pmfs, "reservoir-desc-stat": reductions.reservoir_desc_stat, "reservoir-dataset": reductions.reservoir_dataset, "reducer": reductions.reducer,
    "reducer->column-reducer": reductions.expression_reducer, "combine-reducers": reductions.group_by_column_agg, "hll-reducer": reductions.hll_reducer, "doubles-sketch-reducer": reductions.doubles_sketch_reducer, "num-inference-classes": modelling.num_inference_classes,
    # windows, sorts
    "rolling": rolling.rolling, "expanding": rolling.expanding, "apply-window-ranges": rolling.rolling, "mean (window)": rolling.mean, "sum (window)": rolling.sum, "min": rolling.min, "max": rolling.max, "variance": rolling.variance, "standard-deviation": rolling.standard_deviation, "nth": rolling.nth, "first": rolling.first, "last": rolling.last,
    "sort-by": rows.sort_by, "sort-by-column": rows.sort_by_column, "min-n-by-column": rows.min_n_by_column,
    # sets, reshape
    "union": sets.union, "reduce-union": sets.reduce_union, "intersection": sets.intersection, "reduce-intersection": sets.reduce_intersection, "difference": sets.difference, "concat": sets.concat, "concat-copying": sets.concat_copying, "concat-inplace": sets.concat_inplace,
    "unique-by": rows.unique_by, "unique-by-column": rows.unique_by_column, "unique": rows.unique, "columnwise-concat": reshape.columnwise_concat, "column-labeled-mapseq": reshape.column_labeled_mapseq, "unroll-column": reshape.unroll_column, "transpose-by-key": reshape.transpose_by_key,
    "row-map": reshape.row_map, "row-mapcat": reshape.row_mapcat, "pmap-ds": reshape.pmap_ds, "induction": reshape.induction, "bind->": reshape.bind,
    # missing values
    "replace-missing": missing.replace_missing, "replace-missing-with-strategy": missing.replace_missing, "replace-missing-with-value": missing.replace_missing, "replace-missing-with-direction": missing.replace_missing, "replace-missing-with-nearest": missing.replace_missing, "replace-missing-with-lerp": missing.replace_missing,
    "replace-missing-with-abb": missing.replace_missing, "replace-missing-value": missing.replace_missing_value, "fill-range-replace": missing.fill_range_replace, "is-missing?": missing.is_missing, "set-missing": missing.set_missing, "union-missing-sets": missing.union_missing, "intersect-missing-sets": missing.intersect_missing,
    # parsing and casts
    "parse-column": parsing.parse_column, "make-fixed-parser": parsing.parser, "promotional-string-parser": parsing.infer, "promotional-object-parser": readers.from_maps, "parser-entry->parser-tuple": parsing.parser, "missing-value?": parsing.present, "parse-local-date": parsing.parse_local_date,
    "parse-local-time": parsing.parse_local_time, "parse-local-date-time": parsing.parse_local_date_time, "parse-duration": parsing.parse_duration, "datetime-formatter-parse-str-fn": parsing.parser, "datetime-formatter-or-str->parser-fn": parsing.parser, "scalar functions": scalars.call,
    # statistics, scaling, categories, models
    "descriptive-stats": stats.descriptive_stats, "brief": stats.brief, "all-descriptive-stats-names": stats.all_descriptive_stats_names, "supported-column-stats": stats.supported_column_stats, "stats": frame.column_stats, "supported-stats": stats.supported_column_stats, "correlation": stats.correlation,
    "correlation-table": stats.correlation_table, "interpolate-loess": stats.interpolate_loess, "fit-std-scale": stats.fit_std_scale, "transform-std-scale": stats.transform_std_scale, "fit-minmax": stats.fit_minmax, "transform-minmax": stats.transform_minmax, "mean-center-columns!": stats.mean_center_columns,
    "fit-categorical-map": categorical.fit_categorical_map, "transform-categorical-map": categorical.transform_categorical_map, "invert-categorical-map": categorical.invert_categorical_map, "create-categorical-map": categorical.create_categorical_map, "fit-one-hot": categorical.fit_one_hot,
    "transform-one-hot": categorical.transform_one_hot, "invert-one-hot-map": categorical.invert_one_hot_map, "dataset->categorical-maps": categorical.dataset_categorical_maps, "dataset->one-hot-maps": categorical.dataset_one_hot_maps, "reverse-map-categorical-xforms": categorical.reverse_map_categorical_xforms,
    "categorical->number": categorical.categorical_to_number, "categorical->one-hot": categorical.categorical_to_one_hot, "set-inference-target": modelling.set_inference_target, "inference-column?": modelling.is_inference_column, "inference-target-column-names": modelling.inference_target_column_names,
    "inference-target-label-map": modelling.inference_target_label_map, "inference-target-label-inverse-map": modelling.inference_target_label_inverse_map, "dataset->categorical-xforms": modelling.dataset_categorical_xforms, "feature-ecount": modelling.feature_ecount, "model-type": modelling.model_type,
    "column-values->categorical": modelling.column_values_to_categorical, "k-fold-datasets": modelling.k_fold_datasets, "train-test-split": modelling.train_test_split, "inference-target-ds": modelling.inference_target_ds, "labels": modelling.labels,
    "probability-distributions->label-column": modelling.probability_distributions_to_label_column, "tensor->dataset": modelling.tensor_to_dataset, "dataset->tensor": modelling.dataset_to_tensor, "dataset->dense": modelling.dataset_to_dense, "dense->dataset": modelling.dense_to_dataset, "fit-pca!": modelling.fit_pca,
    "transform-pca!": modelling.transform_pca, "fit-pca": modelling.fit_pca, "transform-pca": modelling.transform_pca, "make-classification-datasource": modelling.train_classification, "train-classification": modelling.train_classification, "predict-classification": modelling.predict_classification,
    "classification-predictions->dataset": modelling.predict_classification, "make-regression-datasource": modelling.train_regression, "train-regression": modelling.train_regression, "predict-regression": modelling.predict_regression, "evaluate-regression": modelling.evaluate_regression, "trainer": modelling.trainer,
    # incremental
    "dataset-parser": incremental.DatasetParser, "mapseq-parser": incremental.mapseq_parser, "mapseq-rf": incremental.mapseq_rf, "mapseq-reducer": incremental.mapseq_reducer, "streaming": incremental.read_stream, "pipelines": pipeline.pipeline,
    # accessors, printing, storage
    "dataset-name": frame.Frame, "set-dataset-name": frame.Frame.set_dataset_name, "column-count": printing.column_count, "shape": printing.shape, "columns": column_kind, "column": column_kind, "column-names": columns.order_column_names, "has-column?": printing.has_column, "rows": printing.rows, "row-at": printing.row_at,
    "rowvecs": printing.rowvecs, "rowvec-at": printing.rowvec_at, "value-reader": printing.rowvecs, "mapseq-reader": printing.rows, "empty-dataset": frame.empty_dataset, "new-dataset": readers.from_columns, "construct-dataset": readers.from_columns, "dataset->data": frame.dataset_to_data, "data->dataset": frame.data_to_dataset,
    "column->data": frame.dataset_to_data, "data->column": frame.data_to_dataset, "ensure-array-backed": frame.Frame.ensure_array_backed, "dataset->string": printing.dataset_to_str, "string-table-keyset": frame.string_table_keyset, "column->string-table": frame.string_table_keyset, "print-all": printing.print_all,
    "dataset-data->str": printing.dataset_to_str, "dataset->str": printing.dataset_to_str, "formatter": printing.format_sequence, "format-sequence": printing.format_sequence, "column-name": column_kind, "set-name": set_column_name, "extend-column-with-empty": columns.extend_with_empty,
    "prepend-column-with-empty": prepend_with_empty, "to-double-array": frame.to_double_array, "compress-ds": compressed, "memoize": frame.memoize, "column-safe-name": frame.column_safe_name, "scan-missing": scan_missing, "prepare-column-data": readers.from_columns,
}

#: Operators that have nothing to do here.
NOT_HERE: dict[str, str] = {
    "clipboard->dataset": "a cluster has no clipboard", "dataset->clipboard": "a cluster has no clipboard", "dataset?": "isinstance(x, DataFrame)", "is-column?": "isinstance(x, Column)", "clone": "columns don't change",
    "print-range": "arguments of dataset_to_str", "print-policy": "arguments of dataset_to_str", "print-width": "arguments of dataset_to_str", "print-types": "arguments of dataset_to_str", ":edn": "JSON lines instead", "compress-column": "the columnar cache and Parquet encode columns", "compress-column-buffer": "the columnar cache and Parquet encode columns",
    "ensure-column-string-table": "Parquet keeps dictionaries", "ensure-dataset-string-tables": "Parquet keeps dictionaries", "make-string-table": "Parquet keeps dictionaries", "->string-table": "Parquet keeps dictionaries", "merge-string-tables": "Parquet keeps dictionaries",
    "->sparse-ds": "nulls take a bit each", "->scol": "nulls take a bit each", "scol->reader": "nulls take a bit each", "sparse-rows": "nulls take a bit each", "is-sparse?": "nulls take a bit each", "dynamic-int-list": "types are fixed by the schema", "file-backed-text": "shuffles and caches spill",
    "make-container": "types are fixed by the schema", "datatype->missing-value": "missing is null",
}
