"""Preparation of tables for models: targets, splits, matrices, principal components, and trainers of pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.categorical import CategoricalMap, dataset_categorical_maps, dataset_one_hot_maps, invert_categorical_map
from weftline.operators.columns import assoc_metadata
from weftline.operators.selectors import Selector, is_numeric, resolve
from weftline.plans.order import ROW_ID, Order, c, names, with_row_ids


def set_inference_target(df: DataFrame, targets: str | Iterable[str]) -> DataFrame:
    return assoc_metadata(df, [targets] if isinstance(targets, str) else list(targets), **{"inference-target": True})


def is_inference_column(df: DataFrame, name: str) -> bool:
    return bool((df.schema[name].metadata or {}).get("inference-target"))


def inference_target_column_names(df: DataFrame) -> list[str]:
    return [x for x in df.columns if is_inference_column(df, x)]


def _target_map(df: DataFrame, target: str | None = None) -> CategoricalMap:
    targets = [target] if target else inference_target_column_names(df)
    if len(targets) != 1:
        raise ValueError(f"one target is needed, there are {len(targets)}")
    found = [m for m in dataset_categorical_maps(df) if m.src_column == targets[0]]
    if not found:
        raise ValueError(f"{targets[0]} has no label map")
    return found[0]


def inference_target_label_map(df: DataFrame, target: str | None = None) -> dict:
    return _target_map(df, target).lookup


def inference_target_label_inverse_map(df: DataFrame, target: str | None = None) -> dict:
    return {v: k for k, v in inference_target_label_map(df, target).items()}


def num_inference_classes(df: DataFrame) -> int:
    return len(inference_target_label_map(df))


def dataset_categorical_xforms(df: DataFrame) -> dict:
    return {m.src_column: m for m in [*dataset_categorical_maps(df), *dataset_one_hot_maps(df)]}


def feature_ecount(df: DataFrame) -> int:
    """Columns that aren't targets."""
    return len(df.columns) - len(inference_target_column_names(df))


def model_type(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    maps = dataset_categorical_xforms(df)
    return {x: "classification" if x in maps or not is_numeric(df.schema[x].dataType) else "regression" for x in (columns or inference_target_column_names(df))}


def column_values_to_categorical(df: DataFrame, column: str) -> DataFrame:
    """The column decoded by its label map."""
    return invert_categorical_map(df.select(c(column)), _target_map(df, column))


def inference_target_ds(df: DataFrame) -> DataFrame:
    out = df.select(*[c(x) for x in inference_target_column_names(df)])
    for m in dataset_categorical_maps(out):
        out = invert_categorical_map(out, m)
    return out


def labels(df: DataFrame) -> DataFrame:
    """The one target, decoded if it has a label map."""
    return inference_target_ds(df)


def _shuffled(df: DataFrame, order: Order, seed: int, shuffle: bool) -> tuple[DataFrame, int]:
    """Row ids in a random order that depends on the order's keys and the seed only."""
    keys = names(order)
    if shuffle:
        ids = with_row_ids(df.withColumn("__mix", F.xxhash64(F.lit(seed), *[c(k) for k in keys])), ["__mix", *keys]).drop("__mix")
    else:
        ids = with_row_ids(df, keys)
    return ids, df.count()


def k_fold_datasets(df: DataFrame, k: int, order: Order, seed: int = 0, shuffle: bool = True) -> list[dict[str, DataFrame]]:
    """k pairs of train and test; tests are disjoint, make up the table, and differ by a row in size at most."""
    ids, n = _shuffled(df, order, seed, shuffle)
    size, rest = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        end = at + size + (i < rest)
        mine = F.col(ROW_ID).between(at, end - 1)
        out.append({"train-ds": ids.where(~mine).drop(ROW_ID), "test-ds": ids.where(mine).drop(ROW_ID)})
        at = end
    return out


def train_test_split(df: DataFrame, order: Order, train_fraction: float = 0.7, seed: int = 0, shuffle: bool = True) -> dict[str, DataFrame]:
    ids, n = _shuffled(df, order, seed, shuffle)
    cut = round(n * train_fraction)
    return {"train-ds": ids.where(F.col(ROW_ID) < cut).drop(ROW_ID), "test-ds": ids.where(F.col(ROW_ID) >= cut).drop(ROW_ID)}


def probability_distributions_to_label_column(df: DataFrame, dst: str, selector: Selector = None) -> DataFrame:
    """The name of the greatest of the columns, the first of equals; NaN or null is an error."""
    cols = resolve(df, selector)
    values = F.array(*[c(x).cast("double") for x in cols])
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v))
    at = F.array_position(values, F.array_max(values)).cast("int")
    return df.withColumn(dst, F.when(bad, F.raise_error(F.lit("a probability is missing"))).otherwise(F.element_at(F.array(*[F.lit(x) for x in cols]), at))).withMetadata(dst, {"column-type": "prediction"})


def tensor_to_dataset(spark, tensor: np.ndarray, columns: list[str] | None = None) -> DataFrame:
    tensor = np.asarray(tensor)
    if tensor.ndim != 2:
        raise ValueError("two dimensions are needed")
    return spark.createDataFrame(pd.DataFrame(tensor, columns=columns or [str(i) for i in range(tensor.shape[1])]))


def dataset_to_tensor(df: DataFrame, dtype=np.float64, order: Order = ()) -> np.ndarray:
    """All columns as a matrix on the driver; null is NaN."""
    src = df.orderBy(*[c(o) for o in names(order)]) if names(order) else df
    return src.select(*[c(x).cast("double") for x in df.columns]).toPandas().to_numpy(dtype)


dataset_to_dense, dense_to_dataset = dataset_to_tensor, tensor_to_dataset


@dataclass(frozen=True)
class PCA:
    columns: list[str]
    means: list[float]
    eigenvectors: np.ndarray
    eigenvalues: np.ndarray
    n_components: int


def fit_pca(df: DataFrame, selector: Selector = None, n_components: int | None = None, variance_amount: float = 0.95) -> PCA:
    """Principal components of the covariance matrix, of columns less their means; nulls are an error. Tasks add up products of their rows, and the driver solves a matrix of columns by columns."""
    cols = [x for x in resolve(df, selector) if is_numeric(df.schema[x].dataType)]
    n = len(cols)
    got = list(df.agg(F.count(F.lit(1)), *[F.count_if(c(x).isNull()) for x in cols], *[F.avg(c(x).cast("double")) for x in cols]).first())
    if any(got[1 : n + 1]):
        raise ValueError("nulls in columns of a PCA")
    means = got[n + 1 :]

    def products(batches):
        total = np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(a, np.float64) for a in b.columns], 1) - np.array(means)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], ["at", "v"])

    cov = np.zeros(n * n)
    for r in df.select(*[c(x).cast("double").alias(f"x{i}") for i, x in enumerate(cols)]).mapInArrow(products, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        cov[r["at"]] = r["v"]
    cov = cov.reshape(n, n) / max(got[0] - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order].clip(0), vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1, 1)
    if n_components is None:
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        n_components = min(n, int(np.searchsorted(share, variance_amount) + 1))
    return PCA(cols, means, vectors, values, n_components)


def transform_pca(df: DataFrame, pca: PCA, n_components: int | None = None, keep: bool = False) -> DataFrame:
    """Columns pca-0, pca-1, ... as expressions, in place of the fitted columns unless these are kept."""
    made = []
    for k in range(n_components or pca.n_components):
        x = F.lit(0.0)
        for name, m, w in zip(pca.columns, pca.means, pca.eigenvectors[:, k]):
            x = x + (c(name).cast("double") - float(m)) * float(w)
        made.append(x.alias(f"pca-{k}"))
    return df.select(*[c(x) for x in df.columns if keep or x not in pca.columns], *made)


def _assembled(df: DataFrame, target: str | None) -> tuple[DataFrame, list[str], str]:
    from pyspark.ml.feature import VectorAssembler

    target = target or inference_target_column_names(df)[0]
    cols = [x for x in df.columns if x != target]
    renamed = df.select(*[c(x).cast("double").alias(f"__f{i}") for i, x in enumerate(cols)], c(target).cast("double").alias("label"))
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(cols))], outputCol="features", handleInvalid="skip").transform(renamed), cols, target


def trainer(name: str, **params):
    """An estimator of pyspark.ml by name."""
    from pyspark.ml import classification, regression

    kinds = {
        "logistic-regression": classification.LogisticRegression, "random-forest-classifier": classification.RandomForestClassifier, "gbt-classifier": classification.GBTClassifier, "naive-bayes": classification.NaiveBayes,
        "linear-regression": regression.LinearRegression, "random-forest-regressor": regression.RandomForestRegressor, "gbt-regressor": regression.GBTRegressor, "decision-tree-regressor": regression.DecisionTreeRegressor,
    }
    return kinds[name](**params)


@dataclass(frozen=True)
class Trained:
    model: object
    columns: list[str]
    target: str
    labels: dict


def train_classification(estimator, df: DataFrame, target: str | None = None) -> Trained:
    data, cols, target = _assembled(df, target)
    maps = {m.src_column: m.lookup for m in dataset_categorical_maps(df)}
    return Trained(estimator.fit(data), cols, target, {v: k for k, v in maps.get(target, {}).items()})


def train_regression(estimator, df: DataFrame, target: str | None = None) -> Trained:
    return train_classification(estimator, df, target)


def _features(trained: Trained, df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cols = [f"__f{i}" for i in range(len(trained.columns))]
    data = df.withColumns({f: c(x).cast("double") for f, x in zip(cols, trained.columns)})
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(data)


def predict_classification(trained: Trained, df: DataFrame) -> DataFrame:
    """df with prediction, decoded if labels are known, and a column of probability for each class."""
    from pyspark.ml.functions import vector_to_array

    out = trained.model.transform(_features(trained, df)).withColumn("__p", vector_to_array("probability"))
    n = trained.model.numClasses
    name = lambda i: f"probability-{trained.labels.get(float(i), trained.labels.get(i, i))}"
    label = F.col("prediction") if not trained.labels else F.element_at(F.create_map(*[F.lit(y) for k, v in trained.labels.items() for y in (float(k), v)]), F.col("prediction"))
    probs = [F.col("__p")[i].alias(name(i), metadata={"column-type": "probability-distribution"}) for i in range(n)]
    return out.select(*[c(x) for x in df.columns], label.alias("prediction", metadata={"column-type": "prediction"}), *probs)


def predict_regression(trained: Trained, df: DataFrame) -> DataFrame:
    return trained.model.transform(_features(trained, df)).select(*[c(x) for x in df.columns], F.col("prediction").alias("prediction", metadata={"column-type": "prediction"}))


def evaluate_regression(trained: Trained, df: DataFrame) -> dict[str, float]:
    d = F.col("prediction") - c(trained.target).cast("double")
    got = predict_regression(trained, df).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.sum(d * d) / F.nullif(F.var_pop(c(trained.target)) * F.count(F.lit(1)), F.lit(0.0))).alias("r2")).first()
    return got.asDict()
