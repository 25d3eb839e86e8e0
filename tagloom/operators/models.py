"""Pooled regressors on the feature table.

Linear and ridge regression are solved by block elimination (``tagloom.operators.pooled``),
whatever the number of tags.  Forests and boosted trees are Spark ML's, over one slot per
category.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.arithmetic import at_least
from tagloom.operators.forecasts import PREDICTION_COLUMNS, SCORED_SPLITS
from tagloom.operators.panel import concat_all
from tagloom.operators.pooled import PooledFit, category_fills, design_of, fit_pooled, with_predictions
from tagloom.operators.scaling import Scaling, fit_scaling
from tagloom.sources.tables import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET

# Slots of a category that a tree may split on: the list of them lives on the driver.
TREE_CATEGORIES = 100_000
# Train rows of a task that grows trees.
TREE_ROWS = 500_000
# Candidate splits of a tree's column: enough for each distinct value of a small panel.
MAX_BINS = 255


@dataclass(frozen=True)
class ModelConfig:
    name: str
    kind: str
    options: Mapping[str, object] = field(default_factory=dict)


# The compared models.
MODEL_CONFIGS = (
    ModelConfig("linear_regression_pooled", "linear_regression"),
    ModelConfig("ridge_regression_pooled", "ridge", {"alpha": 10.0}),
    ModelConfig(
        "random_forest_pooled",
        "random_forest",
        {"numTrees": 80, "maxDepth": 8, "minInstancesPerNode": 5, "seed": 42},
    ),
    ModelConfig(
        "hist_gradient_boosting_pooled",
        "gradient_boosting",
        {"maxIter": 120, "stepSize": 0.05, "maxDepth": 4, "seed": 42},
    ),
)


def category_encoder(columns: Sequence[str] = CATEGORICAL_FEATURES) -> Pipeline:
    """One slot per known category; an unknown one encodes as all zeros."""
    indexed = [f"{c}_index" for c in columns]
    return Pipeline(
        stages=[
            StringIndexer(
                inputCols=list(columns),
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            # The last slot is the one for unknown values: it is dropped.
            OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_slots" for c in columns], dropLast=True),
        ]
    )


def require_bounded_categories(train: DataFrame, columns: Sequence[str], bound: int = TREE_CATEGORIES) -> None:
    """The list of slots lives on the driver: refuse a column with too many values."""
    found = train.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    for column in columns:
        if found[column] > bound:
            raise ValueError(f"{column} has more than {bound} categories; select top tags first")


def fit_encoder(
    rows: DataFrame, categorical: Sequence[str] = CATEGORICAL_FEATURES, fills: Mapping[str, str] | None = None
) -> PipelineModel:
    """Missing categories count as ``fills``, by default the most frequent one."""
    require_bounded_categories(rows, categorical)
    return category_encoder(categorical).fit(rows.fillna(dict(fills or category_fills(rows, categorical))))


@dataclass(frozen=True)
class Preparation:
    """Fitted scaling and encoding."""

    scaling: Scaling
    encoder: PipelineModel
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    fills: Mapping[str, str]

    def apply(self, df: DataFrame) -> DataFrame:
        filled = df.fillna(dict(self.fills))
        encoded = self.encoder.transform(self.scaling.apply(filled))
        parts = [f"{c}_scaled" for c in self.numeric] + [f"{c}_slots" for c in self.categorical]
        return VectorAssembler(inputCols=parts, outputCol="features").transform(encoded)


def prepare(
    train: DataFrame,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    encode_over: DataFrame | None = None,
) -> Preparation:
    """Fit on the train rows; categories may be listed over a wider frame."""
    fills = category_fills(train, categorical)
    encoder = fit_encoder(train if encode_over is None else encode_over, categorical, fills)
    return Preparation(fit_scaling(train, numeric), encoder, tuple(numeric), tuple(categorical), fills)


def penalty(config: ModelConfig) -> float | None:
    """The penalty of a linear model; None for other kinds."""
    if config.kind == "linear_regression":
        return 0.0
    return float(config.options["alpha"]) if config.kind == "ridge" else None


def build_regressor(config: ModelConfig):
    """The Spark ML estimator of a tree configuration."""
    columns = {"featuresCol": "features", "labelCol": TARGET, "predictionCol": "raw_prediction"}
    if config.kind == "random_forest":
        return RandomForestRegressor(**columns, featureSubsetStrategy="all", maxBins=MAX_BINS, **config.options)
    if config.kind == "gradient_boosting":
        return GBTRegressor(**columns, maxBins=MAX_BINS, **config.options)
    raise ValueError(f"unknown model kind: {config.kind}")


def _finished(raw: DataFrame) -> DataFrame:
    return raw.withColumn("prediction", at_least(F.col("raw_prediction"), 0.0)).select(*PREDICTION_COLUMNS)


def predictions_of(model, prepared: DataFrame, name: str) -> DataFrame:
    """Validation and test predictions of a tree model, clipped at 0."""
    rows = prepared.where(F.col("split").isin(*SCORED_SPLITS))
    return _finished(model.transform(rows).withColumn("model", F.lit(name)))


def pooled_predictions(modeling: DataFrame, fits: Mapping[str, PooledFit]) -> DataFrame:
    """Validation and test predictions of all linear models from one scan and one join, clipped at 0."""
    numbered = {f"_raw_{i}": fit for i, fit in enumerate(fits.values())}
    rows = with_predictions(modeling.where(F.col("split").isin(*SCORED_SPLITS)), numbered)
    both = [F.struct(F.lit(name).alias("model"), F.col(raw).alias("raw_prediction")) for name, raw in zip(fits, numbered)]
    return _finished(rows.select("*", F.inline(F.array(*both))))


@dataclass(frozen=True)
class FittedModels:
    models: dict[str, object]
    predictions: DataFrame
    seconds: dict[str, float]


def fit_models(
    modeling: DataFrame,
    configs: Sequence[ModelConfig] = MODEL_CONFIGS,
    workers: int = 4,
    partitions: int | None = None,
) -> FittedModels:
    """Fit the configurations and predict validation and test rows.

    All linear models come from one set of sums; each one's seconds are those of the sums
    and the solutions together.  Trees are fitted side by side on one cached train frame.
    """
    kinds = {c.name: penalty(c) for c in configs}
    alphas = {name: alpha for name, alpha in kinds.items() if alpha is not None}
    trees = [(c, build_regressor(c)) for c in configs if kinds[c.name] is None]
    train = modeling.where("split = 'train'")
    models: dict[str, object] = {}
    seconds: dict[str, float] = {}
    parts = []
    if alphas:
        design = design_of(train)
        start = time.perf_counter()
        fits = fit_pooled(train, alphas, design)
        models.update(fits)
        seconds.update(dict.fromkeys(alphas, time.perf_counter() - start))
        parts.append(pooled_predictions(modeling, fits))
    if trees:
        preparation = prepare(train)
        grown, took = _grow(preparation.apply(train), trees, workers, partitions)
        models.update(grown)
        seconds.update(took)
        prepared = preparation.apply(modeling)
        parts += [predictions_of(model, prepared, name) for name, model in grown.items()]
    return FittedModels({c.name: models[c.name] for c in configs}, concat_all(parts), {c.name: seconds[c.name] for c in configs})


def _grow(prepared: DataFrame, trees: Sequence[tuple], workers: int, partitions: int | None) -> tuple[dict, dict]:
    """Tree models and their seconds.

    The train rows are dealt by tag and ordered in each partition: a forest's bootstrap
    is seeded per partition, so its result follows from their number, by default one per
    TREE_ROWS rows and at least four, and not from how the input happens to be cut.
    Spark runs the fits' jobs concurrently; a lost executor only costs the recomputation
    of its cached blocks.
    """
    number = partitions or max(4, ceil(prepared.count() / TREE_ROWS))
    train = (
        prepared.repartition(number, "tag_type", "tag")
        .sortWithinPartitions("tag_type", "tag", "date")
        .select("features", F.col(TARGET).cast("double").alias(TARGET))
        .persist()
    )
    try:
        train.count()

        def fit(tree: tuple):
            start = time.perf_counter()
            model = tree[1].fit(train)
            return tree[0].name, model, time.perf_counter() - start

        with ThreadPoolExecutor(max_workers=max(1, min(workers, len(trees)))) as pool:
            fitted = list(pool.map(fit, trees))
    finally:
        train.unpersist()
    return {name: model for name, model, _ in fitted}, {name: took for name, _, took in fitted}


def training_times(
    spark: SparkSession, seconds: Mapping[str, float], run_label: str, rows_train: int, feature_set: str = "count_only"
) -> DataFrame:
    """One row per model with its fit seconds."""
    rows = [
        (run_label, name, float(s), feature_set, int(rows_train), len(NUMERIC_FEATURES))
        for name, s in seconds.items()
    ]
    return spark.createDataFrame(
        rows,
        "run_label string, model string, train_seconds double, feature_set string, "
        "rows_train long, num_numeric_features int",
    )


def category_labels(encoder: PipelineModel, column: str) -> list[str]:
    """The categories of a column in slot order."""
    indexer = encoder.stages[0]
    return list(indexer.labelsArray[indexer.getInputCols().index(column)])


def category_totals(encoder: PipelineModel, df: DataFrame, column: str) -> DataFrame:
    """``category, rows``: how often each one-hot slot of a column is set; unknown ones set none."""
    names = F.array(*[F.lit(label) for label in category_labels(encoder, column)])
    slot = F.array_position(vector_to_array(f"{column}_slots"), 1.0)
    counted = encoder.transform(df).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where("slot > 0").select(
        F.get(names, F.col("slot").cast("int") - 1).alias("category"), "rows"
    )
