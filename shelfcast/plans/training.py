"""Boosted trees on the feature table: folds, final fit, importance, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.config import SETTINGS, TARGET, Settings
from shelfcast.functions.metrics import metric_columns
from shelfcast.operators.evaluate import report_table, report_views
from shelfcast.operators.folds import (
    holdout_split,
    sample_weights,
    walk_forward_folds,
)
from shelfcast.operators.quality import check_features
from shelfcast.plans.features import feature_columns


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters by the names the Spark estimator has for them."""

    rounds: int
    step: float
    depth: int
    min_rows: int
    loss: str
    bins: int = 255
    seed: int = 42
    patience: int = 150


# Fixed values of the two models. Leaves become a depth (63 leaves: 6, 31
# leaves: 5); the robust loss of the monthly model has no counterpart in Spark,
# so it uses the absolute loss as well.
PARAMS = {
    7: TreeParams(rounds=1500, step=0.05, depth=6, min_rows=20, loss="absolute"),
    30: TreeParams(rounds=1000, step=0.01, depth=5, min_rows=100, loss="absolute"),
}


def prepare(features: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Weights added, and numbers where trees need one (a single value has no deviation)."""
    df = sample_weights(features, settings=settings)
    return df.fillna(0.0, subset=[c for c, t in df.dtypes if t == "double"])


def estimator(params: TreeParams, rounds: int | None = None) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol=TARGET,
        predictionCol="y_pred",
        weightCol="weight",
        lossType=params.loss,
        maxIter=rounds or params.rounds,
        stepSize=params.step,
        maxDepth=params.depth,
        maxBins=params.bins,
        minInstancesPerNode=params.min_rows,
        seed=params.seed,
        checkpointInterval=10,
    )


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features")


def best_round(losses: list[float], patience: int) -> int:
    """Rounds up to the least loss; the search ends after ``patience`` rounds without a lower one.

    Ties go to the earlier round. No losses give 0.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return min(best + 1, len(losses))


def vectors(prepared: DataFrame, columns: list[str]) -> DataFrame:
    """What every fit reads: the day, the assembled features, the target and the weight."""
    return assembler(columns).transform(prepared).select("date", "features", TARGET, "weight")


def truncated(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first ``rounds`` trees, which is what a fit with fewer rounds gives."""
    java, gateway = model._java_obj, SparkContext._gateway
    package = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(package.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], java.treeWeights()[:rounds])):
        trees[i], weights[i] = tree, weight
    shorter = package.GBTRegressionModel(java.uid(), trees, weights)
    return (
        GBTRegressionModel(shorter)
        .setFeaturesCol(model.getFeaturesCol())
        .setPredictionCol(model.getPredictionCol())
    )


def fit_fold(rows: DataFrame, fold: dict, params: TreeParams) -> tuple[GBTRegressionModel, int, DataFrame]:
    """Fit on the training days of a fold, with the rounds that its validation days choose.

    Spark's own early stop ends at the first round without a gain, so all rounds are
    fitted once and their losses on the validation rows decide how many trees stay.
    ``rows`` are ``vectors``. Returns the model, the number of rounds kept and the
    scored validation rows.
    """
    known = rows.where(F.col("date") < fold["val_start"])
    held = rows.where(F.col("date").between(fold["val_start"], fold["val_end"]))
    model = estimator(params).fit(known)
    kept = best_round(model.evaluateEachIteration(held, params.loss), params.patience)
    if kept < model.getNumTrees:
        model = truncated(model, kept)
    return model, kept, model.transform(held)


def train_cv(rows: DataFrame, params: TreeParams, settings: Settings = SETTINGS) -> tuple[list[dict], int]:
    """Metrics per fold and the mean of the best rounds. One distributed fit per fold of ``vectors``."""
    results, rounds = [], []
    for row in walk_forward_folds(rows, settings).orderBy("fold").collect():
        fold = row.asDict()
        _, kept, val = fit_fold(rows, fold, params)
        metrics = val.agg(*metric_columns(TARGET, "y_pred")).first().asDict()
        results.append({**fold, **metrics, "rounds": kept})
        rounds.append(kept)
    return results, int(sum(rounds) / len(rounds))


def cv_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    """The few fold results as a table."""
    schema = (
        "fold int, train_start date, train_end date, val_start date, val_end date, "
        "n_train bigint, n_val bigint, rmse double, mae double, mape double, rmsle double, "
        "wape double, rounds int"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in results], schema)


def fit_final(
    prepared: DataFrame,
    columns: list[str],
    params: TreeParams,
    rounds: int,
    settings: Settings = SETTINGS,
    rows: DataFrame | None = None,
) -> PipelineModel:
    """All rows before the holdout, a fixed number of rounds. ``rows`` are ``vectors`` written before."""
    step = assembler(columns)
    train, _ = holdout_split(vectors(prepared, columns) if rows is None else rows, settings)
    return PipelineModel(stages=[step, estimator(params, rounds).fit(train)])


def model_columns(prepared: DataFrame) -> list[str]:
    return [c for c in feature_columns(prepared) if c != "weight"]


def train(
    prepared: DataFrame,
    horizon: int,
    params: TreeParams | None = None,
    settings=SETTINGS,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[PipelineModel, list[dict], int]:
    """Cross-validation, then the final fit with the rounds it found.

    ``stage`` may write the vectors and read them back: every fit reads them.
    """
    params = params or PARAMS[horizon]
    columns = model_columns(prepared)
    rows = stage(vectors(prepared, columns))
    results, rounds = train_cv(rows, params, settings)
    return fit_final(prepared, columns, params, rounds, settings, rows), results, rounds


def importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Importance of each feature and its share in percent."""
    step, trees = model.stages
    vector = spark.createDataFrame([(trees.featureImportances,)], ["v"])
    names = F.array(*[F.lit(c) for c in step.getInputCols()])
    pairs = F.explode(F.arrays_zip(names.alias("feature"), vector_to_array("v").alias("importance")))
    # a model of few trees has no entry for features after the last it uses
    share = F.coalesce("p.importance", F.lit(0.0)).alias("importance")
    table = vector.select(pairs.alias("p")).select("p.feature", share)
    total = table.agg(F.sum("importance")).scalar()
    return table.withColumn("importance_pct", F.round(F.try_divide(F.col("importance"), total) * 100, 2))


def predictor(model: PipelineModel):
    """The function a forecast takes. Checks that no feature of the model is missing."""
    columns = model.stages[0].getInputCols()

    def predict(df: DataFrame) -> DataFrame:
        check_features(df, columns)
        numbers = [c for c, t in df.dtypes if t == "double"]
        return model.transform(df.fillna(0.0, subset=numbers))

    return predict


def evaluate_all(
    prepared: DataFrame,
    model: PipelineModel,
    settings=SETTINGS,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict:
    """Every report on the holdout: overall, by family (twice), store and date, and importance.

    The first five come from one pass over the scored rows; ``stage`` may write its
    result, which has a row per group, and read it back.
    """
    _, holdout = holdout_split(prepared, settings)
    reports = report_views(stage(report_table(model.transform(holdout))))
    return {**reports, "importance": importance(model, prepared.sparkSession)}


def all_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """The reports of ``evaluate_all`` as one table: the report, its key as text, and its columns."""
    keys = {"family": "family", "family_log_wape": "family", "store": "store_nbr", "date": "date", "importance": "feature"}
    named = [
        df.select(
            F.lit(name).alias("report"),
            F.col(keys[name]).cast("string").alias("key") if name in keys else F.lit("all").alias("key"),
            *[c for c in df.columns if c != keys.get(name)],
        )
        for name, df in reports.items()
    ]
    table = named[0]
    for df in named[1:]:
        table = table.unionByName(df, allowMissingColumns=True)
    return table
