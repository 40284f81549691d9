"""CSV and parquet readers and writers."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.quality import check_columns
from shelfcast.schemas import PREDICTION_TABLES, RAW, TRAINING_TABLES


def scan_csv(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Read one CSV with its declared schema; a missing file or column raises."""
    schema = RAW[name]
    path = f"{folder.rstrip('/')}/{name}.csv"
    try:
        header = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    check_columns(header, name, schema.fieldNames())
    # Columns are matched by position, so the schema follows the file's header.
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    ddl = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header.columns)
    return (
        spark.read.schema(ddl)
        .option("header", True)
        .option("mode", "FAILFAST")  # a value that does not parse raises
        .csv(path)
        .select(*schema.fieldNames())
    )


def load_bundle(spark: SparkSession, folder: str, predict: bool = False) -> dict[str, DataFrame]:
    """All raw tables as DataFrames and temporary views; predict mode skips the panel."""
    names = PREDICTION_TABLES if predict else TRAINING_TABLES
    tables = {name: scan_csv(spark, name, folder) for name in names}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def write_csv(df: DataFrame, name: str, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_processed(train: DataFrame, test: DataFrame, folder: str) -> None:
    train.write.mode("overwrite").parquet(f"{folder}/train_processed.parquet")
    test.write.mode("overwrite").parquet(f"{folder}/test_processed.parquet")


def save_merged(train: DataFrame, test: DataFrame, folder: str) -> None:
    train.write.mode("overwrite").parquet(f"{folder}/train_merged.parquet")
    test.write.mode("overwrite").parquet(f"{folder}/test_merged.parquet")


def save_features(features: DataFrame, horizon: int, folder: str) -> str:
    path = f"{folder}/train_features_d{horizon}.parquet"
    features.write.mode("overwrite").parquet(path)
    return path


def save_metrics(
    family_metrics: DataFrame, store_metrics: DataFrame, horizon: int, folder: str
) -> None:
    family_metrics.write.mode("overwrite").parquet(f"{folder}/family_metrics_h{horizon}.parquet")
    store_metrics.write.mode("overwrite").parquet(f"{folder}/store_metrics_h{horizon}.parquet")


def save_cv(results: DataFrame, horizon: int, folder: str) -> str:
    """Metrics of the folds of a training run, beside its model."""
    path = f"{folder}/h{horizon}/cv_metrics"
    results.write.mode("overwrite").parquet(path)
    return path


def save_partition(df: DataFrame, folder: str, name: str, horizon: int, run_date: dt.date | None = None) -> str:
    """Features or predictions as one table partitioned by ``horizon`` and ``run_date``.

    Only the partition at hand is replaced, whatever else the table holds; readers
    that name a horizon or a day list no other folder.
    """
    path = f"{folder.rstrip('/')}/{name}"
    keys = {"horizon": F.lit(horizon), "run_date": F.lit(run_date or dt.date.today())}
    (
        df.withColumns(keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    return path


def save_forecast(
    forecast: DataFrame, horizon: int, folder: str, run_date: dt.date | None = None
) -> str:
    """One dated folder per horizon and run."""
    day = (run_date or dt.date.today()).strftime("%Y%m%d")
    kind = "daily" if horizon == 7 else "monthly"
    path = f"{folder}/predictions_{kind}_{day}.parquet"
    forecast.write.mode("overwrite").parquet(path)
    return path


def save_state(
    folder: str, horizon: int, tables: dict[str, DataFrame], model: PipelineModel | None = None
) -> str:
    """Model and the tables a forecast needs (statistics, ranking, codes)."""
    path = f"{folder}/h{horizon}"
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_state(
    spark: SparkSession, folder: str, horizon: int, names: list[str], with_model: bool = True
) -> tuple[PipelineModel | None, dict[str, DataFrame]]:
    path = f"{folder}/h{horizon}"
    model = PipelineModel.load(f"{path}/model") if with_model else None
    return model, {name: spark.read.parquet(f"{path}/{name}") for name in names}
