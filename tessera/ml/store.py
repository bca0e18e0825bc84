"""Fitted pipelines on disk: each version in a folder of its own, with a register of what was fitted and how well."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTER = "name string, version int, metric double, fitted_at timestamp"


def register(spark: SparkSession, root: str) -> DataFrame:
    """Every saved model: name, version, metric, fitted_at; empty where nothing was saved."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(REGISTER).parquet(f"{root}/register")
    except AnalysisException:
        return spark.createDataFrame([], REGISTER)


def save(model: PipelineModel, root: str, name: str, metric: float) -> int:
    """Saves a pipeline as the next version of its name; a version is never overwritten."""
    spark = SparkSession.active()
    last = register(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
    model.write().save(f"{root}/{name}/{last + 1}")
    row = spark.createDataFrame([(name, last + 1, float(metric))], "name string, version int, metric double").withColumn("fitted_at", F.current_timestamp())
    row.write.mode("append").parquet(f"{root}/register")
    return last + 1


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of each name."""
    return register(spark, root).groupBy("name").agg(F.max_by(F.struct("version", "metric", "fitted_at"), "version").alias("v")).select("name", "v.*")


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> PipelineModel:
    """A version of a model, the newest if none is given. KeyError where there is none."""
    rows = register(spark, root).where(F.col("name") == name)
    one = (rows.where(F.col("version") == version) if version else rows).agg(F.max("version")).first()[0]
    if one is None:
        raise KeyError(f"{name}: no such model below {root}")
    return PipelineModel.load(f"{root}/{name}/{one}")
