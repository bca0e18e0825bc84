"""Demand models on a gap-free panel: features of the past only, splits by date, one test."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arith import r
from tessera.ml import sgd
from tessera.operators import relational as R
from tessera.session import cut

FEATURES = ["lag_1", "lag_7", "mean_7", "dow", "month", "year", "day_sin", "day_cos"]


def features(panel: DataFrame) -> DataFrame:
    """brand, region, day, units and features that don't see their own day; rows without a week of past are left out."""
    w = Window.partitionBy("brand", "region").orderBy("day")
    turn = F.lit(2) * F.pi() * F.dayofyear("day") / F.lit(365.25)
    out = panel.select(
        "brand", "region", "day", F.col("units").cast("double").alias("units"), F.lag("units", 1).over(w).cast("double").alias("lag_1"), F.lag("units", 7).over(w).cast("double").alias("lag_7"),
        F.avg("units").over(w.rowsBetween(-7, -1)).alias("mean_7"), F.dayofweek("day").cast("double").alias("dow"), F.month("day").cast("double").alias("month"), F.year("day").cast("double").alias("year"), F.sin(turn).alias("day_sin"), F.cos(turn).alias("day_cos"),
    )
    return out.where("lag_7 is not null and mean_7 is not null")


def split(df: DataFrame, train: float = 0.7, choose: float = 0.85) -> DataFrame:
    """Adds split: train, choose or test, by date; the dates are quantiles of the days between the first and the last."""
    ends = df.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    at = F.datediff("day", "a") / F.greatest(F.datediff("b", "a"), F.lit(1))
    return df.crossJoin(F.broadcast(ends)).withColumn("split", F.when(at < train, "train").when(at < choose, "choose").otherwise("test")).drop("a", "b")


def validate(data: DataFrame) -> None:
    """Raises where split data lack a column or a split, hold nulls or negative units, or give a key twice."""
    need = ["brand", "region", "day", "split", "units", *FEATURES]
    absent = [c for c in need if c not in data.columns]
    if absent:
        raise ValueError(f"demand: no column {', '.join(absent)}")
    bad = F.lit(False)
    for c in need:
        bad = bad | F.col(c).isNull()
    n = data.groupBy("brand", "region", "day").agg(F.count("*").alias("n"), F.count_if(bad).alias("nulls"), F.count_if(F.col("units") < 0).alias("negative"), F.collect_set("split").alias("splits"))
    got = n.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("nulls").alias("nulls"), F.sum("negative").alias("negative"), F.array_distinct(F.flatten(F.collect_set("splits"))).alias("splits")).first()
    wrong = [k for k in ("repeated", "nulls", "negative") if got[k]] + [f"no {x}" for x in ("train", "choose", "test") if x not in got.splits]
    if wrong:
        raise ValueError("demand: split data with " + ", ".join(wrong))


def _hashed(data: DataFrame) -> DataFrame:
    """Adds hashed: predictions of a model that shares nothing with the pipeline, see `ml.sgd`."""
    logs = sgd.log_record(["lag_1", "lag_7", "mean_7"])
    rows = data.select("*", *sgd.hashed(["brand", "region", "dow", "month", "year"], {**logs, "day_sin": F.col("day_sin"), "day_cos": F.col("day_cos")}))
    weights, _ = sgd.fit(rows, F.col("split") == "train", F.col("split") == "choose", "units")
    return sgd.predicted(rows, weights, "hashed").drop("places", "values")


def _predictions(panel: DataFrame) -> DataFrame:
    data = cut(split(features(panel)), "demand")
    validate(data)
    index = StringIndexer(inputCols=["brand", "region"], outputCols=["brand_no", "region_no"], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=["brand_no", "region_no"], outputCols=["brand_hot", "region_hot"])
    gather = VectorAssembler(inputCols=["brand_hot", "region_hot", *FEATURES], outputCol="features")
    models = {
        "linear": LinearRegression(labelCol="units", maxIter=30, regParam=0.05), "tree": DecisionTreeRegressor(labelCol="units", maxDepth=8, minInstancesPerNode=20),
        "forest": RandomForestRegressor(labelCol="units", numTrees=24, maxDepth=8, maxBins=64, seed=42),
    }
    prepared = Pipeline(stages=[index, hot, gather]).fit(data.where("split = 'train'")).transform(data)
    out = prepared.withColumn("lag7", F.col("lag_7"))
    for name, m in models.items():
        fitted = m.setPredictionCol(name).fit(prepared.where("split = 'train'"))
        out = fitted.transform(out)
    out = out.select("brand", "region", "day", "split", "units", *MODELS, *FEATURES, "lag7")
    return cut(_hashed(out).select("brand", "region", "day", "split", "units", *MODELS, "hashed", "lag7"), "predicted")


#: The models of the pipeline, of which one is chosen.
MODELS = ["linear", "tree", "forest"]


def _metrics(p: DataFrame) -> DataFrame:
    return R.error_metrics(p.unpivot(["split", "units"], [*MODELS, "hashed", "lag7"], "model", "p"), "units", "p", ["model", "split"])


def chosen(predictions: DataFrame) -> str:
    """The pipeline's model with the least error on the choosing span: by rmse, mae and name. The test span isn't read."""
    m = _metrics(predictions.where("split = 'choose'")).where(F.col("model").isin(MODELS))
    return m.orderBy("rmse", "mae", "model").first().model


def evaluate(panel: DataFrame) -> DataFrame:
    """model, split (choose, test), n, mae, rmse, mape, r2, chosen for linear, tree, forest, hashed and lag7.

    chosen marks the model picked on the choosing span, whose test row is the result; other test rows are to compare with and decide nothing.
    """
    p = _predictions(panel)
    name = chosen(p)
    return _metrics(p.where("split <> 'train'")).select("model", "split", "n", *[r(F.col(c)).alias(c) for c in ("mae", "rmse", "mape", "r2")], (F.col("model") == name).alias("chosen"))


def compare(panel: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Test rows with the chosen model's and the independent hashed model's prediction (floored at 0), the lag 7 baseline, difference,
    tolerance (of max(1, actual)) and whether they match."""
    p = _predictions(panel)
    name = chosen(p)
    p = p.where("split = 'test'")
    a = p.select("brand", "region", "day", "units", "lag7", F.greatest(name, F.lit(0.0)).alias("chosen"))
    b = p.select("brand", "region", "day", F.greatest("hashed", F.lit(0.0)).alias("hashed"))
    both = a.join(b, ["brand", "region", "day"], "full_outer")
    allowed, difference = F.greatest(F.lit(1.0), F.abs("units")) * tolerance, F.abs(F.col("chosen") - F.col("hashed"))
    return both.select(
        "brand", "region", "day", "units", F.lit(name).alias("chosen_model"), r(F.col("chosen")).alias("chosen"), r(F.col("hashed")).alias("hashed"), "lag7",
        r(difference).alias("difference"), r(allowed).alias("tolerance"), (difference <= allowed).alias("match"),
    )
