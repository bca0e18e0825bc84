"""Demand models: all of them are fitted, one is chosen before the test, the split data are checked."""

import pytest
from pyspark.sql import functions as F

from tessera.ml import demand
from tessera.plans import registry


def test_one_model_is_chosen_before_the_test(spark, folder):
    rows = registry.QUERIES["demand_model_eval"](spark, folder).collect()
    assert {r.model for r in rows} == {"linear", "tree", "forest", "hashed", "lag7"}
    best = min((r.rmse, r.mae, r.model) for r in rows if r.split == "choose" and r.model in ("linear", "tree", "forest"))[2]
    assert {r.model for r in rows if r.chosen} == {best}
    both = registry.QUERIES["model_comparison"](spark, folder)
    assert {r.chosen_model for r in both.select("chosen_model").distinct().collect()} == {best}
    assert both.where("chosen is null or hashed is null or match <> (difference <= tolerance)").count() == 0


def test_split_data_are_checked(spark):
    row = spark.range(9).select(F.lit("a").alias("brand"), F.lit("b").alias("region"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"), F.lit(1.0).alias("units"), *[F.lit(1.0).alias(c) for c in demand.FEATURES])
    good = demand.split(row)
    demand.validate(good)
    for bad in (good.union(good), good.withColumn("units", F.lit(-1.0)), good.withColumn("lag_7", F.lit(None).cast("double")), good.where("split <> 'test'"), good.drop("month")):
        with pytest.raises(ValueError, match="demand"):
            demand.validate(bad)


def test_hashed_model_learns_by_descent(spark):
    """A rule that the features can express is learnt, better each epoch than the constant, and no row of the test span is read."""
    import numpy as np

    from tessera.ml import sgd

    df = spark.range(6000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("w"), (F.rand(1) * 20).alias("lag"))
    df = df.withColumn("y", F.greatest(F.lit(0.0), 3 * (F.col("id") % 7) + F.col("lag"))).withColumn("s", F.when(F.col("id") < 4000, "train").when(F.col("id") < 5000, "choose").otherwise("test"))
    rows = df.select("*", *sgd.hashed(["w"], sgd.log_record(["lag"])))
    weights, epoch = sgd.fit(rows, F.col("s") == "train", F.col("s") == "choose", "y")
    assert epoch >= 0 and np.isfinite(weights).all()
    e = sgd.predicted(rows.where("s = 'test'"), weights, "p").agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("e"), F.stddev("y").alias("d")).first()
    assert e.e < 0.6 * e.d
    none, epoch = sgd.fit(rows.limit(0), F.col("s") == "train", F.col("s") == "choose", "y")
    assert epoch == -1 and not none.any()


def test_models_are_saved_and_found_again(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tessera.ml import store

    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + 1).cast("double").alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")]).fit(df)
    root = str(tmp_path)
    assert store.latest(spark, root).count() == 0
    assert [store.save(model, root, "demand", m) for m in (0.5, 0.25)] == [1, 2] and store.save(model, root, "other", 1.0) == 1
    assert {(r.name, r.version, r.metric) for r in store.latest(spark, root).collect()} == {("demand", 2, 0.25), ("other", 1, 1.0)}
    a, b = model.transform(df).select("prediction").collect(), store.load(spark, root, "demand").transform(df).select("prediction").collect()
    assert a == b
    with pytest.raises(KeyError):
        store.load(spark, root, "nothing")
