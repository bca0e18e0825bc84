"""A classifier of next month's wastage: features of the past, label by the training span's quantile, one chronological test."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arith import r, ratio
from tessera.session import cut

RAW = ["rate", "prepared", "wasted", "rate_before", "prepared_before", "wasted_before", "rate_2", "mean_3", "month_no", "year", "age"]

LAGGED = ("rate_before", "prepared_before", "wasted_before", "rate_2", "mean_3")


def features(lines: DataFrame) -> DataFrame:
    """lines: item, month (date), prepared, wasted. Adds lagged rates; next_rate is the following row's rate of the item."""
    w = Window.partitionBy("item").orderBy("month")
    per = lines.groupBy("item", "month").agg(F.sum("prepared").cast("double").alias("prepared"), F.sum("wasted").cast("double").alias("wasted")).withColumn("rate", ratio("wasted", "prepared"))
    return per.select(
        "item", "month", "rate", "prepared", "wasted", F.lag("rate").over(w).alias("rate_before"), F.lag("prepared").over(w).alias("prepared_before"), F.lag("wasted").over(w).alias("wasted_before"), F.lag("rate", 2).over(w).alias("rate_2"), F.avg("rate").over(w.rowsBetween(-3, -1)).alias("mean_3"),
        F.month("month").cast("double").alias("month_no"), F.year("month").cast("double").alias("year"), F.row_number().over(w).cast("double").alias("age"), F.lead("rate").over(w).alias("next_rate"),
    )


def evaluate(lines: DataFrame, least_accuracy: float = 0.85, least_f1: float = 0.8, trees: int = 96, depth: int = 10) -> DataFrame:
    """split, n, accuracy, macro_f1, auc (area under the ROC curve), accepted (on the test span, against the limits). Rows without a next month aren't scored."""
    data = features(lines).where("next_rate is not null")
    ends = data.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    at = F.datediff("month", "a") / F.greatest(F.datediff("b", "a"), F.lit(1))
    data = data.crossJoin(F.broadcast(ends)).withColumn("split", F.when(at < 0.7, "train").when(at < 0.85, "choose").otherwise("test")).drop("a", "b")
    limit = data.where("split = 'train'").agg(F.percentile("next_rate", F.lit(0.75)).alias("limit"))
    data = data.crossJoin(F.broadcast(limit)).withColumn("label", (F.col("next_rate") >= F.col("limit")).cast("double"))
    data = cut(data.withColumns({f"{c}_absent": F.col(c).isNull().cast("double") for c in LAGGED}), "waste")
    share = data.where("split = 'train'").agg(F.avg("label").alias("p"))
    data = data.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col("label") == 1, 0.5 / F.greatest("p", F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - F.col("p"), F.lit(1e-6))))
    fill = Imputer(strategy="median", inputCols=RAW, outputCols=[f"{c}_f" for c in RAW])
    gather = VectorAssembler(inputCols=[f"{c}_f" for c in RAW] + [f"{c}_absent" for c in LAGGED], outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=42)
    scored = Pipeline(stages=[fill, gather, forest]).fit(data.where("split = 'train'")).transform(data).select("split", "label", "prediction", vector_to_array("probability")[1].alias("p"))
    c = lambda a, b: F.count_if((F.col("label") == a) & (F.col("prediction") == b))
    m = scored.groupBy("split").agg(F.count("*").alias("n"), c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    f1 = (ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")) + ratio(F.col("tn") * 2, F.col("tn") * 2 + F.col("fp") + F.col("fn"))) / 2
    m = m.withColumns({"accuracy": r((F.col("tp") + F.col("tn")) / F.col("n")), "macro_f1": r(f1)})
    # area under the curve from a histogram of scores: pairs of a high and a low row in order, ties as half
    h = scored.groupBy("split", F.round("p", 4).alias("p")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("split").orderBy("p")) - F.col("neg")  # at most 10,001 rows a split
    auc = h.withColumn("pairs", F.col("pos") * (below + F.col("neg") / 2)).groupBy("split").agg(r(ratio(F.sum("pairs"), F.sum("pos") * F.sum("neg"))).alias("auc"))
    return m.join(auc, "split").select("split", "n", "accuracy", "macro_f1", "auc", ((F.col("split") == "test") & ((F.col("accuracy") >= least_accuracy) | (F.col("macro_f1") >= least_f1))).alias("accepted"))
