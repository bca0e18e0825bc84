"""A linear model of hashed features by stochastic gradient descent, in parallel over partitions with averaged weights.

It shares nothing with the MLlib pipeline: features are hashed by their own rule, lags and target go through log1p, and the weights are
learnt row by row. Every epoch each partition starts from the same weights; the epoch's weights are the mean over partitions, weighted
by rows. Of the epochs the one with the least error on the choosing span is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Places of hashed features.
SIZE = 2048


def hashed(words: list[str], numbers: dict[str, Column], size: int = SIZE) -> list[Column]:
    """Two columns: places and values of a row's hashed features. A word's place is that of name=value, its value 1; a number's that of its name."""
    places = [F.xxhash64(F.concat(F.lit(w + "="), F.col(w).cast("string"))) for w in words] + [F.xxhash64(F.lit(n)) for n in numbers]
    values = [F.lit(1.0) for _ in words] + [v.cast("double") for v in numbers.values()]
    return [F.array(*[F.pmod(p, F.lit(size)).cast("int") for p in places]).alias("places"), F.array(*values).alias("values")]


def log_record(lags: list[str]) -> dict[str, Column]:
    """Lags as log1p, negative ones as 0: a transform without state."""
    return {f"log_{c}": F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in lags}


def _predict(b: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    at, v = np.stack(b["places"].to_numpy()), np.stack(b["values"].to_numpy())
    return (w[at] * v).sum(axis=1) + w[-1]


def fit(rows: DataFrame, train: Column, choose: Column, target: str, epochs: int = 3, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, int]:
    """Weights (the last one is the constant) and the chosen epoch. rows: places, values, and the target, whose log1p is learnt."""
    data = rows.select("places", "values", F.log1p(F.greatest(F.col(target).cast("double"), F.lit(0.0))).alias("y"), train.alias("t"), choose.alias("c"))
    w = np.zeros(SIZE + 1)
    best = (float("inf"), w, -1)
    for epoch in range(epochs):

        def run(batches: Iterator[pd.DataFrame], start: np.ndarray = w, epoch: int = epoch) -> Iterator[pd.DataFrame]:
            u, n = start.tolist(), 0
            for b in batches:
                places, values, y = np.stack(b["places"].to_numpy()).tolist(), np.stack(b["values"].to_numpy()), b["y"].tolist()
                norms, values = (1.0 + (values**2).sum(axis=1)).tolist(), values.tolist()
                for k in np.random.default_rng(epoch).permutation(len(b)).tolist():
                    at, v = places[k], values[k]
                    off = sum([u[i] * x for i, x in zip(at, v)]) + u[-1] - y[k]
                    step = rate / (1.0 + epoch + n / 10_000) ** 0.25 * max(-10.0, min(10.0, off)) / norms[k]
                    for i, x in zip(at, v):
                        u[i] -= step * x + l2 * rate * u[i]
                    u[-1] -= step
                    n += 1
            if n:
                yield pd.DataFrame({"n": [n], "w": [u]})

        # a row per partition; summed on the executors, so the driver gets one
        parts = data.where("t").select("places", "values", "y").mapInPandas(run, "n long, w array<double>")
        whole = parts.select("n", F.posexplode("w").alias("at", "x")).groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).collect()
        if not whole:
            break
        w = np.zeros(SIZE + 1)
        for r in whole:
            w[r["at"]] = r["x"]
        error = predicted(data.where("c"), w, "p").agg(F.avg(F.pow(F.col("p") - F.expm1("y"), 2)).alias("e")).first()["e"]
        if error is not None and error < best[0]:
            best = (error, w, epoch)
    return best[1], best[2]


def predicted(rows: DataFrame, w: np.ndarray, name: str) -> DataFrame:
    """Adds the prediction, on the target's own scale and at least 0."""
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: np.maximum(np.expm1(np.minimum(_predict(b, w), 20.0)), 0.0)}) if len(b) else b.assign(**{name: pd.Series(dtype=float)})

    return rows.mapInPandas(run, schema)
