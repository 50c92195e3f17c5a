"""Model scoring and training jobs: models are small and broadcast, events stay distributed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Dense:
    """A feed-forward network: (weights, bias) per layer, ReLU between, softmax or linear at the end."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    softmax: bool = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0.0)
        if self.softmax:
            x = np.exp(x - x.max(axis=1, keepdims=True))
            x = x / x.sum(axis=1, keepdims=True)
        return x


def dense_scores(df: DataFrame, features: list[str], model: Dense, name: str) -> DataFrame:
    """Network outputs as an array column, computed per Arrow batch; missing inputs give NULL.

    The weights travel once per executor as a broadcast variable.
    """
    return _scored(df, features, [model], F.lit(0), name)


def _scored(df: DataFrame, features: list[str], models: list[Dense], which: Column, name: str) -> DataFrame:
    """Outputs of the model that ``which`` numbers; each network sees its own rows only."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        nets = shared.value
        for number, batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(features)))
            good, number = ~np.isnan(x).any(axis=1), number.to_numpy()
            out = np.full(len(batch), None, dtype=object)
            for i, net in enumerate(nets):
                mine = np.flatnonzero(good & (number == i))
                if len(mine):
                    out[mine] = list(net(x[mine]))
            yield pd.Series(out)

    udf = F.pandas_udf(score, "array<double>")
    inputs = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    return df.withColumn(name, udf(which.cast("int"), inputs))


def parity_scores(df: DataFrame, key: str, features: list[str], even: Dense, odd: Dense, name: str) -> DataFrame:
    """Each event is scored by the model trained on the other half of the events."""
    return _scored(df, features, [odd, even], F.pmod(F.col(key), F.lit(2)), name)


def bdt_train(df: DataFrame, features: list[str], label: str, trees: int = 800, depth: int = 5,
              step: float = 0.05, subsample: float = 0.5, bins: int = 500, seed: int = 10):
    """Gradient-boosted trees with Spark ML; defaults follow the usual analysis settings."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    prepared = VectorAssembler(inputCols=features, outputCol="__x").transform(df.dropna(subset=[*features, label]))
    model = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step,
                          subsamplingRate=subsample, maxBins=bins, seed=seed)
    return model.fit(prepared)


def _vector_scores(df: DataFrame, features: list[str], model, name: str, defaults: dict[str, float]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    filled = df.withColumns({f"__d_{f}": F.coalesce(F.col(f).cast("double"), F.lit(float(defaults.get(f, 0.0)))) for f in features})
    x = VectorAssembler(inputCols=[f"__d_{f}" for f in features], outputCol="__x").transform(filled)
    out = model.transform(x).withColumn(name, vector_to_array("probability"))
    return out.select(*df.columns, name)


def bdt_scores(df: DataFrame, features: list[str], model, name: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """Signal probability of a boosted model; a missing feature takes its default."""
    return _vector_scores(df, features, model, "__p", defaults or {}).withColumn(name, F.get("__p", F.lit(1))).drop("__p")


def forest_train(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 8, seed: int = 6):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    prepared = VectorAssembler(inputCols=features, outputCol="__x").transform(df.dropna(subset=[*features, label]))
    return RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(prepared)


def forest_scores(df: DataFrame, category: Column, models: dict[int, tuple[object, list[str]]], classes: int,
                  name: str, missing: float = -99.9) -> DataFrame:
    """Class probabilities from the category's own forest; the sentinel where it cannot be evaluated.

    One pass: forests stand side by side in one projection, and a row picks its own.
    """
    out, found = df.withColumn("__c", category), []
    result = F.when(F.lit(False), F.array(*[F.lit(missing)] * classes))
    for c, (model, features) in models.items():
        ok = F.col("__c") == c
        for f in features:
            ok = ok & F.col(f).isNotNull()
        found.append(f"__p_{len(found)}")
        out = _vector_scores(out, features, model, found[-1], {})
        result = result.when(ok, F.col(found[-1]))
    return out.withColumn(name, result.otherwise(F.array(*[F.lit(missing)] * classes))).drop("__c", *found)


def minmax(df: DataFrame, features: list[str]) -> DataFrame:
    """Every feature scaled to 0..1 by its global range; a constant feature becomes NULL.

    The ranges are one row, so they go into the plan as literals.
    """
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(stats[f"{c}_lo"]), F.lit(stats[f"{c}_hi"]) - F.lit(stats[f"{c}_lo"]))
                           for c in features})
