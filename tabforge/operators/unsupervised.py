"""Cluster labels and principal components as features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Columns as one vector, replacing an earlier one; names with special characters are allowed."""
    safe = {c: f"_v{i}" for i, c in enumerate(columns)}
    plain = df.drop(output).withColumns({s: F.col(f"`{c}`").cast("double") for c, s in safe.items()})
    out = VectorAssembler(inputCols=list(safe.values()), outputCol=output, handleInvalid="keep").transform(plain)
    return out.drop(*safe.values())


class Clusters:
    """K-means labels ``cluster_k`` for several k."""

    def __init__(self, models: dict[int, KMeansModel]):
        self.models = models

    @classmethod
    def fit(cls, df: DataFrame, features: str, minimum: int, maximum: int, increment: int = 1, seed: int = 0) -> Clusters:
        models = {}
        for k in range(minimum, maximum + 1, increment):
            models[k] = KMeans(
                k=k, seed=seed, initMode="random", featuresCol=features, predictionCol=f"cluster_{k}").fit(df)
        return cls(models)

    @property
    def names(self) -> list[str]:
        return [f"cluster_{k}" for k in self.models]

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self.models.values():
            df = m.transform(df)
        return df


class Components:
    """Principal component scores ``pca_n_j``; the input has mean zero.

    One decomposition at the largest n serves all smaller ones.
    """

    def __init__(self, model: PCAModel, sizes: Sequence[int], deviations: Sequence[float]):
        self.model, self.sizes, self.deviations = model, list(sizes), list(deviations)

    @classmethod
    def fit(cls, df: DataFrame, features: str, minimum: int, maximum: int, increment: int = 1, whiten: bool = False) -> Components:
        sizes = list(range(minimum, maximum + 1, increment))
        model = PCA(k=max(sizes), inputCol=features, outputCol="_scores").fit(df)
        deviations = [1.0] * max(sizes)
        if whiten:
            scores = model.transform(df).select(vector_to_array("_scores").alias("s"))
            row = scores.agg(*[F.stddev_samp(F.get("s", F.lit(i))).alias(f"d{i}") for i in range(max(sizes))]).first()
            deviations = [row[f"d{i}"] or 1.0 for i in range(max(sizes))]
        return cls(model, sizes, deviations)

    @property
    def names(self) -> list[str]:
        return [f"pca_{n}_{j}" for n in self.sizes for j in range(1, n + 1)]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df).withColumn("_scores", vector_to_array("_scores"))
        cols = {
            f"pca_{n}_{j}": F.get("_scores", F.lit(j - 1)) / F.lit(self.deviations[j - 1])
            for n in self.sizes for j in range(1, n + 1)
        }
        return out.withColumns(cols).drop("_scores")
