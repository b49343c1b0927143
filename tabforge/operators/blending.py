"""Combining the predictions of several models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.frame import add, quoted


def blend_probabilities(df: DataFrame, columns: Sequence[str], proba: str = "proba", pred: str = "pred") -> DataFrame:
    """Mean probability, and its rounding (half to even) as the label."""
    mean = add([quoted(c) for c in columns]) / len(columns)
    return df.withColumn(proba, mean).withColumn(pred, F.rint(F.col(proba)).cast("int"))


def blend_classes(df: DataFrame, columns: Sequence[str], pred: str = "pred") -> DataFrame:
    """The class that most models predict, the smallest among equals."""
    votes = F.array(*[quoted(c).cast("double") for c in columns])
    ranked = F.transform(votes, lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), v.alias("c")))
    return df.withColumn(pred, F.array_min(ranked)["c"])


def blend_class_probabilities(df: DataFrame, columns: Sequence[str], proba: str = "proba") -> DataFrame:
    """Mean of arrays of class probabilities, class by class."""
    parts = F.array(*[quoted(c) for c in columns])
    places = F.sequence(F.lit(0), F.size(quoted(columns[0])) - 1)
    mean = F.transform(places, lambda k: F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.get(p, k)) / len(columns))
    return df.withColumn(proba, mean)


def blend_predictions(df: DataFrame, columns: Sequence[str], pred: str = "pred", rounded: bool = False) -> DataFrame:
    """Mean prediction; ``rounded`` gives the nearest integer (half to even)."""
    mean = add([quoted(c).cast("double") for c in columns]) / len(columns)
    return df.withColumn(pred, F.rint(mean) if rounded else mean)
