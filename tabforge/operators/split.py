"""Repeatable splits, folds, shuffles, resampling and class weights, all by key hash.

A row's place depends only on its key and the seed, so results stay the same
under any partitioning and when tasks run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.frame import quoted
from tabforge.plans.scale import BLOCK_ROWS, hash32, positions


def hash_share(key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) per key."""
    return hash32(key, seed) / float(2**32)


def train_test_split(df: DataFrame, key: str, test_share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    mark = hash_share(key, seed) < test_share
    return df.filter(~mark), df.filter(mark)


def add_folds(df: DataFrame, key: str, folds: int, seed: int = 0, name: str = "fold") -> DataFrame:
    return df.withColumn(name, (hash32(key, seed) % folds).cast("int"))


def add_stratified_folds(
    df: DataFrame, key: str, label: str, folds: int, seed: int = 0, name: str = "fold", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Folds dealt out in turn within each label, in hash order: sizes differ by at most one row."""
    dealt = positions(df.withColumn("_h", hash32(key, seed)), [label], [F.col("_h"), quoted(key)], "_turn", block_rows)
    return dealt.withColumn(name, ((F.col("_turn") - 1) % folds).cast("int")).drop("_h", "_turn")


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Whole rows in a repeatable random order (a range-partitioned sort)."""
    return df.orderBy(hash32(key, seed), key)


def mark_validation(df: DataFrame, key: str, share: float, seed: int = 0, name: str = "validation") -> DataFrame:
    """Flag the holdout rows that boosting watches for early stopping."""
    return df.withColumn(name, hash_share(key, seed) < share)


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def _per_class(label: str, values: dict) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(quoted(label) == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    return df.withColumn(name, _per_class(label, {k: total / (len(counts) * n) for k, n in counts.items()}))


def undersample(df: DataFrame, key: str, label: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Keep the smallest class and a share of the others so that small : large is about ``ratio``."""
    counts = class_counts(df, label)
    least = min(counts.values())
    keep = {k: min(1.0, least / (ratio * n)) for k, n in counts.items()}
    return df.filter(hash_share(key, seed) < _per_class(label, keep))


def oversample(df: DataFrame, key: str, label: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Repeat rows of smaller classes so that each reaches about ``ratio`` times the largest."""
    counts = class_counts(df, label)
    most = max(counts.values())
    times = _per_class(label, {k: max(1.0, ratio * most / n) for k, n in counts.items()})
    whole = F.floor(times)
    copies = (whole + F.when(hash_share(key, seed) < times - whole, 1).otherwise(0)).cast("int")
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
