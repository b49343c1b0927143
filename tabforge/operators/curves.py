"""Tables behind charts: histograms, box statistics, calibration, series, grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.frame import quoted
from tabforge.operators.split import hash_share
from tabforge.plans.scale import exact_quantiles, grouped_quantiles


def calibration_curve(df: DataFrame, y: str, proba: str, bins: int = 10) -> DataFrame:
    """Per probability bin: rows, mean prediction and fraction of positives.

    Bins have equal width; a value on an inner edge belongs to the lower bin.
    """
    place = F.greatest(F.ceil(F.col(proba) * bins) - 1, F.lit(0)).cast("int")
    return df.filter(F.col(y).isNotNull()).groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(proba).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"))


def bin_number(x: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin of a value, 0-based; the maximum falls into the last bin."""
    width = (high - low) / bins if high > low else 1.0
    return F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")


def freedman_diaconis_bins(df: DataFrame, column: str) -> int:
    """Number of bins by the Freedman-Diaconis rule, at least one."""
    q = exact_quantiles(df, [column], [0.25, 0.75])[column]
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    width = 2 * (q[1] - q[0]) / n ** (1 / 3) if n else 0
    return max(1, math.ceil((high - low) / width)) if width else 1


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin, optionally within facets."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    x = quoted(column).cast("double")
    counted = df.filter(x.isNotNull()).groupBy(*by, bin_number(x, low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    return counted.withColumn("left", F.lit(low) + F.col("bin") * width).withColumn("right", F.lit(low) + (F.col("bin") + 1) * width)


def facet_histogram(df: DataFrame, column: str, row: str, col: str) -> DataFrame:
    """Histogram per facet; the rule's bin count is used as the number of edges."""
    edges = freedman_diaconis_bins(df, column)
    return histogram(df, column, max(1, edges - 1), [row, col])


def box_statistics(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """Quartiles, extremes and count of y per (x, hue)."""
    quartiles = grouped_quantiles(df, [x, hue], y, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = df.groupBy(x, hue).agg(F.min(y).alias("low"), F.max(y).alias("high"), F.count(y).alias("n"))
    return ends.join(quartiles, [x, hue], "left")


def time_series(df: DataFrame, ts: str, value: str, unit: str) -> DataFrame:
    """Mean, minimum and maximum per time bucket: a line bounded in size."""
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def scatter_points(df: DataFrame, columns: Sequence[str], key: str, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Points of a scatter or swarm chart; ``share`` draws a repeatable sample for display."""
    points = df if share >= 1 else df.filter(hash_share(key, seed) < share)
    return points.select(*[quoted(c) for c in columns])


def learning_samples(df: DataFrame, key: str, shares: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Growing, nested samples by key hash."""
    return [df.filter(hash_share(key, seed) < s) for s in shares]


def grid_of(df: DataFrame, column: str, points: int = 50) -> Column:
    """Array of equally spaced values over the range of a column."""
    low, high = df.agg(F.min(quoted(column)).cast("double"), F.max(quoted(column)).cast("double")).first()
    step = (high - low) / max(points - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step))


def partial_dependence(model, df: DataFrame, feature: str, assemble, points: int = 50, prediction: str = "prediction") -> DataFrame:
    """Mean prediction with one feature set to each grid value in turn, over all rows.

    ``assemble`` builds the model's feature vector from the columns. Each row is
    repeated once per grid point (a fixed number) and averaged away again.
    """
    spread = df.withColumn(feature, F.explode(grid_of(df, feature, points)))
    scored = model.transform(assemble(spread))
    return scored.groupBy(F.col(feature).alias("value")).agg(F.avg(prediction).alias("mean_prediction"), F.count(F.lit(1)).alias("n"))


def boundary_grid(model, df: DataFrame, f1: str, f2: str, assemble, points: int = 100, prediction: str = "prediction") -> DataFrame:
    """Predictions over a square grid spanning the ranges of two features."""
    spark = df.sparkSession
    cells = spark.range(points).select(F.get(grid_of(df, f1, points), F.col("id").cast("int")).alias(f1))
    cells = cells.withColumn(f2, F.explode(grid_of(df, f2, points)))
    return model.transform(assemble(cells)).select(f1, f2, prediction)
