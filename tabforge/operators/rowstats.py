"""Statistics over the columns (or the array) of each row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.stats import with_normality_tests
from tabforge.operators.frame import quoted
from tabforge.operators.scaling import impute_and_scale


class RowValues:
    """The values of a row: a list of columns, or one array column of numbers."""

    def __init__(self, values: Sequence[str] | str):
        if isinstance(values, str):
            self.array: Column | None = F.col(values)
            self.columns: list[Column] = []
            self.n: Column | int = F.size(self.array)
        else:
            self.array = None
            self.columns = [quoted(c).cast("double") for c in values]
            self.n = len(self.columns)

    def total(self, of: Callable[[Column], Column] = lambda x: x) -> Column:
        if self.array is None:
            return reduce(lambda a, b: a + b, [of(c) for c in self.columns])
        return F.aggregate(self.array, F.lit(0.0), lambda acc, x: acc + of(x.cast("double")))

    def mean(self) -> Column:
        return self.total() / self.n


def add_moments(df: DataFrame, values: RowValues) -> DataFrame:
    """Mean and central moments 2..4 as helper columns ``_mean``, ``_m2``, ``_m3``, ``_m4``."""
    df = df.withColumn("_mean", values.mean())
    m = F.col("_mean")

    def moment(p: int) -> Column:
        return values.total(lambda x: reduce(lambda a, b: a * b, [x - m] * p)) / values.n

    return df.withColumns({f"_m{p}": moment(p) for p in (2, 3, 4)})


def _drop_moments(df: DataFrame) -> DataFrame:
    return df.drop("_mean", "_m2", "_m3", "_m4")


def sums_and_spread(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Row sum, mean, population standard deviation and variance, unscaled."""
    v = RowValues(columns)
    df = df.withColumns({"sum": v.total(), "mean": v.mean()})
    var = v.total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / v.n
    return df.withColumn("var", var).withColumn("std", F.sqrt("var"))


def numpy_features(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Row sum, mean, std and var, median-imputed and standard-scaled over the table."""
    return impute_and_scale(sums_and_spread(df, columns), ["sum", "mean", "std", "var"])


def shape_statistics(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """The nine row statistics ``sp_*``, unscaled; undefined values are null."""
    v = RowValues(columns)
    n = v.n
    df = add_moments(df, v)
    mean, m2 = F.col("_mean"), F.col("_m2")
    spread = m2 > 0
    skew = F.when(spread, F.col("_m3") / F.pow(m2, F.lit(1.5)))
    kurt = F.when(spread, F.col("_m4") / (m2 * m2) - 3)
    # the geometric mean is undefined with a negative value and zero with a zero
    gmean = F.exp(v.total(lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.log(x))) / n)
    df = df.withColumns({"sp_geometric_mean": gmean, "sp_kurtosis": kurt, "sp_skew": skew})
    df = with_normality_tests(df, n, "sp_skew", "sp_kurtosis", "sp_skew_test", "sp_kurtosis_test", "sp_normal_test")
    size = n if isinstance(n, int) else n.cast("double")
    out = {
        "sp_variation": F.when(mean != 0, F.sqrt(m2) / mean),
        "sp_signal_to_noise": F.when(spread, mean / F.sqrt(m2)).when(m2 == 0, 0.0),
        "sp_standard_error_of_mean": F.sqrt(m2 / (size - 1)),
    }
    return _drop_moments(df.withColumns(out))


# The names of the row-statistic block, in output order.
SHAPE_NAMES = (
    "sp_geometric_mean",
    "sp_kurtosis",
    "sp_kurtosis_test",
    "sp_normal_test",
    "sp_skew",
    "sp_skew_test",
    "sp_variation",
    "sp_signal_to_noise",
    "sp_standard_error_of_mean",
)


def scipy_features(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """The nine row statistics, median-imputed and standard-scaled over the table."""
    return impute_and_scale(shape_statistics(df, columns), list(SHAPE_NAMES))
