"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_normality_tests(
    df: DataFrame, n: Column | int, skew: str, excess: str, skew_test: str, kurtosis_test: str, k2: str
) -> DataFrame:
    """Add the standard-normal statistics of the skewness test (D'Agostino 1970) and the kurtosis test
    (Anscombe and Glynn 1983), and K-squared, the sum of their squares (D'Agostino and Pearson).

    Null below eight (five) values. A skewness of exactly zero is tested as if its
    standardised value were one, as common statistics libraries do. Intermediate terms are columns of their own,
    so that the planner does not repeat them inside each other.
    """
    size = F.col("_n")
    df = df.withColumn("_n", n.cast("double") if isinstance(n, Column) else F.lit(float(n)))
    terms = {
        "_beta": 3 * (size * size + 27 * size - 70) * (size + 1) * (size + 3)
        / ((size - 2) * (size + 5) * (size + 7) * (size + 9)),
        "_y": F.when(F.col(skew) == 0, 1.0).otherwise(F.col(skew))
        * F.when(F.col(skew) == 0, 1.0).otherwise(F.sqrt((size + 1) * (size + 3) / (6 * (size - 2)))),
        "_x": (F.col(excess) + 3 - 3 * (size - 1) / (size + 1))
        / F.sqrt(24 * size * (size - 2) * (size - 3) / ((size + 1) * (size + 1) * (size + 3) * (size + 5))),
        "_q": 6 * (size * size - 5 * size + 2) / ((size + 7) * (size + 9))
        * F.sqrt(6 * (size + 3) * (size + 5) / (size * (size - 2) * (size - 3))),
    }
    df = df.withColumns({k: F.when(size >= 5, v) for k, v in terms.items()})
    q = F.col("_q")
    df = df.withColumns(
        {"_w2": F.sqrt(2 * (F.col("_beta") - 1)) - 1, "_a": 6 + (8 / q) * (2 / q + F.sqrt(1 + 4 / (q * q)))}
    )
    w2, a = F.col("_w2"), F.col("_a")
    df = df.withColumns(
        {"_delta": 1 / F.sqrt(0.5 * F.log(w2)), "_u": F.col("_y") / F.sqrt(2 / (w2 - 1)), "_d": 1 + F.col("_x") * F.sqrt(2 / (a - 4))}
    )
    u, d = F.col("_u"), F.col("_d")
    root = F.signum(d) * F.cbrt((1 - 2 / a) / F.abs(d))
    df = df.withColumns(
        {
            skew_test: F.when(size >= 8, F.col("_delta") * F.log(u + F.sqrt(u * u + 1))),
            kurtosis_test: F.when(size >= 5, (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))),
        }
    )
    df = df.withColumn(k2, F.col(skew_test) * F.col(skew_test) + F.col(kurtosis_test) * F.col(kurtosis_test))
    return df.drop("_n", *terms, "_w2", "_a", "_delta", "_u", "_d")


def chi2_two_pvalue(statistic: Column) -> Column:
    """Upper tail of the chi-squared distribution with two degrees of freedom."""
    return F.exp(-statistic / 2)
