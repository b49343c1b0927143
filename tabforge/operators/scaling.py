"""Imputation, scaling and the log transform, as fitted models of plain numbers.

Fitting is one or two aggregations over all columns together; only the fitted
numbers reach the driver. Transforming is a projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.stats import chi2_two_pvalue, with_normality_tests
from tabforge.operators.frame import quoted
from tabforge.plans.scale import exact_quantiles

# Fixed value: text standing for a missing text.
NULL_TEXT = "NULLTEXT"
INFINITE = (float("inf"), float("-inf"))


def finite(c: str) -> Column:
    """The column with NaN and infinities turned into null."""
    v = quoted(c)
    return F.when(~F.isnan(v) & ~v.isin(*INFINITE), v)


class Fill:
    """Replacement values per column; columns listed in ``floats`` also replace NaN and infinities."""

    def __init__(self, values: Mapping[str, object], floats: Sequence[str] = ()):
        self.values = dict(values)
        self.floats = set(floats)

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, v in self.values.items():
            base = finite(c) if c in self.floats else quoted(c)
            out[c] = F.coalesce(base, F.lit(v)) if v is not None else base
        return df.withColumns(out) if out else df


def fit_median(df: DataFrame, columns: Sequence[str]) -> Fill:
    """Exact medians of the finite values."""
    clean = df.select(*[finite(c).alias(c) for c in columns])
    medians = exact_quantiles(clean, list(columns), [0.5])
    return Fill({c: medians[c][0] for c in columns}, floats=columns)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every (column, value) pair; values must share a numeric type."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("long").alias("value")) for c in columns])
    long = df.select(F.inline(pairs)).filter("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def fit_mode(df: DataFrame, columns: Sequence[str]) -> Fill:
    """Most frequent value per integer column, the smallest one on ties.

    Values are counted by a shuffle on (column, value), then the best one per
    column is a partial aggregate; no table of values is held in one place.
    """
    best = F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode")
    rows = value_counts(df, columns).groupBy("column").agg(best).collect()
    found = {r["column"]: r["mode"] for r in rows}
    return Fill({c: found.get(c) for c in columns})


def fit_imputer(df: DataFrame, sentinel: float = -1, unsigned: Sequence[str] = (), skip: Sequence[str] = ()) -> Fill:
    """Replacement by type: median, mode, 0 for counts, sentinel, literal text; booleans untouched."""
    floats, ints, fixed = [], [], {}
    for f in df.schema.fields:
        if f.name in skip or isinstance(f.dataType, T.BooleanType):
            continue
        if f.name in unsigned:
            fixed[f.name] = 0
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            floats.append(f.name)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            ints.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            fixed[f.name] = NULL_TEXT
        elif isinstance(f.dataType, T.DecimalType):
            fixed[f.name] = sentinel
    values: dict[str, object] = dict(fixed)
    if floats:
        values |= fit_median(df, floats).values
    if ints:
        values |= fit_mode(df, ints).values
    return Fill(values, floats)


def fill_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(NULL_TEXT)) for c in columns})


class Linear:
    """x -> (x - shift) / scale per column; a zero scale counts as one."""

    def __init__(self, shift: Mapping[str, float], scale: Mapping[str, float]):
        self.shift, self.scale = dict(shift), dict(scale)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (quoted(c) - F.lit(self.shift[c] or 0.0)) / F.lit(self.scale[c] or 1.0) for c in self.shift}
        ) if self.shift else df


def _fit_pair(df: DataFrame, columns: Sequence[str], first, second) -> Linear:
    if not columns:
        return Linear({}, {})
    exprs = []
    for i, c in enumerate(columns):
        exprs += [first(c).alias(f"a{i}"), second(c).alias(f"b{i}")]
    row = df.agg(*exprs).first()
    return Linear({c: row[f"a{i}"] for i, c in enumerate(columns)}, {c: row[f"b{i}"] for i, c in enumerate(columns)})


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Linear:
    """Mean and population standard deviation."""
    return _fit_pair(df, columns, lambda c: F.avg(quoted(c)), lambda c: F.stddev_pop(quoted(c)))


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> Linear:
    return _fit_pair(
        df, columns, lambda c: F.min(quoted(c)).cast("double"), lambda c: (F.max(quoted(c)) - F.min(quoted(c))).cast("double")
    )


def fit_robust(df: DataFrame, columns: Sequence[str]) -> Linear:
    """Median and interquartile range."""
    q = exact_quantiles(df, list(columns), [0.25, 0.5, 0.75])
    return Linear({c: q[c][1] for c in columns}, {c: q[c][2] - q[c][0] for c in columns})


def zero_then_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN, infinities and nulls to 0, then standard scaling: the input of clustering and PCA."""
    clean = df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in columns})
    return fit_standard(clean, columns).transform(clean)


def impute_and_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median imputation of this table's own gaps, then standard scaling."""
    gaps = df.agg(*[F.count_if(finite(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    holed = [c for i, c in enumerate(columns) if gaps[f"g{i}"]]
    filled = fit_median(df, holed).transform(df) if holed else df
    return fit_standard(filled, columns).transform(filled)


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K-squared statistic, p-value and smallest value per column, all columns in one pass."""
    exprs = []
    for i, c in enumerate(columns):
        v = finite(c)
        exprs += [
            F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"s{i}"), F.kurtosis(v).alias(f"k{i}"), F.min(v).alias(f"m{i}")
        ]
    wide = df.agg(*exprs)
    items = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("skew"),
            F.col(f"k{i}").alias("kurtosis"), F.col(f"m{i}").cast("double").alias("smallest"),
        )
        for i, c in enumerate(columns)
    ]
    rows = wide.select(F.inline(F.array(*items)))
    rows = with_normality_tests(rows, F.col("n"), "skew", "kurtosis", "skew_test", "kurtosis_test", "k2")
    return rows.withColumn("pvalue", chi2_two_pvalue(F.col("k2")))


class LogTransform:
    """Log of the columns found positive and not normal; they get the suffix ``_log``."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[F.log(quoted(c)).alias(f"{c}_log") if c in self.columns else quoted(c) for c in df.columns]
        )


def fit_log(df: DataFrame, columns: Sequence[str], level: float = 0.05) -> LogTransform:
    rows = normality(df, columns).filter((F.col("smallest") > 0) & (F.col("pvalue") <= level)).collect()
    return LogTransform([r["column"] for r in rows])
