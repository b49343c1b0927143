"""Feature tests and feature selection.

A test aggregates all features in one pass, per class and then over the classes;
only a few numbers per feature reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.tails import chi2_tail, f_tail
from tabforge.operators.frame import quoted
from tabforge.operators.scaling import fit_standard
from tabforge.plans.scale import materialise


def _table(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "feature string, score double, pvalue double")


def _class_sums(df: DataFrame, features: Sequence[str], y: str, squares: bool) -> DataFrame:
    """A row per class: ``n`` and, per feature, the sum ``s0``, ``s1``, ... (and sum of squares ``q0``, ...)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        x = quoted(c).cast("double")
        aggs.append(F.sum(x).alias(f"s{i}"))
        if squares:
            aggs.append(F.sum(x * x).alias(f"q{i}"))
    return df.groupBy(quoted(y).alias("y")).agg(*aggs)


def f_classif(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One-way ANOVA F per feature between the classes of y. Values are centred first for accuracy; class sums are added up in Spark."""
    means = df.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    centred = df.select(quoted(y), *[(quoted(c) - F.lit(means[f"m{i}"])).alias(c) for i, c in enumerate(features)])
    classes = _class_sums(centred, features, y, squares=True)
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")]
    for i in range(len(features)):
        s = F.col(f"s{i}")
        aggs += [F.sum(f"q{i}").alias(f"q{i}"), F.sum(s).alias(f"s{i}"), F.sum(s * s / F.col("n")).alias(f"b{i}")]
    row = classes.agg(*aggs).first()
    n, k = row["n"], row["k"]
    out = []
    for i, c in enumerate(features):
        total, grand = row[f"q{i}"], row[f"s{i}"]
        between = row[f"b{i}"] - grand * grand / n
        within = total - grand * grand / n - between
        score = (between / (k - 1)) / (within / (n - k)) if within > 0 else math.inf
        out.append((c, float(score), f_tail(score, k - 1, n - k)))
    return _table(df, out)


def f_regression(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """F of the univariate linear regression of y on each feature."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.corr(quoted(c).cast("double"), quoted(y).cast("double")).alias(f"r{i}") for i, c in enumerate(features)]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(features):
        r = row[f"r{i}"]
        r2 = 0.0 if r is None else min(r * r, 1.0)
        score = r2 / (1 - r2) * (row.n - 2) if r2 < 1 else math.inf
        out.append((c, float(score), f_tail(score, 1, row.n - 2)))
    return _table(df, out)


def chi2(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Chi-squared of class-wise feature sums against those expected from class shares."""
    classes = materialise(_class_sums(df, features, y, squares=False))
    total = classes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(features))]).first()
    gaps = []
    for i in range(len(features)):
        expected = F.col("n") / F.lit(total["n"]) * F.lit(total[f"s{i}"])
        gaps.append(F.sum((F.col(f"s{i}") - expected) ** 2 / expected).alias(f"g{i}") if (total[f"s{i}"] or 0) > 0 else F.lit(0.0).alias(f"g{i}"))
    row = classes.agg(F.count(F.lit(1)).alias("k"), *gaps).first()
    return _table(df, [(c, float(row[f"g{i}"]), chi2_tail(row[f"g{i}"], total["k"] - 1)) for i, c in enumerate(features)])


SCORERS: dict[str, Callable] = {"f_classif": f_classif, "f_regression": f_regression, "chi2": chi2}


def support(scores: DataFrame, mode: str = "percentile", value: float = 10) -> DataFrame:
    """(feature, kind, keep): the features a selection mode keeps.

    Modes: percentile, kbest, fpr, fdr (Benjamini-Hochberg), fwe (Bonferroni).
    Ties in the score are broken by name.
    """
    rows = scores.collect()
    n = len(rows)
    by_score = sorted(rows, key=lambda r: (-r.score if not math.isnan(r.score) else math.inf, r.feature))
    if mode == "percentile":
        keep = {r.feature for r in by_score[: math.ceil(n * value / 100)]}
    elif mode == "kbest":
        keep = {r.feature for r in by_score[: int(value)]}
    elif mode == "fpr":
        keep = {r.feature for r in rows if r.pvalue < value}
    elif mode == "fdr":
        ranked = sorted(r.pvalue for r in rows)
        passed = [p for i, p in enumerate(ranked, 1) if p <= value * i / n]
        keep = {r.feature for r in rows if passed and r.pvalue <= max(passed)}
    elif mode == "fwe":
        keep = {r.feature for r in rows if r.pvalue < value / n}
    else:
        raise ValueError(mode)
    return scores.sparkSession.createDataFrame(
        [(r.feature, mode, r.feature in keep) for r in rows], "feature string, kind string, keep boolean")


def kept(table: DataFrame) -> list[str]:
    return [r.feature for r in table.filter("keep").orderBy("feature").collect()]


def apply_support(df: DataFrame, features: Sequence[str], table: DataFrame) -> DataFrame:
    """Drop the features a support table rejects; other columns stay."""
    gone = set(features) - set(kept(table))
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def variances(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.var_pop(quoted(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(features)}


def low_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Support table keeping features whose population variance exceeds the threshold."""
    found = variances(df, features)
    return df.sparkSession.createDataFrame(
        [(c, "variance", (v or 0.0) > threshold) for c, v in found.items()], "feature string, kind string, keep boolean")


class Interactions:
    """Products of chosen distinct features, scaled with the moments of the training rows."""

    def __init__(self, products: Sequence[tuple[str, ...]], scaler=None):
        self.products, self.scaler = [tuple(p) for p in products], scaler

    @property
    def names(self) -> list[str]:
        return ["*".join(p) for p in self.products]

    def _multiply(self, df: DataFrame) -> DataFrame:
        out = {}
        for p in self.products:
            value = quoted(p[0]).cast("double")
            for c in p[1:]:
                value = value * quoted(c)
            out["*".join(p)] = value
        return df.withColumns(out) if out else df

    def fit_scaler(self, df: DataFrame) -> Interactions:
        self.scaler = fit_standard(self._multiply(df), self.names) if self.products else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._multiply(df)
        return self.scaler.transform(out) if self.scaler else out


def fit_interactions(
    df: DataFrame, features: Sequence[str], y: str, percentage: float = 10, degree: int = 2, score: str = "f_classif"
) -> Interactions:
    """Products of 2..degree of the features with the best scores; no feature meets itself."""
    best = kept(support(SCORERS[score](df, features, y), "percentile", percentage))
    best = [c for c in features if c in set(best)]
    products = [p for d in range(2, degree + 1) for p in combinations(best, d)]
    return Interactions(products).fit_scaler(df)
