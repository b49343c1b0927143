"""Categorical encoders: fit is a grouped aggregate, transform a checked lookup join.

Codes follow the sorted order of the categories, starting at 1. Categories
unseen in training get the encoder's neutral value. A missing category is a
category of its own. All listed columns are fitted in one pass.

Contrast and one-hot encoders make a column per level, or, with ``vectors``, one
vector column per factor: the fitted table then holds codes alone, and a row's
vector follows from its code and the number of levels, which may be any.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.vectors import sparse_vector
from tabforge.operators.frame import quoted
from tabforge.operators.variables import float_factor
from tabforge.operators.scaling import fill_text
from tabforge.plans.scale import BLOCK_ROWS, lookup_join, materialise, prefix_sums

# Texts put in order by one task take about so many bytes.
BLOCK_BYTES = 256 * 1024 * 1024


def _category(df: DataFrame, c: str, rounding: int | None) -> Column:
    """Category text; float factors are first reduced to their digits."""
    if rounding is not None and dict(df.dtypes)[c] in ("double", "float"):
        return float_factor(quoted(c), rounding).cast("string")
    return quoted(c).cast("string")


def category_stats(df: DataFrame, columns: Sequence[str], target: str | None, rounding: int | None) -> DataFrame:
    """(column, category, n, s, ss): row count, target sum and sum of squares per category."""
    y = quoted(target).cast("double") if target else F.lit(0.0)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _category(df, c, rounding).alias("category")) for c in columns])
    long = df.select(y.alias("_y"), F.inline(cells))
    return long.groupBy("column", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("ss")
    )


class EncoderModel:
    """Fitted lookup tables; ``tables[c]`` holds ``category`` and the output columns of column c."""

    def __init__(self, tables: dict[str, DataFrame], outputs: dict[str, list[str]], defaults: dict[str, object],
                 rounding: int | None = None, keep: bool = False):
        self.tables, self.outputs, self.defaults = tables, outputs, defaults
        self.rounding, self.keep = rounding, keep

    def transform(self, df: DataFrame) -> DataFrame:
        for c, t in self.tables.items():
            names = self.outputs[c]
            keyed = df.withColumn("_cat", _category(df, c, self.rounding))
            if not self.keep:
                keyed = keyed.drop(c)
            side = t.select(F.col("category").alias("_cat"), *[F.col(f"`{n}`").alias(f"_e_{i}") for i, n in enumerate(names)],
                            F.lit(True).alias("_seen"))
            joined = lookup_join(keyed, side, "_cat")
            cols = {}
            for i, n in enumerate(names):
                default = self.defaults[n]
                value = F.col(f"_e_{i}")
                cols[n] = value if default is None else F.when(F.col("_seen"), value).otherwise(F.lit(default))
            df = joined.withColumns(cols).drop("_cat", "_seen", *[f"_e_{i}" for i in range(len(names))])
        return df

    def save(self, path: str) -> None:
        for i, (c, t) in enumerate(self.tables.items()):
            t.write.mode("overwrite").parquet(f"{path}/table_{i}")
        spark = next(iter(self.tables.values())).sparkSession
        rows = [(i, c, n, self.defaults[n] is None, float(self.defaults[n] or 0), self.rounding, self.keep)
                for i, c in enumerate(self.tables) for n in self.outputs[c]]
        schema = "i int, c string, name string, no_default boolean, fallback double, rounding int, keep boolean"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/outputs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncoderModel:
        meta = spark.read.parquet(f"{path}/outputs").orderBy("i").collect()
        tables = {r.c: spark.read.parquet(f"{path}/table_{r.i}") for r in meta}
        outputs = {c: [n for n in t.columns if n != "category"] for c, t in tables.items()}
        types = {r.name: dict(tables[r.c].dtypes)[r.name] for r in meta}
        defaults = {r.name: None if r.no_default else (r.fallback if types[r.name] == "double" else int(r.fallback)) for r in meta}
        return cls(tables, outputs, defaults, meta[0].rounding, meta[0].keep)


def _codes(stats: DataFrame, column: str) -> DataFrame:
    """Categories of one column with codes 1..k in sorted order (a missing category last)."""
    one = stats.filter(F.col("column") == column).select("category", "n")
    return prefix_sums(one, [], [F.col("category").asc_nulls_last()], {"code": F.lit(1).cast("long")})


class _Fitter:
    rounding: int | None = None

    def __init__(self, columns: Sequence[str], target: str | None = None, rounding: int | None = None, keep: bool = False):
        self.columns, self.target, self.rounding, self.keep = list(columns), target, rounding, keep

    def _stats(self, df: DataFrame) -> DataFrame:
        return materialise(category_stats(df, self.columns, self.target, self.rounding))

    def fit_transform(self, df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
        """Training rows encoded; some encoders treat them unlike other rows."""
        return self.fit(df).transform(df)

    def _model(self, tables, outputs, defaults) -> EncoderModel:
        return EncoderModel(tables, outputs, defaults, self.rounding, self.keep)


class OrdinalEncoder(_Fitter):
    """Code of the category; unseen -1."""

    def fit(self, df: DataFrame) -> EncoderModel:
        stats = self._stats(df)
        tables = {c: materialise(_codes(stats, c).select("category", F.col("code").alias(f"{c}_code"))) for c in self.columns}
        return self._model(tables, {c: [f"{c}_code"] for c in self.columns}, {f"{c}_code": -1 for c in self.columns})


class _Expanding(_Fitter):
    """Encoders whose outputs are expressions of the code and the number of levels."""

    suffix = "e"
    default: object = 0

    def __init__(self, columns: Sequence[str], target: str | None = None, rounding: int | None = None, keep: bool = False, vectors: bool = False):
        super().__init__(columns, target, rounding, keep)
        self.vectors = vectors

    def expressions(self, k: int) -> list[Column]:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> EncoderModel | LevelVectors:
        stats = self._stats(df)
        codes = {c: materialise(_codes(stats, c)) for c in self.columns}
        if self.vectors:
            sizes = {c: t.count() for c, t in codes.items()}
            return LevelVectors(self.suffix, {c: t.select("category", "code") for c, t in codes.items()}, sizes, self.rounding, self.keep)
        tables, outputs, defaults = {}, {}, {}
        for c in self.columns:
            exprs = self.expressions(codes[c].count())
            names = [f"{c}_{self.suffix.partition('_')[0]}{j}" for j in range(1, len(exprs) + 1)]
            tables[c] = materialise(codes[c].select("category", *[e.alias(n) for e, n in zip(exprs, names)]))
            outputs[c] = names
            defaults |= {n: self.default for n in names}
        return self._model(tables, outputs, defaults)


class OneHotEncoder(_Expanding):
    suffix = "is"

    def expressions(self, k: int) -> list[Column]:
        return [(F.col("code") == j).cast("int") for j in range(1, k + 1)]


class BaseNEncoder(_Expanding):
    """Digits of the code in a base, most significant first."""

    suffix = "d"

    def __init__(self, columns: Sequence[str], base: int = 2, **kw):
        super().__init__(columns, **kw)
        if self.vectors:
            raise ValueError("digits are few columns, whatever the number of levels")
        self.base = base

    def expressions(self, k: int) -> list[Column]:
        digits = 1
        while self.base**digits <= k:
            digits += 1
        return [
            (F.floor(F.col("code") / self.base**p) % self.base).cast("int") for p in range(digits - 1, -1, -1)
        ]


class BinaryEncoder(BaseNEncoder):
    def __init__(self, columns: Sequence[str], **kw):
        super().__init__(columns, base=2, **kw)


class _Contrast(_Expanding):
    default = 0.0

    def expressions(self, k: int) -> list[Column]:
        return [self.contrast(F.col("code"), j, k).cast("double") for j in range(1, k)]

    def contrast(self, i: Column, j: int, k: int) -> Column:
        raise NotImplementedError


class BackwardDifferenceEncoder(_Contrast):
    suffix = "c_backdiff"

    def contrast(self, i: Column, j: int, k: int) -> Column:
        return F.when(i <= j, -(k - j) / k).otherwise(j / k)


class HelmertEncoder(_Contrast):
    suffix = "c_helmert"

    def contrast(self, i: Column, j: int, k: int) -> Column:
        return F.when(i <= j, -1.0).when(i == j + 1, float(j)).otherwise(0.0)


class SumEncoder(_Contrast):
    suffix = "c_sum"

    def contrast(self, i: Column, j: int, k: int) -> Column:
        return F.when(i == j, 1.0).when(i == k, -1.0).otherwise(0.0)


def polynomial_row(level: int, k: int) -> np.ndarray:
    """Orthonormal polynomials of degree 0..k-1 at one of the points 1..k.

    The polynomials follow a three-term recurrence x P_j = b_{j+1} P_{j+1} + b_j P_{j-1} with b_j = j/2 sqrt((k^2 - j^2) / (4 j^2 - 1)), x centred.
    Going up is stable while the values oscillate, up to degree sqrt(k^2 - 4 x^2); beyond, where they die away, going down from the highest
    degree is. Both meet there.
    """
    x = level - (k + 1) / 2
    j = np.arange(1, k, dtype=float)
    b = np.concatenate([[0.0], j / 2 * np.sqrt((k * k - j * j) / (4 * j * j - 1)), [0.0]])
    out = np.zeros(k)
    turn = min(int(math.sqrt(max(k * k - 4 * x * x, 0.0))) + 1, k - 1)
    before, at = 0.0, 1.0
    out[0] = at
    for d in range(turn):
        before, at = at, (x * at - b[d] * before) / b[d + 1]
        out[d + 1] = at
    if turn < k - 1:
        down = np.zeros(k)
        after, at = 0.0, 1.0
        down[k - 1] = at
        for d in range(k - 1, turn - 1, -1):
            after, at = at, (x * at - b[d + 1] * after) / b[d]
            down[d - 1] = at
            if abs(at) > 1e200:
                down[d - 1:] *= 1e-200
                after, at = after * 1e-200, at * 1e-200
        pair = slice(turn - 1, turn + 1)
        down /= np.abs(down[pair]).max()
        down *= (out[pair] @ down[pair]) / (down[pair] @ down[pair])
        out[turn:] = down[turn:]
    return out / np.sqrt(out @ out)


@functools.lru_cache(maxsize=256)
def _contrasts(level: int, k: int) -> np.ndarray:
    return polynomial_row(level, k)[1:]


class PolynomialEncoder(_Contrast):
    """Orthonormal polynomials of the level index."""

    suffix = "c_polynomial"

    def expressions(self, k: int) -> list[Column]:
        q = np.array([polynomial_row(i, k) for i in range(1, k + 1)]).reshape(k, k)
        return [F.element_at(F.array(*[F.lit(float(v)) for v in q[:, j]]), F.col("code").cast("int")) for j in range(1, k)]


def _polynomial(code: Column, k: int) -> Column:
    @F.pandas_udf("array<double>")
    def rows(codes: pd.Series) -> pd.Series:
        return pd.Series([np.zeros(k - 1) if pd.isna(i) else _contrasts(int(i), k) for i in codes])

    return array_to_vector(rows(code))


def _dense(value: Callable[[Column, Column, int], Column]) -> Callable[[Column, int], Column]:
    """A vector of contrasts from (code, column number, levels)."""
    def made(code: Column, k: int) -> Column:
        cells = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: F.when(code.isNull(), 0.0).otherwise(value(code, j, k).cast("double")))
        return array_to_vector(cells if k > 1 else F.array().cast("array<double>"))

    return made


def _one_hot(code: Column, k: int) -> Column:
    seen = code.isNotNull()
    return sparse_vector(k, F.when(seen, F.array((code - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
                         F.when(seen, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")))


def _deviation(code: Column, k: int) -> Column:
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    last = (F.sequence(F.lit(0), F.lit(k - 2)), F.array_repeat(F.lit(-1.0), k - 1)) if k > 1 else none
    one = F.array((code - 1).cast("int")), F.array(F.lit(1.0))
    return sparse_vector(k - 1, *[F.when(code.isNull(), n).when(code == k, e).otherwise(o) for n, e, o in zip(none, last, one)])


# What a level's vector is, from its code (null: unseen, all zeros) and the number of levels.
LEVEL_VECTORS: dict[str, Callable[[Column, int], Column]] = {
    "is": _one_hot,
    "c_backdiff": _dense(lambda i, j, k: F.when(i <= j, -(k - j) / k).otherwise(j / k)),
    "c_helmert": _dense(lambda i, j, k: F.when(i <= j, -1.0).when(i == j + 1, j.cast("double")).otherwise(0.0)),
    "c_sum": _deviation,
    "c_polynomial": _polynomial,
}


class LevelVectors:
    """One vector column ``<factor>_levels`` per factor; tables hold the categories' codes."""

    def __init__(self, kind: str, tables: dict[str, DataFrame], sizes: dict[str, int], rounding: int | None = None, keep: bool = False):
        self.kind, self.tables, self.sizes, self.rounding, self.keep = kind, tables, sizes, rounding, keep
        self.names = [f"{c}_levels" for c in tables]

    def transform(self, df: DataFrame) -> DataFrame:
        for c, t in self.tables.items():
            keyed = df.withColumn("_cat", _category(df, c, self.rounding))
            keyed = keyed if self.keep else keyed.drop(c)
            joined = lookup_join(keyed, t.select(F.col("category").alias("_cat"), F.col("code").alias("_code")), "_cat")
            df = joined.withColumn(f"{c}_levels", LEVEL_VECTORS[self.kind](F.col("_code"), self.sizes[c])).drop("_cat", "_code")
        return df

    def save(self, path: str) -> None:
        for i, t in enumerate(self.tables.values()):
            t.write.mode("overwrite").parquet(f"{path}/table_{i}")
        spark = next(iter(self.tables.values())).sparkSession
        rows = [(i, c, self.sizes[c], self.kind, self.rounding, self.keep) for i, c in enumerate(self.tables)]
        spark.createDataFrame(rows, "i int, c string, size int, kind string, rounding int, keep boolean").write.mode("overwrite").parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LevelVectors:
        meta = spark.read.parquet(f"{path}/levels").orderBy("i").collect()
        tables = {r.c: spark.read.parquet(f"{path}/table_{r.i}") for r in meta}
        return cls(meta[0].kind, tables, {r.c: r.size for r in meta}, meta[0].rounding, meta[0].keep)


class HashingEncoder:
    """Indicator of the category's MD5 bucket, counted over all listed columns; nothing to fit."""

    def __init__(self, columns: Sequence[str], buckets: int = 8, rounding: int | None = None, keep: bool = False):
        self.columns, self.buckets, self.rounding, self.keep = list(columns), buckets, rounding, keep

    def fit(self, df: DataFrame) -> HashingEncoder:
        return self

    def fit_transform(self, df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
        return self.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        # the 128-bit digest modulo the bucket count, 32 bits at a time
        places = []
        for c in self.columns:
            digest = F.md5(F.coalesce(_category(df, c, self.rounding), F.lit("None")))
            rest = F.lit(0).cast("long")
            for part in range(4):
                word = F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")
                rest = (rest * (2**32 % self.buckets) + word) % self.buckets
            places.append(rest)
        out = {}
        for b in range(self.buckets):
            hits = [(p == b).cast("int") for p in places]
            out[f"hash_{b}"] = sum(hits[1:], hits[0])
        return df.withColumns(out) if self.keep else df.withColumns(out).drop(*self.columns)


class _TargetFitter(_Fitter):
    """Encoders replacing a category by a number worked out from the target."""

    suffix = "t"

    def value(self, prior: dict[str, float]) -> Column:
        raise NotImplementedError

    def default(self, prior: dict[str, float]) -> float:
        return prior["mean"]

    def _prior(self, stats: DataFrame) -> dict[str, float]:
        one = stats.filter(F.col("column") == self.columns[0])
        row = one.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
        mean = row["s"] / row["n"]
        return {"n": row["n"], "sum": row["s"], "mean": mean,
                "var": (row["ss"] - row["n"] * mean * mean) / max(row["n"] - 1, 1)}

    def fit(self, df: DataFrame) -> EncoderModel:
        stats = self._stats(df.filter(quoted(self.target).isNotNull()))
        prior = self._prior(stats)
        tables = {
            c: materialise(stats.filter(F.col("column") == c).select("category", self.value(prior).alias(f"{c}_{self.suffix}")))
            for c in self.columns
        }
        return self._model(tables, {c: [f"{c}_{self.suffix}"] for c in self.columns},
                           {f"{c}_{self.suffix}": self.default(prior) for c in self.columns})


class TargetEncoder(_TargetFitter):
    """Category mean blended with the prior by a logistic weight of the category size."""

    def __init__(self, columns, target, k: float = 20.0, f: float = 10.0, **kw):
        super().__init__(columns, target, **kw)
        self.k, self.f = k, f

    def value(self, prior):
        weight = 1 / (1 + F.exp(-(F.col("n") - self.k) / self.f))
        return weight * F.col("s") / F.col("n") + (1 - weight) * prior["mean"]


class MEstimateEncoder(_TargetFitter):
    def __init__(self, columns, target, m: float = 1.0, **kw):
        super().__init__(columns, target, **kw)
        self.m = m

    def value(self, prior):
        return (F.col("s") + self.m * prior["mean"]) / (F.col("n") + self.m)


class JamesSteinEncoder(_TargetFitter):
    """Category mean shrunk to the prior by the ratio of its error variance to the total variance."""

    def value(self, prior):
        n, mean = F.col("n"), F.col("s") / F.col("n")
        var = F.when(n > 1, (F.col("ss") - n * mean * mean) / (n - 1)).otherwise(0.0)
        error = F.greatest(var, F.lit(0.0)) / n
        shrink = F.when(error + prior["var"] > 0, error / (error + prior["var"])).otherwise(0.0)
        return (1 - shrink) * mean + shrink * prior["mean"]


class WOEEncoder(_TargetFitter):
    """Log ratio of the category's share of positives to its share of negatives, regularised."""

    def __init__(self, columns, target, regularization: float = 1.0, **kw):
        super().__init__(columns, target, **kw)
        self.r = regularization

    def value(self, prior):
        good = (F.col("s") + self.r) / (prior["sum"] + 2 * self.r)
        bad = (F.col("n") - F.col("s") + self.r) / (prior["n"] - prior["sum"] + 2 * self.r)
        return F.log(good / bad)

    def default(self, prior):
        return 0.0


class LeaveOneOutEncoder(_TargetFitter):
    """Category mean without the row itself on training rows, plain category mean elsewhere."""

    def value(self, prior):
        return F.col("s") / F.col("n")

    def fit_transform(self, df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
        stats = self._stats(df)
        prior = self._prior(stats)
        y = quoted(self.target).cast("double")
        for c in self.columns:
            side = stats.filter(F.col("column") == c).select(F.col("category").alias("_cat"), F.col("n").alias("_n"), F.col("s").alias("_s"))
            joined = lookup_join(df.withColumn("_cat", _category(df, c, self.rounding)), side, "_cat")
            value = F.when(F.col("_n") > 1, (F.col("_s") - y) / (F.col("_n") - 1)).otherwise(prior["mean"])
            df = joined.withColumn(f"{c}_{self.suffix}", value).drop("_cat", "_n", "_s")
        return df if self.keep else df.drop(*self.columns)


class CatBoostEncoder(_TargetFitter):
    """Ordered target statistics: training rows only see rows before them in the given order."""

    def __init__(self, columns, target, a: float = 1.0, **kw):
        super().__init__(columns, target, **kw)
        self.a = a

    def value(self, prior):
        return (F.col("s") + self.a * prior["mean"]) / (F.col("n") + self.a)

    def fit_transform(self, df: DataFrame, order: Sequence[Column], **kw) -> DataFrame:
        prior = self._prior(self._stats(df))
        y = quoted(self.target).cast("double")
        for c in self.columns:
            keyed = df.withColumn("_cat", _category(df, c, self.rounding))
            sums = {"_before_s": y, "_before_n": F.lit(1).cast("long")}
            run = prefix_sums(keyed, ["_cat"], order, sums, inclusive=False, **kw)
            value = (F.col("_before_s") + self.a * prior["mean"]) / (F.col("_before_n") + self.a)
            df = run.withColumn(f"{c}_{self.suffix}", value).drop("_cat", *sums)
        return df if self.keep else df.drop(*self.columns)


class LabelModel:
    """Codes 0..k-1 of the target's values in sorted order; a table of values and codes, however many."""

    def __init__(self, target: str, table: DataFrame):
        self.target, self.table = target, table

    def transform(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        label, code = ("_" * (1 + max(map(len, columns))) + n for n in ("label", "code"))  # longer than any name of the table
        side = self.table.withColumnsRenamed({"_label": label, "_code": code})
        coded = lookup_join(df.withColumn(label, quoted(self.target)), side, label)
        return coded.withColumn(self.target, F.col(code).cast("int")).select(*[quoted(c) for c in columns])


class LabelEncoder:
    """Label encoding of a classification target."""

    def __init__(self, target: str):
        self.target = target

    def fit(self, df: DataFrame) -> LabelModel:
        values = df.select(quoted(self.target).alias("_label")).filter("_label is not null").distinct()
        coded = prefix_sums(materialise(values), [], [F.col("_label")], {"_code": F.lit(1).cast("long")})
        return LabelModel(self.target, materialise(coded.withColumn("_code", F.col("_code") - 1)))


def factorize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Texts replaced by integer codes (sorted order, from 0); missing text is a value of its own.

    Texts may be long: rows and codes meet by 128-bit digests, each distinct text is moved once, to be put in order, in blocks of bounded size.
    """
    df = fill_text(df, columns)
    for c in columns:
        digest = F.unhex(F.md5(quoted(c).cast("binary")))
        distinct = materialise(df.select(digest.alias("_digest"), quoted(c).alias("_text")).groupBy("_digest").agg(F.first("_text").alias("_text")), columnar=True)
        width = distinct.agg(F.avg(F.octet_length("_text"))).first()[0] or 1.0
        rows = max(1_000, min(BLOCK_ROWS, int(BLOCK_BYTES / (width + 32))))
        codes = prefix_sums(distinct, [], [F.col("_text")], {"_code": F.lit(1).cast("long")}, block_rows=rows)
        codes = materialise(codes.select("_digest", (F.col("_code") - 1).alias("_code")), columnar=True)
        df = lookup_join(df.withColumn("_digest", digest), codes, "_digest").withColumn(c, F.col("_code")).drop("_digest", "_code")
    return df


# The encoder names a specification may use.
ENCODERS: dict[str, Callable] = {
    "backdiff": BackwardDifferenceEncoder,
    "basen": BaseNEncoder,
    "binary": BinaryEncoder,
    "catboost": CatBoostEncoder,
    "hashing": HashingEncoder,
    "helmert": HelmertEncoder,
    "jstein": JamesSteinEncoder,
    "leaveone": LeaveOneOutEncoder,
    "mestimate": MEstimateEncoder,
    "onehot": OneHotEncoder,
    "ordinal": OrdinalEncoder,
    "polynomial": PolynomialEncoder,
    "sum": SumEncoder,
    "target": TargetEncoder,
    "woe": WOEEncoder,
}
