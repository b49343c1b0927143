"""Estimators by short name, cross-validation, feature elimination and custom ensembles.

Every builder returns a ``pyspark.ml`` estimator (or a class with the same
``fit``/``transform``) reading a vector column and a label column.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.operators import metrics
from tabforge.operators.frame import add, quoted
from tabforge.operators.neighbours import NeighbourModel
from tabforge.operators.trees import Tree, bin_matrix, bins_of, feature_cuts, grow, matrix, reached
from tabforge.operators.unsupervised import assemble
from tabforge.plans.scale import lookup_join, materialise, prefix_sums

# -- scores ---------------------------------------------------------------------


def positive_probability(probability: str = "probability") -> Column:
    return F.get(vector_to_array(probability), F.lit(1))


def positive_score(out: DataFrame) -> Column:
    """Positive-class probability where the model has one, else its vote share or squashed margin."""
    if "probability" in out.columns:
        return positive_probability()
    if "positive" in out.columns:
        return F.col("positive")
    return 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))


def argmax(values: Column | str) -> Column:
    """Position of the first largest entry of an array, from 0."""
    values = F.col(values) if isinstance(values, str) else values
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


# -- custom estimators --------------------------------------------------------------


class AdaBoostModel:
    def __init__(self, trees: Sequence[tuple[float, DecisionTreeClassificationModel]], classes: int, prediction: str):
        self.trees, self.classes, self.prediction = list(trees), classes, prediction

    def transform(self, df: DataFrame) -> DataFrame:
        marks = []
        for i, (_, tree) in enumerate(self.trees):
            df = _raw_prediction(tree, df, f"_p{i}")
            marks.append(f"_p{i}")
        votes = [
            add([F.when(F.col(m) == c, F.lit(w)).otherwise(0.0) for m, (w, _) in zip(marks, self.trees)])
            for c in range(self.classes)
        ]
        total = sum(w for w, _ in self.trees) or 1.0
        df = df.withColumn("_votes", F.array(*votes))
        df = df.withColumn(self.prediction, argmax("_votes").cast("double"))
        shares = F.transform("_votes", lambda v: v / F.lit(total))
        return df.withColumn("probability", array_to_vector(shares)).drop("_votes", *marks)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for i, (_, tree) in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree_{i}")
        rows = [(i, float(w), self.classes, self.prediction) for i, (w, _) in enumerate(self.trees)]
        spark.createDataFrame(rows, "i int, weight double, classes int, prediction string").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, path: str) -> AdaBoostModel:
        rows = SparkSession.active().read.parquet(f"{path}/weights").orderBy("i").collect()
        trees = [(r.weight, DecisionTreeClassificationModel.load(f"{path}/tree_{r.i}")) for r in rows]
        return cls(trees, rows[0].classes, rows[0].prediction)


def _raw_prediction(tree: DecisionTreeClassificationModel, df: DataFrame, name: str) -> DataFrame:
    quiet = tree.copy()
    quiet.setPredictionCol(name).setProbabilityCol("").setRawPredictionCol("")
    return quiet.transform(df)


class AdaBoost:
    """SAMME boosting of decision stumps (Zhu et al. 2009).

    Row weights live in a column that is written to the checkpoint folder every
    few rounds, so the plan stays short.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 1, seed: int = 0,
                 featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", every: int = 5):
        self.n, self.rate, self.depth, self.seed = n_estimators, learning_rate, max_depth, seed
        self.features, self.label, self.prediction, self.every = featuresCol, labelCol, predictionCol, every

    def fit(self, df: DataFrame) -> AdaBoostModel:
        data = df.select(F.col(self.features), F.col(self.label).cast("double").alias(self.label))
        n, top = data.agg(F.count(F.lit(1)), F.max(self.label)).first()
        classes = int(top) + 1
        data = data.withColumn("_w", F.lit(1.0 / n))
        trees: list[tuple[float, DecisionTreeClassificationModel]] = []
        for t in range(self.n):
            if t % self.every == 0:
                data = materialise(data)
            tree = DecisionTreeClassifier(featuresCol=self.features, labelCol=self.label, weightCol="_w",
                                          maxDepth=self.depth, seed=self.seed + t).fit(data)
            judged = _raw_prediction(tree, data, "_p").withColumn("_miss", (F.col("_p") != F.col(self.label)).cast("double"))
            wrong, weight = judged.agg(F.sum(F.col("_w") * F.col("_miss")), F.sum("_w")).first()
            error = wrong / weight
            if error >= 1 - 1 / classes:
                break
            error = max(error, 1e-10)
            alpha = self.rate * (math.log((1 - error) / error) + math.log(classes - 1))
            trees.append((alpha, tree))
            if error <= 1e-10:
                break
            grown = F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(weight)
            data = judged.withColumn("_w", grown).drop("_p", "_miss")
        return AdaBoostModel(trees, classes, self.prediction)


class SoftmaxBoostModel:
    """Scores of all classes, each a sum of trees, turned into probabilities."""

    def __init__(self, trees: Sequence[Sequence[Tree]], priors: Sequence[float], step: float, features: str, size: int, prediction: str):
        self.trees, self.priors, self.step = [list(own) for own in trees], [float(p) for p in priors], float(step)
        self.features, self.size, self.prediction = features, size, prediction

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by rows, as shares within a class, averaged over classes."""
        total = np.zeros((len(self.trees), self.size))
        for own, trees in zip(total, self.trees):
            for tree in trees:
                split = np.array(tree.feature) >= 0
                np.add.at(own, np.array(tree.feature)[split], (np.array(tree.gain) * np.array(tree.weight))[split])
        sums = total.sum(axis=1, keepdims=True)
        return DenseVector((total / np.where(sums > 0, sums, 1.0)).mean(axis=0))

    def transform(self, df: DataFrame) -> DataFrame:
        own = [[(t.steps(False), self.step * np.array(t.value)) for t in trees] for trees in self.trees]
        priors, size = self.priors, self.size

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, size))
            if rows.shape[1] != size:
                raise ValueError(f"{rows.shape[1]} features instead of {size}")
            out = np.zeros((len(rows), len(priors)))
            for k, trees in enumerate(own):
                for steps, values in trees:
                    out[:, k] += values[reached(rows, steps)]
            return pd.Series(list(out + priors))

        df = df.withColumn("_scores", scores(vector_to_array(self.features))).withColumn("_shares", softmax(F.col("_scores")))
        return df.withColumn(self.prediction, argmax("_shares").cast("double")).withColumn("probability", array_to_vector("_shares")).drop("_scores", "_shares")

    def save(self, path: str) -> None:
        rows = [(k, i, *(getattr(t, f) for f in Tree.FIELDS)) for k, own in enumerate(self.trees) for i, t in enumerate(own)]
        fields = ", ".join(f"{f} array<{kind}>" for f, kind in Tree.FIELDS.items())
        SparkSession.active().createDataFrame(rows, f"k int, i int, {fields}").write.mode("overwrite").parquet(f"{path}/trees")
        _write_note(path, {"priors": self.priors, "step": self.step, "features": self.features, "size": self.size, "prediction": self.prediction})

    @classmethod
    def load(cls, path: str) -> SoftmaxBoostModel:
        note = _read_note(path)
        trees: list[list[Tree]] = [[] for _ in note["priors"]]
        for r in SparkSession.active().read.parquet(f"{path}/trees").orderBy("k", "i").collect():
            trees[r.k].append(Tree(**{f: r[f] for f in Tree.FIELDS}))
        return cls(trees, **note)


def softmax(scores: Column) -> Column:
    """Exponentials of an array as shares of their sum."""
    grown = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(grown, lambda e: e / F.aggregate(grown, F.lit(0.0), lambda a, x: a + x))


class SoftmaxBoost:
    """Gradient boosting of the multinomial log loss (Friedman 2001): in every round one regression tree per class.

    The trees of a round follow the gradients of the same probabilities, y - p, and are grown together, a level of all of them in one pass
    (``trees.grow``) over features that were cut into bins once. A leaf holds the mean gradient; times the number of classes that is the Newton
    step at even odds. Scores live in a column that is kept from round to round and written every few rounds.
    """

    def __init__(self, n_estimators: int = 51, max_depth: int = 5, learning_rate: float = 0.1, subsample: float = 0.9, seed: int = 0,
                 featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", every: int = 5, block: int = 32_768):
        self.n, self.depth, self.rate, self.subsample, self.seed = n_estimators, max_depth, learning_rate, subsample, seed
        self.features, self.label, self.prediction, self.every, self.block = featuresCol, labelCol, predictionCol, every, block

    def _rows(self, df: DataFrame) -> DataFrame:
        """``_y``, ``_x``, written once; spread over the cores where a few partitions hold much."""
        rows = materialise(df.select(F.col(self.label).cast("int").alias("_y"), vector_to_array(self.features).alias("_x")))
        odd = F.exists("_x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
        parts = rows.groupBy(F.spark_partition_id().alias("_part")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.size("_x")).alias("_least"), F.max(F.size("_x")).alias("_most"),
            F.max(F.col("_y").isNull() | F.col("_x").isNull() | odd).alias("_odd"))
        held, largest, least, most, wrong = parts.agg(F.count(F.lit(1)), F.max("_n"), F.min("_least"), F.max("_most"), F.max("_odd")).first()
        if wrong or least != most:
            raise ValueError("boosting needs labels and feature vectors of one size, without nulls, NaN or infinite values")
        cores = rows.sparkSession.sparkContext.defaultParallelism
        return materialise(rows.repartition(cores)) if largest > self.block and held < cores else rows

    def fit(self, df: DataFrame) -> SoftmaxBoostModel:
        rows = self._rows(df)
        counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}  # a row per class
        classes, total = max(counts) + 1, sum(counts.values())
        priors = [math.log(max(counts.get(k, 0), 0.5) / total) for k in range(classes)]
        cuts = feature_cuts(rows, "_x")
        step = self.rate * classes

        def scored(y: pa.Array, bins: pa.Array, f: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * classes), pa.array(v.ravel()))
                     for v in (f, f - f.max(axis=1, keepdims=True))]
            return pa.RecordBatch.from_arrays([y, bins, *lists], names=["_y", "_bins", "_f", "_below"])

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = bins_of(matrix(batch.column("_x"), len(cuts)), cuts)
                yield scored(batch.column("_y"), pa.array([r.tobytes() for r in bins], pa.binary()), np.tile(priors, (len(bins), 1)))

        def move(grown: list[Tree]) -> Callable:
            own = [(t.steps(True), step * np.array(t.value)) for t in grown]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x, f = bin_matrix(batch.column("_bins"), len(cuts)), matrix(batch.column("_f"), classes).copy()
                    for k, (steps, values) in enumerate(own):
                        f[:, k] += values[reached(x, steps)]
                    yield scored(batch.column("_y"), batch.column("_bins"), f)

            return run

        def gradients(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            odds = matrix(batch.column("_odds"), classes)
            shares = odds / np.cumsum(odds, axis=1)[:, -1:]
            return (batch.column("_y").to_numpy()[:, None] == np.arange(classes)) - shares, matrix(batch.column("_use"), classes)

        fields = "_y int, _bins binary, _f array<double>, _below array<double>"
        data = rows.mapInArrow(begin, fields)
        trees: list[list[Tree]] = [[] for _ in range(classes)]
        before = None
        for t in range(self.n):
            if t % self.every == 0:
                data = materialise(data)
            # drawn by the place of a row in its partition, as Spark's forests draw their rows
            use = [F.rand(self.seed + t * classes + k + 1) < self.subsample for k in range(classes)]
            now = data.select("_y", "_bins", "_f", F.transform("_below", lambda s: F.exp(s)).alias("_odds"), F.array(*use).alias("_use")).persist()
            grown = grow(now, cuts, self.depth, classes, gradients, ["_y", "_odds", "_use"])
            if before is not None:
                before.unpersist()
            for own, tree in zip(trees, grown):
                own.append(tree)
            data, before = now.select("_y", "_bins", "_f").mapInArrow(move(grown), fields), now
        if before is not None:
            before.unpersist()
        return SoftmaxBoostModel(trees, priors, step, self.features, len(cuts), self.prediction)


def _write_note(path: str, note: dict) -> None:
    row = [(json.dumps(note),)]
    SparkSession.active().createDataFrame(row, "note string").write.mode("overwrite").parquet(f"{path}/note")


def _read_note(path: str) -> dict:
    return json.loads(SparkSession.active().read.parquet(f"{path}/note").first()["note"])


class ScaledBayesModel:
    def __init__(self, model: PipelineModel, features: str):
        self.model, self.features = model, features

    def transform(self, df: DataFrame) -> DataFrame:
        scaler, bayes = self.model.stages
        scaled = scaler.transform(df)
        # values below the training minimum would be negative counts
        clipped = F.transform(vector_to_array("_scaled"), lambda x: F.greatest(x, F.lit(0.0)))
        return bayes.transform(scaled.withColumn("_scaled", array_to_vector(clipped))).drop("_scaled")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _write_note(path, {"features": self.features})

    @classmethod
    def load(cls, path: str) -> ScaledBayesModel:
        return cls(PipelineModel.load(f"{path}/model"), **_read_note(path))


class ScaledBayes:
    """Multinomial naive Bayes on features scaled to [0, 1]."""

    def __init__(self, label: str, features: str, alpha: float = 1.0):
        self.label, self.features, self.alpha = label, features, alpha

    def fit(self, df: DataFrame) -> ScaledBayesModel:
        bayes = NaiveBayes(labelCol=self.label, smoothing=self.alpha, modelType="multinomial")
        return ScaledBayesModel(_scaled(bayes, self.features, minmax=True).fit(df), self.features)


class FourierMap:
    """Random Fourier features of a Gaussian kernel (Rahimi and Recht 2007).

    The map is a seeded matrix product on Arrow batches; it needs no fitting.
    """

    def __init__(self, size: int, components: int = 200, gamma: float = 0.1, seed: int = 0):
        self.size, self.components, self.gamma, self.seed = size, components, gamma, seed

    def transform(self, df: DataFrame, features: str, output: str) -> DataFrame:
        rng = np.random.default_rng(self.seed)
        omega = rng.normal(0.0, (2 * self.gamma) ** 0.5, (self.size, self.components))
        shift = rng.uniform(0.0, 2 * np.pi, self.components)
        scale = (2.0 / self.components) ** 0.5

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            z = scale * np.cos(np.stack(x.to_numpy()) @ omega + shift)
            return pd.Series(list(z))

        return df.withColumn(output, array_to_vector(lift(vector_to_array(features))))


class KernelSVCModel:
    def __init__(self, lift: FourierMap, model, features: str):
        self.lift, self.model, self.features = lift, model, features

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.lift.transform(df, self.features, "_lifted")).drop("_lifted")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        f = self.lift
        _write_note(path, {"lift": [f.size, f.components, f.gamma, f.seed], "features": self.features})

    @classmethod
    def load(cls, path: str) -> KernelSVCModel:
        note = _read_note(path)
        return cls(FourierMap(*note["lift"]), LinearSVCModel.load(f"{path}/model"), note["features"])


class KernelSVC:
    """Kernel support vector classifier: Fourier features, then a linear one."""

    def __init__(self, gamma: float | None = None, components: int = 200, reg: float = 1e-4, max_iter: int = 50, seed: int = 0,
                 featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction",
                 cost: float | None = None, tol: float = 1e-6):
        self.gamma, self.components, self.reg, self.iter, self.seed = gamma, components, reg, max_iter, seed
        self.cost, self.tol = cost, tol
        self.features, self.label, self.prediction = featuresCol, labelCol, predictionCol

    def fit(self, df: DataFrame) -> KernelSVCModel:
        size = len(df.select(vector_to_array(self.features)).first()[0])
        lift = FourierMap(size, self.components, self.gamma or 1.0 / size, self.seed)
        lifted = materialise(lift.transform(df.select(self.features, self.label), self.features, "_lifted"))
        # a cost per row of the sum of losses is 1 / (cost * rows) of their mean
        reg = self.reg if self.cost is None else 1 / (self.cost * lifted.count())
        svc = LinearSVC(featuresCol="_lifted", labelCol=self.label, predictionCol=self.prediction, regParam=reg, maxIter=self.iter,
                        tol=self.tol)
        return KernelSVCModel(lift, svc.fit(lifted), self.features)


class PairwiseRankerModel:
    def __init__(self, columns: Sequence[str], weights: Sequence[float], prediction: str):
        self.columns, self.weights, self.prediction = list(columns), [float(w) for w in weights], prediction

    def transform(self, df: DataFrame) -> DataFrame:
        terms = [quoted(c) * F.lit(w) for c, w in zip(self.columns, self.weights)]
        return df.withColumn(self.prediction, add(terms))

    def save(self, path: str) -> None:
        _write_note(path, {"columns": self.columns, "weights": self.weights, "prediction": self.prediction})

    @classmethod
    def load(cls, path: str) -> PairwiseRankerModel:
        return cls(**_read_note(path))


class PairwiseRanker:
    """Linear ranker over the pairs of rows of a group that differ in their label.

    ``loss="logistic"`` (as boosted rankers have it): the mean of log(1 + exp(-(s_a - s_b))) over pairs with y_a > y_b, plus reg/2 |w|^2, by
    Newton steps. A group is cut into blocks of ``block`` rows by hash; a task meets two blocks at a time as matrices and passes on
    sums (loss, gradient, Hessian) only, so no pair is a row, and a large group is many meetings. The blocks are written once.
    Where the rows of a group were measured to hold few different features (``kinds`` at most), pairs of kinds are counted instead, by running
    counts in the order of the label, and a step adds up their table; its work no longer grows with the square of a group.

    ``loss="squared"``: the sum over all pairs of ((y_a - y_b) - w.(x_a - x_b))^2 equals n_g times the sum over rows of
    ((y - mean y) - w.(x - mean x))^2 (pairwise regularised least squares, Pahikkala et al. 2007). So group means and one weighted
    regression give the exact minimum.
    """

    def __init__(self, columns: Sequence[str], group: str, label: str, reg: float | None = None, prediction: str = "prediction",
                 loss: str = "logistic", block: int = 2048, max_iter: int = 50, tol: float = 1e-9,
                 kinds: int = 1024):
        if loss not in ("logistic", "squared"):
            raise ValueError(f"unknown pair loss {loss}")
        self.columns, self.group, self.label, self.prediction = list(columns), group, label, prediction
        self.reg = reg if reg is not None else (1e-4 if loss == "logistic" else 0.0)
        self.loss, self.block, self.max_iter, self.tol, self.kinds = loss, block, max_iter, tol, kinds

    def centred(self, df: DataFrame) -> DataFrame:
        """Rows less their group's means, with the group size as weight."""
        names = [*self.columns, self.label]
        means = df.filter(quoted(self.label).isNotNull()).groupBy(self.group).agg(
            F.count(F.lit(1)).cast("double").alias("_n"), *[F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(names)])
        joined = lookup_join(df.filter(quoted(self.label).isNotNull()), materialise(means), self.group, "inner")
        return joined.select("_n", *[(quoted(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(names)])

    def _rows(self, df: DataFrame) -> DataFrame:
        x = F.array(*[quoted(c).cast("double") for c in self.columns])
        return df.filter(quoted(self.label).isNotNull()).select(F.col(self.group).alias("_g"), quoted(self.label).cast("double").alias("_y"), x.alias("_x"))

    def kind_pairs(self, df: DataFrame, block: int = 65_536) -> DataFrame | None:
        """``x`` (features of the higher label less those of the lower), ``n`` (such pairs); nothing if a group has too many kinds of rows.

        The kinds of a group are its different features. Its labels, in order, are cut into ranges of about ``block`` rows; a range starts from
        the counts of the kinds below it and passes on a matrix of pairs.
        """
        cells = materialise(self._rows(df).groupBy("_g", "_y", "_x").agg(F.count(F.lit(1)).alias("_n")), columnar=True)
        kinds = cells.select("_g", "_x").distinct()
        most, pairs = kinds.groupBy("_g").count().agg(F.max("count"), F.sum(F.col("count").cast("double") ** 2)).first()
        if not most or most > self.kinds or pairs > cells.count() + 1_000_000:
            return None
        kinds = materialise(kinds.withColumn("_kind", F.row_number().over(W.partitionBy("_g").orderBy("_x")) - 1))
        labels = cells.groupBy("_g", "_y").agg(F.count(F.lit(1)).alias("_size"))
        ranges = prefix_sums(materialise(labels), ["_g"], [F.col("_y")], {"_upto": F.col("_size")}, inclusive=False)
        ranges = ranges.select("_g", "_y", F.floor(F.col("_upto") / F.lit(block)).cast("long").alias("_range"))
        ranged = materialise(lookup_join(lookup_join(cells, kinds, ["_g", "_x"], "inner"), ranges, ["_g", "_y"], "inner").drop("_x"), columnar=True)
        totals = ranged.groupBy("_g", "_range", "_kind").agg(F.sum("_n").alias("_n"))
        last = ranged.groupBy("_g").agg(F.max("_range").alias("_last"))
        later = F.explode(F.when(F.col("_range") < F.col("_last"), F.sequence(F.col("_range") + 1, F.col("_last"))))
        below = lookup_join(totals, last, "_g", "inner").select("_g", later.alias("_at"), "_kind", "_n")
        below = materialise(below.groupBy("_g", F.col("_at").alias("_range"), "_kind").agg(F.sum("_n").alias("_n")))

        def count(key: tuple, rows: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_y")
            size = int(max([-1, *rows["_kind"], *low["_kind"]])) + 1
            under, pairs = np.zeros(size), np.zeros((size, size))
            np.add.at(under, low["_kind"].to_numpy(dtype=int), low["_n"].to_numpy(dtype=float))
            kind, n, y = rows["_kind"].to_numpy(dtype=int), rows["_n"].to_numpy(dtype=float), rows["_y"].to_numpy(dtype=float)
            # a label's rows hold each kind once; labels that are no number are equal to none and above none
            starts = np.flatnonzero(np.r_[True, y[1:] != y[:-1]]) if len(y) else []
            for a, b in zip(starts, [*starts[1:], len(y)]):
                if not np.isnan(y[a]):
                    pairs[kind[a:b]] += n[a:b, None] * under[None, :]
                    under[kind[a:b]] += n[a:b]
            one, two = np.nonzero(pairs)
            group = rows["_g"].iloc[0] if len(rows) else None
            return pd.DataFrame({"_g": [group] * len(one), "_one": one.astype("int32"), "_two": two.astype("int32"), "_n": pairs[one, two]})

        field = cells.schema["_g"].dataType.simpleString()
        met = ranged.groupBy("_g", "_range").cogroup(below.groupBy("_g", "_range")).applyInPandas(count, f"_g {field}, _one int, _two int, _n double")
        met = materialise(met.groupBy("_g", "_one", "_two").agg(F.sum("_n").alias("_n")))
        for side in ("_one", "_two"):
            met = lookup_join(met, kinds.select("_g", F.col("_kind").alias(side), F.col("_x").alias(f"_x{side}")), ["_g", side], "inner")
        apart = F.zip_with("_x_one", "_x_two", lambda a, b: a - b)
        return materialise(met.groupBy(apart.alias("x")).agg(F.sum("_n").alias("n")), columnar=True)

    def meetings(self, df: DataFrame) -> DataFrame:
        """``first`` (rows of the first block), ``y``, ``x`` (row by row): the rows of two blocks of a group, or of one (first = all)."""
        rows = self._rows(df)
        rows = materialise(rows.withColumn("_i", F.monotonically_increasing_id()), columnar=True)
        sizes = rows.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / F.lit(self.block)).alias("_parts"), F.count_distinct("_y").alias("_values"))
        rows = lookup_join(rows, materialise(sizes.filter("_values > 1")), "_g", "inner").withColumn("_part", F.pmod(F.xxhash64("_i"), F.col("_parts")))
        met = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        met = met.withColumns({"_a": F.least("_part", "_other"), "_b": F.greatest("_part", "_other")})
        held = F.sort_array(F.collect_list(F.struct("_part", "_i", "_y", "_x")))
        out = met.groupBy("_g", "_a", "_b").agg(held.alias("_rows"))
        return materialise(out.select(
            F.when(F.col("_a") == F.col("_b"), F.size("_rows")).otherwise(F.size(F.filter("_rows", lambda r: r["_part"] == F.col("_a")))).alias("first"),
            F.transform("_rows", lambda r: r["_y"]).alias("y"), F.flatten(F.transform("_rows", lambda r: r["_x"])).alias("x")), columnar=True)

    def _sums(self, met: DataFrame, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Pairs, loss, gradient and Hessian at ``w``; numbers of features squared reach the driver."""
        d = len(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + d + d * d)
            for batch in batches:
                if batch.num_columns == 2:
                    x = batch.column(0).flatten().to_numpy().reshape(-1, d)
                    total += counted_pair_sums(x, batch.column(1).to_numpy(), w)
                    continue
                for first, ys, xs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    total += pair_sums(ys.values.to_numpy(), xs.values.to_numpy().reshape(-1, d), first, w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

        rows = met.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(2 + d + d * d)
        for r in rows:
            total[r["place"]] = r["value"]
        return total[0], total[1], total[2:2 + d], total[2 + d:].reshape(d, d)

    def _newton(self, df: DataFrame) -> np.ndarray:
        met = self.kind_pairs(df)
        met = self.meetings(df) if met is None else met
        w = np.zeros(len(self.columns))
        best, least, step = w, math.inf, None
        for _ in range(self.max_iter):
            pairs, loss, gradient, hessian = self._sums(met, w)
            if not pairs:
                return w
            value = loss / pairs + self.reg / 2 * float(w @ w)
            if value > least + 1e-15 * abs(least):  # too far: half the way
                step = step / 2
                w = best - step
            else:
                best, least = w, value
                step = np.linalg.lstsq(hessian / pairs + self.reg * np.eye(len(w)), gradient / pairs + self.reg * w, rcond=None)[0]
                w = best - step
            if np.abs(step).max(initial=0) <= self.tol * (1 + np.abs(best).max(initial=0)):
                break
        return w if np.isfinite(w).all() else best

    def fit(self, df: DataFrame) -> PairwiseRankerModel:
        if self.loss == "logistic":
            return PairwiseRankerModel(self.columns, self._newton(df), self.prediction)
        data = assemble(self.centred(df), self.columns, "_x")
        line = LinearRegression(featuresCol="_x", labelCol=self.label, weightCol="_n", fitIntercept=False,
                                regParam=self.reg, standardization=False, solver="normal").fit(data)
        return PairwiseRankerModel(self.columns, line.coefficients.toArray(), self.prediction)


def pair_sums(y: np.ndarray, x: np.ndarray, first: int, w: np.ndarray) -> np.ndarray:
    """Pairs, logistic loss, gradient and Hessian, in a row, over the pairs of the first rows with the others (of all rows, if there are no others)."""
    one = slice(0, first)
    two = slice(first, len(y)) if first < len(y) else one
    sign = np.sign(y[one][:, None] - y[two][None, :])
    if two is one:
        sign = np.maximum(sign, 0.0)  # each pair once
    s = x @ w
    margin = sign * (s[one][:, None] - s[two][None, :])
    some = sign != 0
    loss = np.where(some, np.logaddexp(0.0, -margin), 0.0).sum()
    p = np.where(some, 1.0 / (1.0 + np.exp(np.clip(margin, -700, 700))), 0.0)
    c, h = -sign * p, p * (1.0 - p)
    a, b = x[one], x[two]
    gradient = a.T @ c.sum(axis=1) - b.T @ c.sum(axis=0)
    cross = a.T @ h @ b
    hessian = (a * h.sum(axis=1)[:, None]).T @ a + (b * h.sum(axis=0)[:, None]).T @ b - cross - cross.T
    return np.concatenate([[some.sum(), loss], gradient, hessian.ravel()])


def counted_pair_sums(x: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums of ``pair_sums`` over pairs of features ``x`` apart, ``n`` of each."""
    margin = x @ w
    p = 1.0 / (1.0 + np.exp(np.clip(margin, -700, 700)))
    hessian = (x * (n * p * (1.0 - p))[:, None]).T @ x
    return np.concatenate([[n.sum(), (n * np.logaddexp(0.0, -margin)).sum()], -x.T @ (n * p), hessian.ravel()])


class ExtraTreesModel:
    """A forest over the marks of random cuts."""

    def __init__(self, forest, cuts: np.ndarray, features: str):
        self.forest, self.cuts, self.features = forest, cuts, features  # cuts: features x cuts of each

    @property
    def featureImportances(self) -> DenseVector:
        """Those of a feature's cuts together."""
        return DenseVector(self.forest.featureImportances.toArray().reshape(self.cuts.shape).sum(axis=1))

    def thresholds(self) -> list[list[float]]:
        """Per feature, the cuts that the trees use."""
        used = self.forest.featureImportances.toArray().reshape(self.cuts.shape) > 0
        return [sorted(row[u].tolist()) for row, u in zip(self.cuts, used)]

    def marked(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_marks", cut_marks(F.col(self.features), self.cuts))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.forest.transform(self.marked(df)).drop("_marks")

    def save(self, path: str) -> None:
        self.forest.write().overwrite().save(f"{path}/forest")
        _write_note(path, {"cuts": self.cuts.tolist(), "features": self.features, "kind": type(self.forest).__name__})

    @classmethod
    def load(cls, path: str) -> ExtraTreesModel:
        note = _read_note(path)
        kind = {c.__name__: c for c in (RandomForestClassificationModel, RandomForestRegressionModel)}[note["kind"]]
        return cls(kind.load(f"{path}/forest"), np.array(note["cuts"]), note["features"])


def cut_marks(features: Column, cuts: np.ndarray) -> Column:
    """A vector with a 1 for every cut that its feature exceeds."""

    @F.pandas_udf("array<double>")
    def marks(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy())
        return pd.Series(list((rows[:, :, None] > cuts[None, :, :]).reshape(len(rows), -1).astype(float)))

    return array_to_vector(marks(vector_to_array(features)))


class ExtraTrees:
    """Extremely randomised trees (Geurts et al. 2006): whole samples, and cuts drawn at random before any split is looked for.

    Each feature gets cuts drawn uniformly between its least and greatest value, and every row is marked by the cuts it exceeds. A node looks at a
    random subset of marks, which is a random cut of some random features, and takes the best. All trees are grown together, by one forest
    over the marks with two bins.
    """

    def __init__(self, forest, cuts: int = 48, marks: int = 768):
        self.forest, self.cuts, self.marks = forest, cuts, marks

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        features, label, seed = self.forest.getFeaturesCol(), self.forest.getLabelCol(), self.forest.getSeed()
        low, high = df.select(Summarizer.metrics("min", "max").summary(F.col(features)).alias("s")).select("s.min", "s.max").first()
        low, high = low.toArray(), high.toArray()
        each = max(4, min(self.cuts, self.marks // max(len(low), 1)))
        cuts = low[:, None] + np.random.default_rng(seed).random((len(low), each)) * (high - low)[:, None]
        # as many marks a node as give the usual root of the features, with room for cuts beyond the node's own values
        share = min(1.0, 1.0 / (4.0 * math.sqrt(len(low))))
        keep = [c for c in (label, self.forest.getOrDefault("weightCol") if self.forest.isDefined("weightCol") else None) if c]
        data = materialise(df.select(*keep, cut_marks(F.col(features), cuts).alias("_marks")), columnar=True)
        forest = self.forest.copy().setFeaturesCol("_marks").setMaxBins(2).setFeatureSubsetStrategy(f"{share:.6f}").setBootstrap(False)
        return ExtraTreesModel(forest.fit(data), cuts, features)


# -- registry ----------------------------------------------------------------------


def _scaled(estimator, features: str, minmax: bool = False):
    """A scaler in front of a scale-sensitive estimator."""
    cls = MinMaxScaler if minmax else StandardScaler
    scaler = cls(inputCol=features, outputCol="_scaled")
    if not minmax:
        scaler.setWithMean(True)
    return Pipeline(stages=[scaler, estimator.setFeaturesCol("_scaled")])


def _gbt(kind: str, depth: int, rate: float, rounds: int | None, subsample: float):
    cls = GBTClassifier if kind == "classification" else GBTRegressor

    def build(spec: dict, **p):
        est = cls(
            maxDepth=p.get("max_depth", depth), stepSize=p.get("learning_rate", rate),
            maxIter=p.get("n_estimators", rounds or spec["estimators"]), subsamplingRate=p.get("subsample", subsample),
            seed=spec["seed"], featuresCol=spec["features"], labelCol=spec["label"])
        if spec.get("validation"):
            est.setValidationIndicatorCol(spec["validation"])
        return est

    return build


def _forest(kind: str, depth: int, bootstrap: bool = True, impurity: str | None = None, min_leaf: int = 1):
    cls = RandomForestClassifier if kind == "classification" else RandomForestRegressor

    def build(spec: dict, **p):
        est = cls(
            numTrees=p.get("n_estimators", spec["estimators"]), maxDepth=p.get("max_depth", depth),
            bootstrap=p.get("bootstrap", bootstrap), minInstancesPerNode=p.get("min_samples_leaf", min_leaf),
            seed=spec["seed"], featuresCol=spec["features"], labelCol=spec["label"], cacheNodeIds=True)
        if impurity:
            est.setImpurity(p.get("criterion", impurity))
        return est

    return build


def _extra_trees(kind: str, depth: int):
    forest = _forest(kind, depth, False)
    return lambda spec, **p: ExtraTrees(forest(spec, **{**p, "bootstrap": False}), p.get("cuts", 48))


def _logistic(spec: dict, **p):
    return _scaled(LogisticRegression(
        labelCol=spec["label"], maxIter=p.get("max_iter", 500), regParam=p.get("reg", 0.0),
        fitIntercept=p.get("fit_intercept", True)), spec["features"])


def _linear(spec: dict, **p):
    return LinearRegression(featuresCol=spec["features"], labelCol=spec["label"], fitIntercept=p.get("fit_intercept", True),
                            regParam=p.get("reg", 0.0))


def _linear_svc(spec: dict, **p):
    return _scaled(LinearSVC(labelCol=spec["label"], maxIter=p.get("max_iter", 100), regParam=p.get("reg", 1e-3),
                             tol=p.get("tol", 1e-4)), spec["features"])


def _naive_bayes(spec: dict, **p):
    return ScaledBayes(spec["label"], spec["features"], p.get("alpha", 1.0))


def _multiclass_boost(spec: dict, **p):
    return SoftmaxBoost(p.get("n_estimators", spec["estimators"]), p.get("max_depth", 5), p.get("learning_rate", 0.1), p.get("subsample", 0.9), spec["seed"],
                        featuresCol=spec["features"], labelCol=spec["label"])


def _ada(spec: dict, **p):
    return AdaBoost(p.get("n_estimators", spec["estimators"]), p.get("learning_rate", 1.0), seed=spec["seed"],
                    featuresCol=spec["features"], labelCol=spec["label"])


def _kernel(spec: dict, **p):
    return KernelSVC(p.get("gamma"), seed=spec["seed"], reg=p.get("reg", 1e-4), featuresCol=spec["features"], labelCol=spec["label"],
                     cost=p.get("C"), tol=p.get("tol", 1e-6))


class Neighbours:
    def __init__(self, spec: dict, classify: bool, k: int = 5, weights: str = "uniform"):
        self.spec, self.classify, self.k, self.weights = spec, classify, k, weights

    def fit(self, df: DataFrame) -> NeighbourModel:
        points = df.select(self.spec["features"], F.col(self.spec["label"]).cast("double").alias("_label"), self.spec["key"])
        return NeighbourModel(materialise(points), self.spec["features"], "_label", self.spec["key"], self.k, self.classify, self.weights)


def _knn(classify: bool):
    return lambda spec, **p: Neighbours(spec, classify, p.get("n_neighbors", 5), p.get("weights", "uniform"))


# Algorithm name -> kind and default parameters (boosting: depth, rate, rounds, subsample).
ALGORITHMS: dict[str, tuple[str, Callable]] = {
    "AB": ("classification", _ada),
    "CATB": ("classification", _gbt("classification", 6, 0.03, None, 1.0)),
    "CATBR": ("regression", _gbt("regression", 6, 0.03, None, 1.0)),
    "GB": ("classification", _gbt("classification", 3, 0.1, None, 1.0)),
    "GBR": ("regression", _gbt("regression", 3, 0.1, None, 1.0)),
    "KNN": ("classification", _knn(True)),
    "KNR": ("regression", _knn(False)),
    "LGB": ("classification", _gbt("classification", 5, 0.1, None, 1.0)),
    "LGBR": ("regression", _gbt("regression", 5, 0.1, None, 1.0)),
    "LOGR": ("classification", _logistic),
    "LR": ("regression", _linear),
    "LSVC": ("classification", _linear_svc),
    "LSVM": ("classification", _linear_svc),
    "NB": ("classification", _naive_bayes),
    "RBF": ("classification", _kernel),
    "RF": ("classification", _forest("classification", 10, True, "entropy", 3)),
    "RFR": ("regression", _forest("regression", 10)),
    "SVM": ("classification", _kernel),
    "XGB": ("classification", _gbt("classification", 3, 0.05, 300, 1.0)),
    "XGBM": ("multiclass", _multiclass_boost),
    "XGBR": ("regression", _gbt("regression", 10, 0.1, None, 0.9)),
    "XT": ("classification", _extra_trees("classification", 10)),
    "XTR": ("regression", _extra_trees("regression", 10)),
}


# Algorithms whose fitted models rank their features, as elimination needs.
RANKED = frozenset(("CATB", "CATBR", "GB", "GBR", "LGB", "LGBR", "LOGR", "LR", "LSVC", "LSVM", "RF", "RFR", "XGB", "XGBR", "XT", "XTR"))


def build(algo: str, spec: dict, **params):
    """Estimator by name. ``spec``: features, label, key, estimators, seed, optional validation and weight columns."""
    full = {"features": "features", "label": "label", "key": "key", "estimators": 51, "seed": 42, **spec}
    made = ALGORITHMS[algo][1](full, **params)
    if full.get("weight"):
        inner = made.forest if isinstance(made, ExtraTrees) else made.getStages()[-1] if isinstance(made, Pipeline) else made
        if not hasattr(inner, "setWeightCol"):
            raise ValueError(f"{algo} takes no row weights")
        inner.setWeightCol(full["weight"])
    return made


class MetricEvaluator:
    """Evaluator built on this package's exact metric tables.

    The score is NaN where it is undefined: fewer than two classes or values, or no group with a defined tau.
    Ranking scores need the row key (it orders equal predictions) and the group column.
    """

    def __init__(self, scorer: str, label: str, key: str | None = None, group: str | None = None):
        self.scorer, self.label, self.key, self.group = scorer, label, key, group

    def evaluate(self, df: DataFrame) -> float:
        row = self._table(df).filter(F.col("metric") == self.scorer).first()
        return float("nan") if row is None or row["value"] is None else row["value"]

    def _table(self, df: DataFrame) -> DataFrame:
        kind = metrics.SCORERS[self.scorer][0]
        if kind == "regression":
            return metrics.regression_metrics(df, self.label, "prediction")
        if kind == "ranking":
            if self.key is None:
                raise ValueError(f"{self.scorer} needs the key column")
            return metrics.ranking_metrics(df, self.label, "prediction", self.key, [self.group] if self.group else [])
        if self.scorer not in ("roc_auc", "average_precision", "neg_brier_score", "neg_log_loss"):
            return metrics.label_metrics(df, self.label, "prediction")
        if not metrics.has_classes(df, self.label):
            return df.sparkSession.createDataFrame([], "metric string, value double")
        scored = df.select(self.label, positive_score(df).alias("_score"))
        if self.scorer in ("roc_auc", "average_precision"):
            return metrics.curve_metrics(scored, self.label, "_score")
        return metrics.probability_metrics(scored, self.label, "_score")


class LogLossEvaluator:
    """Log loss: of the positive class's score for two classes, of the true class's probability for more."""

    def __init__(self, label: str):
        self.label = label

    def evaluate(self, df: DataFrame) -> float:
        top = df.agg(F.max(self.label)).first()[0]
        if top is None or top <= 1:
            return MetricEvaluator("neg_log_loss", self.label).evaluate(df)
        return MulticlassClassificationEvaluator(labelCol=self.label, metricName="logLoss").evaluate(df)


def evaluator(scorer: str, label: str = "label", key: str | None = None, group: str | None = None):
    """Something with ``evaluate(scored rows)``, and whether larger is better. All scores are exact."""
    larger = metrics.SCORERS[scorer][1]
    multi = {"accuracy": "accuracy", "f1_weighted": "f1"}
    plain = {"r2": "r2", "neg_mean_squared_error": "mse", "neg_mean_absolute_error": "mae"}
    if scorer in multi:
        return MulticlassClassificationEvaluator(labelCol=label, metricName=multi[scorer]), larger
    if scorer in plain:
        return RegressionEvaluator(labelCol=label, metricName=plain[scorer]), larger
    if scorer == "neg_log_loss":
        return LogLossEvaluator(label), larger
    return MetricEvaluator(scorer, label, key, group), larger


# -- cross-validation and elimination ----------------------------------------------------


def fold_pairs(df: DataFrame, fold: str, folds: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    for i in range(folds):
        yield i, df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)


def in_parallel(work: Sequence[Callable], parallelism: int = 4) -> list:
    """Run independent jobs from a few driver threads; Spark shares the cluster among them."""
    if len(work) < 2:
        return [w() for w in work]
    # wrapped here, where the caller's job tags are known; once for each, as threads must not share their properties
    spark = SparkSession.active()
    with ThreadPool(min(parallelism, len(work))) as pool:
        return pool.map(lambda w: w(), [inheritable_thread_target(spark)(w) for w in work])


def cv_scores(df: DataFrame, estimator, scorer: str, fold: str, folds: int, label: str = "label", key: str | None = None,
              group: str | None = None) -> list[float]:
    """Score of every fold for a model fitted on the others; ranking scorers need ``key`` and ``group``."""
    judge, _ = evaluator(scorer, label, key, group)
    work = [
        lambda train=train, test=test: judge.evaluate(estimator.fit(train).transform(test))
        for _, train, test in fold_pairs(df, fold, folds)
    ]
    return in_parallel(work)


def out_of_fold(df: DataFrame, estimator, fold: str, folds: int) -> DataFrame:
    """Every row scored by the model that did not see its fold."""
    pairs = list(fold_pairs(df, fold, folds))
    fitted = in_parallel([lambda train=train: estimator.fit(train) for _, train, _ in pairs])
    parts = [m.transform(test) for m, (_, _, test) in zip(fitted, pairs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _carried(df: DataFrame, spec: dict) -> list[str]:
    """Columns beside features, label and fold that estimators and scorers may need."""
    return [c for c in dict.fromkeys(spec.get(n) for n in ("key", "group", "validation", "weight")) if c and c in df.columns]


def lofo(df: DataFrame, columns: Sequence[str], algo: str, spec: dict, scorer: str, fold: str, folds: int) -> DataFrame:
    """Mean loss of score when a feature is left out, over folds; positive means keep."""
    label = spec.get("label", "label")
    better = 1.0 if evaluator(scorer, label)[1] else -1.0

    def score(use: Sequence[str]) -> list[float]:
        data = assemble(df, use, "features").select("features", label, fold, *_carried(df, spec))
        estimator = build(algo, {**spec, "features": "features"})
        return cv_scores(data, estimator, scorer, fold, folds, label, spec.get("key"), spec.get("group"))

    whole = score(columns)
    rows = []
    for c in columns:
        drops = [better * (a - b) for a, b in zip(whole, score([x for x in columns if x != c]))]
        mean = sum(drops) / folds
        std = (sum((d - mean) ** 2 for d in drops) / folds) ** 0.5
        rows.append((c, float(mean), float(std), mean > 0))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, std double, keep boolean")


def importances(model, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Importance (trees) or absolute coefficient (linear models) per feature."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif getattr(last, "numClasses", 2) > 2 and hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).sum(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        raise TypeError(f"{type(last).__name__} has no importances")
    return list(zip(columns, [float(v) for v in values]))


def importance_table(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(importances(model, columns), "feature string, importance double")


def eliminate(df: DataFrame, columns: Sequence[str], algo: str, spec: dict, scorer: str, fold: str, folds: int, step: int = 1) -> DataFrame:
    """Recursive elimination: drop the weakest features step by step, keep the subset with the best CV score."""
    label = spec.get("label", "label")
    better = 1.0 if evaluator(scorer, label)[1] else -1.0
    left, tried = list(columns), []
    while left:
        data = assemble(df, left, "features").select("features", label, fold, *_carried(df, spec))
        est = build(algo, {**spec, "features": "features"})
        scores = cv_scores(data, est, scorer, fold, folds, label, spec.get("key"), spec.get("group"))
        tried.append((sum(scores) / folds, list(left)))
        if len(left) == 1:
            break
        ranked = sorted(importances(est.fit(data), left), key=lambda r: (r[1], r[0]))
        gone = {c for c, _ in ranked[: min(step, len(left) - 1)]}
        left = [c for c in left if c not in gone]
    _, kept = max(tried, key=lambda t: (better * t[0], -len(t[1])))
    steps = {c: sum(c in use for _, use in tried) for c in columns}
    rows = [(c, "rfe", c in kept, steps[c]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, keep boolean, rounds int")
