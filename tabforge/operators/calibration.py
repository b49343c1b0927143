"""Probability calibration: sigmoid, isotonic and inductive Venn-Abers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.models import positive_probability
from tabforge.plans.scale import materialise
from tabforge.plans.steps import FAN, RANGE_ROWS, Steps, counted, levels, pools, ranged


class Sigmoid:
    """Logistic regression on the score (Platt)."""

    def __init__(self, model):
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, score: str, label: str) -> Sigmoid:
        data = VectorAssembler(inputCols=[score], outputCol="_s").transform(df.select(score, label))
        return cls(LogisticRegression(featuresCol="_s", labelCol=label, probabilityCol="_p", rawPredictionCol="_r",
                                      predictionCol="_y").fit(data))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Sigmoid:
        return cls(LogisticRegressionModel.load(path))

    def transform(self, df: DataFrame, score: str, output: str) -> DataFrame:
        data = VectorAssembler(inputCols=[score], outputCol="_s").transform(df)
        return self.model.transform(data).withColumn(output, positive_probability("_p")).drop("_s", "_p", "_r", "_y")


class Isotonic:
    """Monotone function of the score: blocks of equal fit, straight lines between them (as MLlib's model predicts).

    The blocks are a table, pooled range by range; no list of scores is held anywhere.
    """

    def __init__(self, steps: Steps):
        self.steps = steps

    @classmethod
    def fit(cls, df: DataFrame, score: str, label: str, range_rows: int = RANGE_ROWS) -> Isotonic:
        blocks = pools(df, score, label, range_rows).select("lo", "hi", (F.col("s") / F.col("n")).alias("fit"))
        return cls(Steps.build(blocks, following=["lo", "fit"]))

    def save(self, path: str) -> None:
        self.steps.save(path)

    @classmethod
    def load(cls, path: str) -> Isotonic:
        return cls(Steps.load(path))

    def transform(self, df: DataFrame, score: str, output: str) -> DataFrame:
        found = self.steps.join(df, score)
        fit, hi, after = F.col("_step_fit"), F.col("_step_hi"), F.col("_step_next_lo")
        between = fit + (F.col("_step_next_fit") - fit) * (F.col("_value") - hi) / (after - hi)
        p = F.when(after.isNull() | (F.col("_value") <= hi), fit).otherwise(between)
        return found.withColumn(output, p).drop("_value", "_step_lo", "_step_hi", "_step_fit", "_step_next_lo", "_step_next_fit")


def venn_abers_table(
    knots: Sequence[tuple[float, float, float]], before: Sequence[tuple[float, float]] = (), after: Sequence[tuple[float, float]] = (),
) -> list[tuple[float, float]]:
    """(p0, p1) for every place a new score can take: before, on and after each knot in turn.

    ``knots`` are (score, rows, positives) in order of score. The isotonic fits
    of all prefixes and suffixes are kept as linked block stacks; the new point
    is then pooled with the blocks beside it. ``before`` and ``after`` are the
    pooled (rows, positives) of lower and higher scores, in order of score.
    """

    def pushed(top, n, s, pools):
        while top is not None and pools(top[1] * n, s * top[0]):
            n, s, top = n + top[0], s + top[1], top[2]
        return (n, s, top)

    def stacks(start, items, pools):
        top = None
        for n, s in start:
            top = pushed(top, n, s, pools)
        out = [top]
        for n, s in items:
            top = pushed(top, n, s, pools)
            out.append(top)
        return out

    cells = [(n, p) for _, n, p in knots]
    left = stacks(before, cells, lambda a, b: a >= b)
    right = stacks(list(after)[::-1], cells[::-1], lambda a, b: a <= b)[::-1]

    def value(i: int, j: int, n: float, s: float) -> float:
        lo, hi = left[i], right[j]
        moved = True
        while moved:
            moved = False
            while lo is not None and lo[1] * n >= s * lo[0]:
                n, s, lo, moved = n + lo[0], s + lo[1], lo[2], True
            while hi is not None and hi[1] * n <= s * hi[0]:
                n, s, hi, moved = n + hi[0], s + hi[1], hi[2], True
        return s / n

    out = []
    for i in range(len(cells) + 1):
        out.append((value(i, i, 1.0, 0.0), value(i, i, 1.0, 1.0)))
        if i < len(cells):
            n, p = cells[i]
            out.append((value(i, i + 1, n + 1.0, p), value(i, i + 1, n + 1.0, p + 1.0)))
    return out


_ABERS = "lo double, on0 double, on1 double, after0 double, after1 double"


def _abers(key: tuple, knots: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    """The places of one range of knots: on each and after it (the first range: also before all), given the pools on both sides."""
    if not len(knots):
        return pd.DataFrame(columns=["lo", "on0", "on1", "after0", "after1"], dtype=float)
    knots, carry = knots.sort_values("k"), carry.sort_values("lo")
    lower = carry["lo"] < knots["k"].iloc[0]
    pairs = [list(side[["n", "s"]].itertuples(index=False, name=None)) for side in (carry[lower], carry[~lower])]
    table = venn_abers_table(list(knots[["k", "n", "s"]].itertuples(index=False, name=None)), *pairs)
    on, after = table[1::2], table[2::2]
    rows = [(k, *a, *b) for k, a, b in zip(knots["k"], on, after)]
    if not lower.any():
        rows.insert(0, (float("-inf"), *table[0], *table[0]))
    return pd.DataFrame(rows, columns=["lo", "on0", "on1", "after0", "after1"])


class VennAbers:
    """Inductive Venn-Abers probabilities from a table over calibration scores (Vovk and Petej 2014).

    Scores are cut into ranges, each range's pools are merged into those of ever longer ranges (``levels``), and a range gets the pools of the
    longest merged ranges that make up everything below and above it: as many rows as a few ranges hold blocks. The probabilities at its own
    scores and between them follow from stacks that start with those pools.
    """

    def __init__(self, steps: Steps):
        self.steps = steps

    @classmethod
    def fit(cls, df: DataFrame, score: str, label: str, max_knots: int | None = None, range_rows: int = RANGE_ROWS) -> VennAbers:
        """Every distinct score is a knot; only on demand (``max_knots``) finer scores share one."""
        knots = materialise(counted(df, score, label))
        if max_knots is not None and knots.count() > max_knots:
            shares = [i / max_knots for i in range(1, max_knots + 1)]
            edges = sorted(set(df.agg(F.percentile_approx(score, shares, 10 * max_knots)).first()[0]))
            cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="k", outputCol="_b")
            knots = cut.transform(knots).groupBy("_b").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s")).drop("_b")
        knots = materialise(ranged(knots, range_rows), columnar=True)
        merged = levels(knots)
        ranges = (knots.agg(F.max("range")).first()[0] or 0) + 1
        carry = cls._carried(merged, ranges)
        table = knots.groupBy("range").cogroup(carry.groupBy("range")).applyInPandas(_abers, _ABERS)
        return cls(Steps.build(materialise(table, columnar=True)))

    @staticmethod
    def _carried(merged: list[DataFrame], ranges: int) -> DataFrame:
        """Per range the pools of all others: those beside it below its parent, beside its parent below the next, and so on."""
        parts = []
        for level, blocks in enumerate(merged[:-1]):
            # a merged range serves all ranges below its siblings
            own, width = F.col("range"), FAN**level
            parent = F.floor(own / FAN)
            below = F.sequence(parent * FAN * width, F.least((parent + 1) * FAN * width, F.lit(ranges)) - 1)
            served = blocks.withColumn("_for", F.explode(below)).filter(F.floor(F.col("_for") / width) != own)
            parts.append(served.select(F.col("_for").cast("long").alias("range"), "lo", "n", "s"))
        out = parts[0] if parts else merged[-1].select("range", "lo", "n", "s").limit(0)
        for part in parts[1:]:
            out = out.union(part)
        return out

    def save(self, path: str) -> None:
        self.steps.save(path)

    @classmethod
    def load(cls, path: str) -> VennAbers:
        return cls(Steps.load(path))

    def transform(self, df: DataFrame, score: str, output: str) -> DataFrame:
        found = self.steps.join(df, score)
        on = F.col("_value") == F.col("_step_lo")
        p0, p1 = (F.when(on, F.col(f"_step_on{v}")).otherwise(F.col(f"_step_after{v}")) for v in (0, 1))
        return found.withColumn(output, p1 / (1 - p0 + p1)).drop("_value", *[f"_step_{c}" for c in ("lo", "on0", "on1", "after0", "after1")])


CALIBRATORS = {"sigmoid": Sigmoid, "isotonic": Isotonic, "vennabers": VennAbers}
