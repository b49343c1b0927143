"""Step functions of a score, kept as tables: numbered ranges, pools of adjacent violators, and the range that holds a value.

Pools are mergeable: the monotone fit of two neighbouring ranges together is the fit of their pooled blocks. So each range of consecutive
scores is pooled on its own, and neighbouring ranges are merged, ``FAN`` at a time, up to one. Labels between 0 and 1 that are counted in whole
rows leave at most about N^(2/3) blocks of N rows (corners of a convex chain of lattice points), far fewer than scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.plans.scale import fits, materialise, positions, prefix_sums, shifted

# Scores of one range: handled by one task.
RANGE_ROWS = 131_072
FAN = 8
# Cuts that lead a value to its range; held by the driver and each task.
CUTS = 16_384
# Ranges between two cuts, while there are cuts to spare.
PER_CUT = 16

BLOCKS = "lo double, hi double, n double, s double"


def counted(df: DataFrame, score: str, label: str) -> DataFrame:
    """``k, n, s``: every distinct score with its rows and the sum of their labels; rows without score or label are left out."""
    k = F.col(score).cast("double")
    rows = df.select(F.when(~F.isnan(k), k).alias("k"), F.col(label).cast("double").alias("_y")).filter("k IS NOT NULL AND _y IS NOT NULL")
    return rows.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s"))


def ranged(knots: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``range``: consecutive scores, ``rows`` of them each."""
    total = knots.count()
    if total <= rows:
        return knots.withColumn("range", F.lit(0).cast("long"))
    numbered = positions(knots, [], [F.col("k")], "_pos")
    return numbered.withColumn("range", F.floor((F.col("_pos") - 1) / F.lit(rows)).cast("long")).drop("_pos")


def pool(blocks: Sequence[tuple]) -> list[tuple]:
    """Pools (lo, hi, n, s), in order, until their means increase."""
    out: list[tuple] = []
    for lo, hi, n, s in blocks:
        while out and out[-1][3] * n >= s * out[-1][2]:
            first, _, m, t = out.pop()
            lo, n, s = first, n + m, s + t
        out.append((lo, hi, n, s))
    return out


def _pooled(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("lo")
    out = pd.DataFrame(pool(list(part[["lo", "hi", "n", "s"]].itertuples(index=False, name=None))), columns=["lo", "hi", "n", "s"])
    return out.assign(range=key[0])[["range", "lo", "hi", "n", "s"]]


def levels(knots: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """``range, lo, hi, n, s`` of the pools of each range of ``ranged`` scores, then of each ``fan`` ranges, up to one for all."""
    blocks = knots.select("range", F.col("k").alias("lo"), F.col("k").alias("hi"), "n", "s")
    out = []
    while True:
        out.append(materialise(blocks.groupBy("range").applyInPandas(_pooled, f"range long, {BLOCKS}"), columnar=True))
        if not (out[-1].agg(F.max("range")).first()[0] or 0):
            return out
        blocks = out[-1].withColumn("range", F.floor(F.col("range") / F.lit(fan)).cast("long"))


def pools(df: DataFrame, score: str, label: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``lo, hi, n, s``: the blocks of the increasing fit of the label on the score."""
    return levels(ranged(materialise(counted(df, score, label)), rows))[-1].drop("range")


class Steps:
    """A table with one row per range of values; ``lo`` is where a range begins, and it ends where the next one does.

    A table that was measured to be small is broadcast: a value finds its range by an equi-join on the coarse cuts between which it lies (at
    most ``CUTS`` of them, by binary search) and the bounds of the few ranges there. For a larger one, every distinct value is given the number
    of its range by a running count over values and beginnings together. Values before the first range belong to it.
    """

    def __init__(self, table: DataFrame, cuts: Sequence[float], small: bool):
        self.table, self.cuts, self.small = table, list(cuts), small

    @classmethod
    def build(cls, rows: DataFrame, following: Sequence[str] = ()) -> Steps:
        """From rows with distinct ``lo``; ``next_<c>`` is added for the columns named in ``following``."""
        numbered = positions(rows, [], [F.col("lo")], "_pos")
        total = numbered.count()
        per = max(PER_CUT, math.ceil(total / CUTS))
        ahead = {"_to": (F.col("lo"), -1)} | {f"next_{c}": (F.col(c), -1) for c in following}
        table = shifted(numbered, [], [F.col("lo")], ahead).withColumn("_cut", F.floor((F.col("_pos") - 1) / F.lit(per)).cast("double"))
        table = materialise(table.withColumn("_from", F.when(F.col("_pos") > 1, F.col("lo"))).withColumnRenamed("_pos", "_number"), columnar=True)
        cuts = [r[0] for r in table.groupBy("_cut").agg(F.min("lo").alias("lo")).filter("_cut > 0").orderBy("_cut").select("lo").collect()]
        return cls(table, cuts, fits(table))

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        spark.createDataFrame([(self.cuts, self.small)], "cuts array<double>, small boolean").write.mode("overwrite").parquet(f"{path}/cuts")

    @classmethod
    def load(cls, path: str) -> Steps:
        spark = SparkSession.active()
        note = spark.read.parquet(f"{path}/cuts").first()
        return cls(spark.read.parquet(f"{path}/table"), note["cuts"], note["small"])

    def join(self, df: DataFrame, value: str) -> DataFrame:
        """``df`` with ``_value`` (the value as double) and the columns of its range; these are null for a null or NaN value."""
        names = [c for c in self.table.columns if not c.startswith("_")]
        # a stream has no running counts, a table saved before ranges were numbered has no numbers
        if not self.small and not df.isStreaming and "_number" in self.table.columns:
            return self._numbered(df, value, names)
        side = self.table.withColumnsRenamed({c: f"_step_{c}" for c in names} | {"_cut": "_step_cut"})
        infinity = float("inf")
        splits = [-infinity, *self.cuts, infinity] if self.cuts else [-infinity, 0.0, infinity]
        found = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket", handleInvalid="keep").transform(df.withColumn("_value", F.col(value).cast("double")))
        bucket = F.col("_bucket") if self.cuts else F.when(F.col("_bucket") < 2, F.lit(0.0)).otherwise(F.lit(2.0))
        at = F.col("_value")
        match = (bucket == F.col("_step_cut")) & (F.col("_from").isNull() | (at >= F.col("_from"))) & (F.col("_to").isNull() | (at < F.col("_to")))
        match &= ~F.isnan(at)
        out = found.join(F.broadcast(side) if self.small else side, match, "left")
        return out.drop("_bucket", "_step_cut", "_from", "_to", "_number")

    def _numbered(self, df: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
        """The join of a large table: equi-joins by value and by number only."""
        found = df.withColumn("_value", F.col(value).cast("double"))
        values = materialise(found.select(F.col("_value").alias("_at")).filter("_at IS NOT NULL AND NOT isnan(_at)").distinct(), columnar=True)
        # a range begins before the values that equal its bound
        begins = self.table.filter("_from IS NOT NULL").select(F.col("_from").alias("_at"), F.lit(1).cast("long").alias("_begun"))
        both = begins.union(values.select("_at", F.lit(0).cast("long")))
        counted_up = prefix_sums(both, [], [F.col("_at"), F.desc("_begun")], {"_upto": F.col("_begun")})
        places = counted_up.filter("_begun = 0").select("_at", (F.col("_upto") + 1).alias("_place"))
        side = self.table.select("_number", *[F.col(c).alias(f"_step_{c}") for c in names])
        steps = places.join(side, F.col("_place") == F.col("_number")).drop("_place", "_number")
        return found.join(steps, F.col("_value") == F.col("_at"), "left").drop("_at")
