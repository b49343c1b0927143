"""Blocked running sums, shifts and exact quantiles against plain windows and NumPy."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.plans import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """Three thousand rows; one group holds a third of them, one timestamp a third of that."""
    k = F.col("id")
    group = F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (k % 50).cast("string")))
    group = F.when(k % 97 == 0, None).otherwise(group)
    ts = F.when(k % 9 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)))
    return spark.range(3000).select(
        F.col("id").alias("key"), group.alias("g"), ts.alias("ts"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10).alias("v"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("inclusive", [True, False])
def test_blocked_running_sums_equal_one_window(skewed, inclusive):
    order = [F.col("ts"), F.col("key")]
    args = (skewed, ["g"], order, {"s": F.col("ts"), "n": F.lit(1)})
    plain = scale.prefix_sums(*args, inclusive=inclusive)
    blocked = scale.prefix_sums(*args, inclusive=inclusive, block_rows=100)
    assert rows(plain, "key", "s", "n") == rows(blocked, "key", "s", "n")


def test_running_sum_over_the_whole_table(skewed):
    order = [F.col("ts").desc(), F.col("key")]
    plain = scale.prefix_sums(skewed, [], order, {"s": F.col("ts")})
    blocked = scale.prefix_sums(skewed, [], order, {"s": F.col("ts")}, block_rows=77)
    assert rows(plain, "key", "s") == rows(blocked, "key", "s")


def test_blocked_shifts_equal_one_window(skewed):
    order = [F.col("ts"), F.col("key")]
    w = W.partitionBy("g").orderBy(*order)
    want = skewed.withColumns({"b": F.lag("v", 3).over(w), "a": F.lead("v", 2).over(w)})
    got = scale.shifted(skewed, ["g"], order, {"b": (F.col("v"), 3), "a": (F.col("v"), -2)}, block_rows=60)
    key = lambda r: r[0]
    assert sorted(map(tuple, want.select("key", "b", "a").collect()), key=key) == sorted(
        map(tuple, got.select("key", "b", "a").collect()), key=key)


def test_blocked_work_is_spread(skewed):
    """No block of the split path holds more than a few times the wanted rows."""
    ranged = skewed.repartitionByRange(30, "g", "ts", "key").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 400


@pytest.mark.parametrize("gather,distinct", [(10, 0), (100_000, 0), (10, 20), (10, 10**6)])
def test_exact_quantiles(spark, gather, distinct):
    rng = np.random.default_rng(0)
    a = rng.normal(size=2001)
    b = np.where(rng.random(2001) < 0.4, 3.0, rng.integers(0, 8, 2001)).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(5)
    df = df.unionAll(spark.createDataFrame([(None, float("nan"))], "a double, b double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = scale.exact_quantiles(df, ["a", "b"], probs, gather=gather, distinct=distinct)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)))
    assert got["b"] == pytest.approx(list(np.quantile(b, probs)))


def test_exact_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert scale.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_grouped_quantiles(skewed):
    got = {r.g: r.m for r in scale.grouped_quantiles(skewed, ["g"], "v", {"m": 0.3}, block_rows=50).collect()}
    pdf = skewed.toPandas()
    want = pdf.groupby("g", dropna=False)["v"].quantile(0.3)
    for g, v in want.items():
        assert got[g if isinstance(g, str) else None] == pytest.approx(v)


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_keeps_all_rows_with_and_without_broadcast(skewed, limit):
    lookup = skewed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    joined = scale.lookup_join(skewed, lookup, "g", max_rows=limit)
    assert joined.count() == 3000
    assert joined.filter("n is null").count() == 0
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan.lower()) == (limit > 0)


def test_broadcast_check_measures_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert scale.fits(wide, rows=10)
    assert not scale.fits(wide, rows=9)
    assert not scale.fits(wide, rows=10, size=500_000)


def test_hash_is_stable_under_partitioning(spark):
    df = spark.range(100).select("id", scale.hash32("id", 7).alias("h"))
    assert rows(df, "id", "h") == rows(df.repartition(7), "id", "h")
