"""Encoders, imputation, tests and selection against hand-worked or brute-force values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.functions.tails import chi2_tail, f_tail
from tabforge.operators import encode, frame, rowstats, scaling, selection, sequence, variables
from tabforge.plans import scale


@pytest.fixture(scope="module")
def cats(spark):
    rows = [(1, "a", 1.0), (2, "a", 0.0), (3, "b", 1.0), (4, "b", 1.0), (5, "b", 0.0), (6, None, 0.0), (7, "c", 1.0)]
    return spark.createDataFrame(rows, "k int, c string, y double")


@pytest.mark.parametrize("name", sorted(encode.ENCODERS))
def test_unseen_and_missing_categories(spark, cats, name):
    maker = encode.ENCODERS[name]
    args = (["c"], "y") if issubclass(maker, encode._TargetFitter) else (["c"],)
    model = maker(*args).fit(cats)
    new = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "k int, c string")
    out = model.transform(new)
    assert out.count() == 3 and "c" not in out.columns
    made = [c for c in out.columns if c != "k"]
    assert made and out.filter(" or ".join(f"`{c}` is null" for c in made)).isEmpty()
    fallback = {"ordinal": -1, "target": 4 / 7, "mestimate": 4 / 7, "jstein": 4 / 7, "leaveone": 4 / 7, "catboost": 4 / 7, "woe": 0.0}
    if name in fallback:
        assert out.filter("k = 2").first()[made[0]] == pytest.approx(fallback[name])


def test_leave_one_out_and_ordered_statistics(cats):
    got = {r.k: r.c_t for r in encode.LeaveOneOutEncoder(["c"], "y").fit_transform(cats).collect()}
    prior = 4 / 7
    assert got == pytest.approx({1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5, 5: 1.0, 6: prior, 7: prior})
    ordered = encode.CatBoostEncoder(["c"], "y")
    got = {r.k: r.c_t for r in ordered.fit_transform(cats, [F.col("k")]).collect()}
    want = {1: prior, 2: (1 + prior) / 2, 3: prior, 4: (1 + prior) / 2, 5: (2 + prior) / 3, 6: prior, 7: prior}
    assert got == pytest.approx(want)
    again = {r.k: r.c_t for r in ordered.fit_transform(cats, [F.col("k")], block_rows=1).collect()}
    assert again == pytest.approx(want)


def test_contrast_conventions(spark):
    df = spark.createDataFrame([(x,) for x in "abcd"], "c string")
    got = {}
    for cls in (encode.BackwardDifferenceEncoder, encode.HelmertEncoder, encode.SumEncoder, encode.PolynomialEncoder):
        out = cls(["c"], keep=True).fit(df).transform(df).orderBy("c")
        got[cls.__name__] = np.array([[r[f"c_c{j}"] for j in (1, 2, 3)] for r in out.collect()])
    for m in got.values():
        assert np.allclose(m.sum(axis=0), 0)
    for m in (got["HelmertEncoder"], got["PolynomialEncoder"]):
        g = m.T @ m
        assert np.allclose(g, np.diag(np.diag(g)))
    full = np.column_stack([np.ones(4), got["BackwardDifferenceEncoder"]])
    assert np.allclose(np.linalg.inv(full)[1:], [[-1, 1, 0, 0], [0, -1, 1, 0], [0, 0, -1, 1]])
    poly = got["PolynomialEncoder"]
    assert np.allclose(poly.T @ poly, np.eye(3)) and (poly[-1] > 0).all()


def test_encoder_save_and_load(spark, cats, tmp_path):
    model = encode.TargetEncoder(["c"], "y").fit(cats)
    model.save(str(tmp_path / "e"))
    back = encode.EncoderModel.load(spark, str(tmp_path / "e"))
    key = lambda r: r.k
    assert sorted(model.transform(cats).collect(), key=key) == sorted(back.transform(cats).collect(), key=key)


def test_row_shape_statistics_of_normal_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 1, (400, 40))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, a array<double>")
    row = rowstats.shape_statistics(df, "a").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("sp_skew_test", "sp_kurtosis_test") for n, f in (("m", F.avg), ("s", F.stddev))],
        F.avg("sp_geometric_mean").alias("g"), F.avg("sp_standard_error_of_mean").alias("e")).first()
    assert abs(row.m_sp_skew_test) < 0.15 and abs(row.s_sp_skew_test - 1) < 0.15
    assert abs(row.m_sp_kurtosis_test) < 0.25 and abs(row.s_sp_kurtosis_test - 1) < 0.15
    assert row.g == pytest.approx(np.exp(np.log(x).mean(1)).mean())
    assert row.e == pytest.approx((x.std(1, ddof=1) / math.sqrt(40)).mean())


@pytest.mark.parametrize("values,name,want", [
    ([1, 2, 3, 4, 5, 6, 7, 8], "sp_skew_test", 1.0108048609177787), ([2, 8, 0, 4, 1, 9, 9, 0], "sp_skew_test", 0.44626385374196975),
    (list(range(20)), "sp_kurtosis_test", -1.7058104152122062)])
def test_published_test_statistics(spark, values, name, want):
    df = spark.createDataFrame([([float(v) for v in values],)], "a array<double>")
    assert rowstats.shape_statistics(df, "a").first()[name] == pytest.approx(want)


def test_row_statistics_of_columns_equal_those_of_an_array(spark):
    names = [f"c{i}" for i in range(9)]
    df = spark.range(20).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) + 1.0).alias(c) for i, c in enumerate(names)])
    df = df.withColumn("arr", F.array(*names))
    a = rowstats.shape_statistics(df, names).orderBy("id").select(*rowstats.SHAPE_NAMES).toPandas()
    b = rowstats.shape_statistics(df, "arr").orderBy("id").select(*rowstats.SHAPE_NAMES).toPandas()
    assert np.allclose(a.to_numpy(float), b.to_numpy(float))


def test_constant_and_negative_rows(spark):
    df = spark.createDataFrame([(1.0,) * 8, (-1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)], ", ".join(f"c{i} double" for i in range(8)))
    rows = rowstats.shape_statistics(df, df.columns).orderBy("c0").collect()
    assert rows[0].sp_geometric_mean is None
    assert rows[1].sp_geometric_mean == pytest.approx(1.0) and rows[1].sp_skew is None and rows[1].sp_variation == 0.0
    done = rowstats.scipy_features(df, df.columns)
    assert done.count() == 2


def test_imputer_by_type(spark):
    df = spark.createDataFrame(
        [(1.0, 1, "x", True), (float("nan"), 2, None, None), (3.0, 2, "y", False), (float("inf"), None, "y", True)],
        "f double, i int, s string, b boolean")
    got = scaling.fit_imputer(df).transform(df).collect()
    assert [r.f for r in got] == [1.0, 2.0, 3.0, 2.0] and [r.i for r in got] == [1, 2, 2, 2]
    assert got[1].s == "NULLTEXT" and got[1].b is None


def test_float_factor(spark):
    df = spark.createDataFrame([(1.25, ), (-3.0,), (None,)], "x double")
    assert [r.v for r in df.select(variables.float_factor("x", 2).alias("v")).collect()] == [125, 300, 0]


def test_sequence_needs_no_particular_group_size(spark):
    df = spark.range(600).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("g"),
        (F.col("id") % 7).alias("t"), F.xxhash64("id").alias("x"), F.xxhash64("id", F.lit(2)).alias("y"))
    args = dict(target="y", date="t", key="k", forecast_period=3, n_lags=2, group="g")
    a, b = sequence.sequence_frame(df, **args), sequence.sequence_frame(df, **args, block_rows=25)
    assert a.columns == ["t", "k", "g", "x[-1]", "x[-2]", "y"] or set(a.columns) == {"t", "k", "g", "x[-1]", "x[-2]", "y"}
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_latest_lag_and_roots(spark):
    df = spark.range(1).select("id", F.lit(1).alias("x[-2]"), F.lit(2).alias("x[-1]"), F.lit(3).alias("y"))
    assert variables.latest_lag(df, "x") == "x[-1]"
    assert frame.drop_by_root(df, ["x"]).columns == ["id", "y"]
    with pytest.raises(KeyError):
        variables.latest_lag(df, "z")


def test_append_columns_refuses_other_rows(spark):
    a, b = spark.range(5), spark.range(4).withColumn("v", F.lit(1))
    with pytest.raises(IndexError):
        frame.append_columns(a, b, "id")


def test_tail_probabilities():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(40.0, 2) == pytest.approx(math.exp(-20))
    assert f_tail(4.102821015303716, 2, 10) == pytest.approx(0.05)
    assert f_tail(161.4476387975881, 1, 1) == pytest.approx(0.05)


def test_selection_modes(spark):
    scores = spark.createDataFrame([("a", 9.0, 0.001), ("b", 4.0, 0.03), ("c", 1.0, 0.4), ("d", 9.0, 0.001)], "feature string, score double, pvalue double")
    keep = lambda *a: selection.kept(selection.support(scores, *a))
    assert keep("percentile", 50) == ["a", "d"] and keep("kbest", 1) == ["a"]
    assert keep("fpr", 0.05) == ["a", "b", "d"] and keep("fwe", 0.05) == ["a", "d"] and keep("fdr", 0.05) == ["a", "b", "d"]


def test_interactions_never_square(spark):
    df = spark.range(50).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9)).cast("double").alias(c) for i, c in enumerate("abc")], (F.col("id") % 2).alias("y"))
    model = selection.fit_interactions(df, ["a", "b", "c"], "y", 100, 3)
    assert model.names == ["a*b", "a*c", "b*c", "a*b*c"]
    row = model.transform(df).agg(*[F.abs(F.avg(f"`{n}`")).alias(str(i)) for i, n in enumerate(model.names)]).first()
    assert max(row) < 1e-12


def test_blocked_positions_are_complete(spark):
    df = spark.range(1000).withColumn("g", F.lit("one"))
    got = scale.positions(df, ["g"], [F.desc("id")], "p", block_rows=64)
    assert got.filter(F.col("p") != 1000 - F.col("id")).isEmpty() and got.count() == 1000


@pytest.mark.parametrize("name", ["onehot", "backdiff", "helmert", "sum", "polynomial"])
def test_level_vectors_equal_level_columns(spark, tmp_path, name):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["d", "a", None, "b", "c", "a"])], "k long, c string")
    new = df.union(spark.createDataFrame([(9, "zz")], df.schema))
    maker = encode.ENCODERS[name]
    columns = maker(["c"]).fit(df).transform(new)
    made = [c for c in columns.columns if c != "k"]
    fitted = maker(["c"], vectors=True).fit(df)
    fitted.save(str(tmp_path / "v"))
    vectors = encode.LevelVectors.load(spark, str(tmp_path / "v")).transform(new)
    want = {r.k: [float(r[c]) for c in made] for r in columns.collect()}
    got = {r.k: r.c_levels.toArray().tolist() for r in vectors.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert got[9] == [0.0] * len(made)


@pytest.mark.parametrize("name", ["onehot", "backdiff", "helmert", "sum", "polynomial"])
def test_fifty_thousand_levels(spark, name):
    k = 50_000
    df = spark.range(1, k + 1).select(F.format_string("%06d", "id").alias("c"))
    fitted = encode.ENCODERS[name](["c"], vectors=True).fit(df)
    levels = [1, 2, 400, 25_000, k - 1, k]
    rows = fitted.transform(spark.createDataFrame([(i, f"{i:06d}") for i in levels] + [(0, "none")], "i long, c string")).collect()
    got = {r.i: r.c_levels.toArray() for r in rows}
    size = k if name == "onehot" else k - 1
    assert all(len(v) == size for v in got.values()) and not got[0].any()
    j = np.arange(1, k)
    for i in levels:
        if name == "onehot":
            assert got[i].sum() == 1 and got[i][i - 1] == 1
        elif name == "backdiff":
            assert np.allclose(got[i], np.where(i <= j, -(k - j) / k, j / k))
        elif name == "helmert":
            assert np.allclose(got[i], np.where(i <= j, -1.0, np.where(i == j + 1, j, 0.0)))
        elif name == "sum":
            assert (got[i] == (np.full(k - 1, -1.0) if i == k else (j == i))).all()
    if name == "polynomial":  # rows of an orthogonal matrix, but for its constant column
        m = np.array([got[i] for i in levels])
        assert np.allclose(m @ m.T + 1 / k, np.eye(len(levels)), atol=1e-9)


def test_polynomials_are_orthonormal():
    for k in (2, 5, 40, 700):
        q = np.array([encode.polynomial_row(i, k) for i in range(1, k + 1)])
        assert np.abs(q.T @ q - np.eye(k)).max() < 1e-12


def test_many_classes(spark):
    """Fifty thousand labels and classes: codes, ANOVA and chi-squared as plain arithmetic gives them."""
    k = 50_000
    rng = np.random.default_rng(1)
    y = np.concatenate([np.arange(k), rng.integers(0, k, 30_000)])
    x, z = rng.random(len(y)) + y / k, rng.integers(0, 9, len(y)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(y)), "y": 3 * y, "x": x, "z": z}))
    coded = encode.LabelEncoder("y").fit(df).transform(df)
    assert coded.columns == df.columns and dict(coded.dtypes)["y"] == "int"
    assert coded.join(df.select("i", F.col("y").alias("w")), "i").filter("y * 3 <> w").isEmpty()
    n, sizes = len(y), np.bincount(y)
    sums = {c: np.bincount(y, weights=v) for c, v in (("x", x), ("z", z))}
    anova = {r.feature: r.score for r in selection.f_classif(df, ["x", "z"], "y").collect()}
    squared = {r.feature: r.score for r in selection.chi2(df, ["x", "z"], "y").collect()}
    for c, v in (("x", x), ("z", z)):
        between = (sums[c] ** 2 / sizes).sum() - v.sum() ** 2 / n
        within = (v**2).sum() - v.sum() ** 2 / n - between
        assert anova[c] == pytest.approx((between / (k - 1)) / (within / (n - k)), rel=1e-9)
        expected = sizes / n * v.sum()
        assert squared[c] == pytest.approx(((sums[c] - expected) ** 2 / expected).sum(), rel=1e-9)


def test_labels_keep_null_and_unseen_values_null(spark):
    fitted = encode.LabelEncoder("y").fit(spark.createDataFrame([("b",), ("a",), (None,)], "y string"))
    rows = fitted.transform(spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7), (4, "c", 8)], "k int, y string, _code int")).orderBy("k").collect()
    assert [(r.y, r._code) for r in rows] == [(0, 5), (1, 6), (None, 7), (None, 8)]


def test_factorize_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_BYTES", 1)
    texts = ["b" * 5000, "a" * 9000, None, "", "c", "b" * 5000] + [f"{i:05d}" for i in range(2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.t for r in encode.factorize(df, ["t"]).collect()}
    order = {t: n for n, t in enumerate(sorted({"NULLTEXT" if t is None else t for t in texts}))}
    assert got == {i: order["NULLTEXT" if t is None else t] for i, t in enumerate(texts)}
