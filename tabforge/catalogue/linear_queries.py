"""Validation, search, selection and curve tables of linear regressions, whose fits SQL can write out (N21, Q01, Q02, V04-V08, F07-F09, O04, O05)."""

from pyspark.sql import functions as F

from tabforge.catalogue.registry import query, table
from tabforge.operators import curves, models, search, split
from tabforge.operators.frame import positive_importances, top_n
from tabforge.operators.unsupervised import assemble
from tabforge.plans.scale import materialise

_BOTH = ["x1", "x2"]
_SPEC = {"key": "key"}
_MSE = "neg_mean_squared_error"

# Orders: two numbers and a target, three folds by key hash, and the hash that learning curves draw their samples by.
_D = """d as materialized (select o_orderkey as key, o_custkey / 1000.0::double as x1, month(o_orderdate)::double as x2, o_totalprice / 100000.0::double as y,
  ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::bigint % 3 as fold, (('0x' || substr(md5('97:' || o_orderkey), 1, 8))::bigint)::double / 4294967296.0::double as h from orders),
k as (select unnest([0, 1, 2]) as k)"""


def _lines(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), (F.col("o_custkey") / 1000.0).alias("x1"), F.month("o_orderdate").cast("double").alias("x2"),
        (F.col("o_totalprice") / 100000.0).alias("label"))
    return split.add_folds(rows, "key", 3)


def _vectors(spark, sf, columns):
    return materialise(assemble(_lines(spark, sf), columns).select("key", "label", "fold", "features"))


def _one(name, x, by, rows, through=False):
    """SQL: per ``by``, intercept ``a`` and slopes ``b1``, ``b2`` of y on one number of ``rows`` (``through``: a line through the origin)."""
    slope = f"sum({x} * y) / sum({x} * {x})" if through else f"regr_slope(y, {x})"
    cut = "0.0::double" if through else f"regr_intercept(y, {x})"
    b1, b2 = (slope, "0.0::double") if x == "x1" else ("0.0::double", slope)
    return f"{name} as materialized (select {by} as g, {cut} as a, {b1} as b1, {b2} as b2 from {rows} group by 1)"


def _two(name, by, rows):
    """SQL: the same on both numbers, from their moments."""
    return f"""{name}m as (select {by} as g, avg(x1) m1, avg(x2) m2, avg(y) my, var_pop(x1) s11, var_pop(x2) s22, covar_pop(x1, x2) s12,
  covar_pop(x1, y) s1, covar_pop(x2, y) s2 from {rows} group by 1),
{name}n as (select *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from {name}m),
{name} as materialized (select g, my - b1 * m1 - b2 * m2 as a, b1, b2 from {name}n)"""


_TRAIN = "d join k on fold <> k"
_ERROR = "avg(pow(y - a - b1 * x1 - b2 * x2, 2))"


def _errors(name, fit):
    """SQL: the mean squared error of each fold under the fit on the others."""
    return f"{name} as (select g, {_ERROR} as e from {fit} join d on fold = g group by g)"


@query("n21_cross_validation_linear", f"""with {_D}, {_two('f', 'k', _TRAIN)}, {_errors('e', 'f')}
select g as fold, round(e, 9) as score from e""")
def n21(spark, sf):
    scores = models.cv_scores(_vectors(spark, sf, _BOTH), models.build("LR", _SPEC), _MSE, "fold", 3)
    return spark.createDataFrame(list(enumerate(scores)), "fold int, score double").withColumn("score", F.round("score", 9))


_SEARCH = f"""with {_D}, {_one('f', 'x1', 'k', _TRAIN)}, {_one('o', 'x1', 'k', _TRAIN, True)}, {_errors('ef', 'f')}, {_errors('eo', 'o')},
r as (select '{{''fit_intercept'': True}}' as params, avg(e) as mean, stddev_pop(e) as std from ef
  union all select '{{''fit_intercept'': False}}', avg(e), stddev_pop(e) from eo)
select (row_number() over (order by mean))::int as rank, params, round(mean, 9) as mean, round(std, 9) as std from r"""


def _searched(spark, sf):
    return search.search(_vectors(spark, sf, ["x1"]), "LR", _SPEC, _MSE, "fold", 3, 100)[1]


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("q01_search_linear", _SEARCH)
def q01(spark, sf):
    """The whole parameter list of linear regression."""
    return _rounded(_searched(spark, sf), "mean", "std")


@query("q02_report_linear", _SEARCH)
def q02(spark, sf):
    return _rounded(search.report(_searched(spark, sf)), "mean", "std")


_SCORES = ("train_mean", "train_std", "cv_mean", "cv_std")


@query("v04_learning_curve_linear", f"""with {_D}, s as (select unnest([0.1, 0.325, 0.55, 0.775, 1.0])::double as share),
t as materialized (select * from d join k on fold <> k join s on h < share),
f as (select share, k, regr_intercept(y, x1) as a, regr_slope(y, x1) as b from t group by share, k),
e as (select f.share, f.k, avg(pow(y - a - b * x1, 2)) filter (fold <> f.k and h < f.share) as own, avg(pow(y - a - b * x1, 2)) filter (fold = f.k) as held from f, d group by f.share, f.k)
select share, round(avg(own), 9) as train_mean, round(stddev_pop(own), 9) as train_std, round(avg(held), 9) as cv_mean, round(stddev_pop(held), 9) as cv_std from e group by share""")
def v04(spark, sf):
    return _rounded(search.learning_curve(_vectors(spark, sf, ["x1"]), "LR", _SPEC, _MSE, "key", "fold", 3), *_SCORES)


@query("v05_validation_curve_linear", f"""with {_D}, {_one('f', 'x1', 'k', _TRAIN)}, {_one('o', 'x1', 'k', _TRAIN, True)},
m as (select 'True' as value, * from f union all select 'False', * from o),
e as (select value, g, avg(pow(y - a - b1 * x1, 2)) filter (fold <> g) as own, avg(pow(y - a - b1 * x1, 2)) filter (fold = g) as held from m, d group by value, g)
select value, round(avg(own), 9) as train_mean, round(stddev_pop(own), 9) as train_std, round(avg(held), 9) as cv_mean, round(stddev_pop(held), 9) as cv_std from e group by value""")
def v05(spark, sf):
    return _rounded(search.validation_curve(_vectors(spark, sf, ["x1"]), "LR", _SPEC, _MSE, "fold", 3, "fit_intercept", (True, False)), *_SCORES)


@query("f07_lofo_linear", f"""with {_D}, {_two('f', 'k', _TRAIN)}, {_one('p', 'x2', 'k', _TRAIN)}, {_one('q', 'x1', 'k', _TRAIN)},
{_errors('ef', 'f')}, {_errors('ep', 'p')}, {_errors('eq', 'q')},
r as (select 'x1' as feature, ep.e - ef.e as gain from ef join ep using (g) union all select 'x2', eq.e - ef.e from ef join eq using (g))
select feature, round(avg(gain), 9) as importance, round(stddev_pop(gain), 9) as std, avg(gain) > 0 as keep from r group by feature""")
def f07(spark, sf):
    return _rounded(models.lofo(materialise(_lines(spark, sf)), _BOTH, "LR", _SPEC, _MSE, "fold", 3), "importance", "std")


@query("f08_rfe_linear", f"""with {_D}, {_two('f', 'k', _TRAIN)}, {_one('p', 'x1', 'k', _TRAIN)}, {_one('q', 'x2', 'k', _TRAIN)}, {_two('w', '0', 'd')},
{_errors('ef', 'f')}, {_errors('ep', 'p')}, {_errors('eq', 'q')},
s as (select case when abs(b1) < abs(b2) or (abs(b1) = abs(b2)) then 'x2' else 'x1' end as strong from w),
j as (select strong, (select avg(e) from ef) as whole, case when strong = 'x1' then (select avg(e) from ep) else (select avg(e) from eq) end as one from s)
select feature, 'rfe' as kind, feature = strong or whole < one as keep, (1 + (feature = strong)::int)::int as rounds from j, (select unnest(['x1', 'x2']) as feature)""")
def f08(spark, sf):
    return models.eliminate(materialise(_lines(spark, sf)), _BOTH, "LR", _SPEC, _MSE, "fold", 3)


_IMPORTANT = f"""with {_D}, {_two('w', '0', 'd')}
select 'x1' as feature, round(abs(b1), 9) as importance from w union all select 'x2', round(abs(b2), 9) from w"""


def _importances(spark, sf):
    model = models.build("LR", _SPEC).fit(_vectors(spark, sf, _BOTH))
    return models.importance_table(spark, model, _BOTH)


@query("f09_v06_importances_linear", _IMPORTANT)
def f09(spark, sf):
    return _rounded(top_n(_importances(spark, sf), 20, F.desc("importance"), F.col("feature")), "importance")


@query("o05_positive_importances_linear", _IMPORTANT)
def o05(spark, sf):
    return _rounded(positive_importances(_importances(spark, sf)), "importance")


@query("o04_largest_importance", f"select * from ({_IMPORTANT}) order by importance desc limit 1")
def o04(spark, sf):
    return _rounded(positive_importances(_importances(spark, sf), n=1), "importance")


@query("v07_partial_dependence_linear", f"""with {_D}, {_two('w', '0', 'd')}, z as (select min(x1) low, max(x1) high, avg(x2) m2, count(*) n from d)
select round(low + i * (high - low) / 49, 9) as value, round(a + b1 * (low + i * (high - low) / 49) + b2 * m2, 8) as mean_prediction, n::bigint as n
from w, z, (select unnest(range(50)) as i)""")
def v07(spark, sf):
    df = _lines(spark, sf)
    model = models.build("LR", _SPEC).fit(assemble(df, _BOTH))
    out = curves.partial_dependence(model, df, "x1", lambda d: assemble(d, _BOTH))
    return out.select(F.round("value", 9).alias("value"), F.round("mean_prediction", 8).alias("mean_prediction"), "n")


@query("v08_boundary_linear", f"""with {_D}, {_two('w', '0', 'd')}, z as (select min(x1) l1, max(x1) h1, min(x2) l2, max(x2) h2 from d),
c as (select l1 + i * (h1 - l1) / 99 as x1, l2 + j * (h2 - l2) / 99 as x2 from z, (select unnest(range(100)) as i), (select unnest(range(100)) as j))
select round(x1, 9) as x1, round(x2, 9) as x2, round(a + b1 * x1 + b2 * x2, 8) as prediction from c, w""")
def v08(spark, sf):
    df = _lines(spark, sf)
    model = models.build("LR", _SPEC).fit(assemble(df, _BOTH))
    out = curves.boundary_grid(model, df, "x1", "x2", lambda d: assemble(d, _BOTH))
    return out.select(F.round("x1", 9).alias("x1"), F.round("x2", 9).alias("x2"), F.round("prediction", 8).alias("prediction"))
