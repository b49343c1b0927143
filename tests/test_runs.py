"""Whole training runs: every algorithm, every scorer, searches, selection."""

import math

import pytest
from pyspark.sql import functions as F

from tabforge.operators import metrics, models, search
from tabforge.operators.unsupervised import assemble
from tabforge.plans.training import load_run, train
from tabforge.sources import io

SMALL = {
    "AB": {"n_estimators": 3}, "XGB": {"n_estimators": 3}, "XGBM": {"n_estimators": 2, "max_depth": 3}, "XGBR": {"n_estimators": 3, "max_depth": 3},
    "RFR": {"max_depth": 4}, "XT": {"max_depth": 4}, "XTR": {"max_depth": 4},
}
BASE = {"key": "key", "target": "y", "features": ["a", "b"], "estimators": 3, "cv_folds": 2, "params": SMALL}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(160).select(
        F.col("id").alias("key"), ((F.col("id") * 37) % 101 / 101).alias("a"), ((F.col("id") * 53) % 97 / 97).alias("b"), (F.col("id") % 5).alias("g"))
    return rows.withColumn("s", F.round(3 * F.col("a") + F.col("b"), 2)).cache()


def labelled(df, kind):
    y = {"classification": (F.col("s") > 2).cast("double"), "multiclass": F.least(F.floor("s"), F.lit(2)).cast("double")}.get(kind, F.col("s"))
    return df.withColumn("y", y).drop("s")


def run(table, kind, **more):
    rows = labelled(table, kind)
    spec = {**BASE, "model_type": kind, **more}
    return train(spec, rows.filter("key % 4 <> 0"), rows.filter("key % 4 = 0"))


KINDS = sorted((kind, algo) for algo, (kind, _) in models.ALGORITHMS.items()) + [("ranking", "XGRK"), ("multiclass", "RF"), ("multiclass", "KNN")]


@pytest.mark.parametrize(("kind", "algo"), KINDS)
def test_every_algorithm_runs(table, kind, algo):
    out = run(table, kind, algorithms=[algo], group="g" if kind == "ranking" else None)
    assert out.best == algo and out.predictions.filter(F.col(f"pred_{algo}").isNull()).isEmpty()
    assert out.metrics.filter("partition = 'test' AND value IS NOT NULL").count() > 0
    assert all(not math.isnan(s) for s in out.notes["cv"].get(algo, []))


@pytest.mark.parametrize("scorer", sorted(metrics.SCORERS))
def test_every_scorer_judges(table, scorer):
    kind = metrics.SCORERS[scorer][0]
    rows = assemble(labelled(table, kind), ["a", "b"]).withColumn("fold", (F.col("key") % 2).cast("int"))
    estimator = models.build("LOGR" if kind == "classification" else "LR", {"label": "y"})
    scores = models.cv_scores(rows, estimator, scorer, "fold", 2, "y", "key", "g")
    assert len(scores) == 2 and not any(math.isnan(s) for s in scores)


@pytest.mark.parametrize("scorer", ["neg_brier_score", "ndcg_score"])
def test_scorers_in_a_run(table, scorer):
    kind = metrics.SCORERS[scorer][0]
    algo = "LOGR" if kind == "classification" else "LR"
    out = run(table, kind, algorithms=[algo], scorer=scorer, group="g" if kind == "ranking" else None)
    assert out.best == algo and len(out.notes["cv"][algo]) == 2


@pytest.mark.parametrize(("kind", "algo"), [("regression", "RFR"), ("regression", "KNR"), ("classification", "RBF"), ("multiclass", "XGBM")])
def test_searches_run_or_are_left_out(table, kind, algo):
    out = run(table, kind, algorithms=[algo], grid_search=2)
    assert (algo in out.notes["params"]) == (algo in search.GRIDS)


def test_selection_around_models_that_rank_nothing(table):
    out = run(table, "classification", algorithms=["KNN"], lofo=True, rfe=1)
    assert out.notes["lofo"]["KNN"].count() == 2 and "KNN" not in out.notes["rfe"]


def test_best_model_comes_from_cross_validation(table):
    out = run(table, "regression", algorithms=["LR", "RFR"])
    means = {a: sum(s) for a, s in out.notes["cv"].items()}
    assert out.best == max(means, key=means.get)


def test_multiclass_run_is_saved_and_votes(spark, table, tmp_path):
    out = run(table, "multiclass", algorithms=["RF", "XGBM", "NB"])
    out.save(spark, str(tmp_path / "run"))
    new = labelled(table, "multiclass").drop("y")
    got = load_run(spark, str(tmp_path / "run")).score(new).collect()
    assert len(got) == 160
    for r in got:
        votes = [r.pred_RF, r.pred_XGBM, r.pred_NB]
        assert r.pred_BLEND == min(votes, key=lambda v: (-votes.count(v), v))


def test_cross_validated_area_is_exact(spark):
    rows = spark.range(4000).select(F.col("id").alias("key"), (F.hash("id") % 1000003 / 1000003.0).alias("x"), (F.col("id") % 2).alias("fold"))
    rows = rows.withColumn("y", (F.col("x") + F.xxhash64("key") % 1000 / 1000.0 > 0).cast("double"))

    class Same:
        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumn("positive", F.col("x")).withColumn("prediction", (F.col("x") > 0).cast("double"))

    for scorer in ("roc_auc", "average_precision"):
        got = models.cv_scores(rows, Same(), scorer, "fold", 2, "y")
        want = [metrics.curve_metrics(rows.filter(F.col("fold") == i), "y", "x").filter(F.col("metric") == scorer).first()["value"] for i in (0, 1)]
        assert got == pytest.approx(want, abs=1e-12)


def test_no_local_folder_on_a_cluster():
    from tabforge.plans.scale import shared_folder

    class Context:
        master = "spark://host:1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    Session.conf = type("Conf", (), {"get": lambda self, name, other: other})()
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Session())


def test_a_run_keeps_what_it_found(spark, table, tmp_path):
    out = run(table, "classification", algorithms=["LOGR", "RF"], lofo=True, rfe=1, grid_search=2, group=None)
    out.save(spark, str(tmp_path / "r1"), str(tmp_path / "runs"))
    back = load_run(spark, io.latest_run(spark, str(tmp_path / "runs")))
    plain = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert plain(back.predictions) == plain(out.predictions) and plain(back.metrics) == plain(out.metrics.select(*back.metrics.columns))
    assert back.notes["cv"] == out.notes["cv"] and back.best == out.best
    for kind in ("lofo", "rfe", "importances"):
        assert set(back.notes[kind]) == set(out.notes[kind]) and all(plain(back.notes[kind][a]) == plain(t) for a, t in out.notes[kind].items())
    assert {a: p for a, (p, _) in back.notes["params"].items()} == {a: p for a, (p, _) in out.notes["params"].items()}
    ranked = spark.read.parquet(str(tmp_path / "r1" / "ranked"))
    assert ranked.count() == out.predictions.count() and back.ranking in ranked.columns
    sample = spark.createDataFrame([(4, 0.0), (8, 0.0), (10_000, 0.0)], "key long, score double")
    got = {r.key: r.score for r in back.submission(sample).collect()}
    want = {r.key: r[back.ranking] for r in out.predictions.filter("partition = 'test'").collect()}
    assert got == {4: want[4], 8: want[8], 10_000: None}


def test_one_table_is_split(table):
    rows = labelled(table, "regression")
    spec = {**BASE, "model_type": "regression", "algorithms": ["LR"], "split": 0.3}
    out = train(spec, rows)
    sizes = {r.partition: r["count"] for r in out.predictions.groupBy("partition").count().collect()}
    assert sizes["train"] + sizes["test"] == 160 and 20 < sizes["test"] < 80
    late = train({**spec, "split_by": "time", "date": "d", "drop": ["d"]}, rows.withColumn("d", F.col("key"))).predictions
    assert late.filter("partition = 'test'").agg(F.min("key")).first()[0] > late.filter("partition = 'train'").agg(F.max("key")).first()[0]


def test_a_panel_is_put_in_sequence(table):
    rows = labelled(table, "regression").withColumn("d", F.floor(F.col("key") / 5))
    spec = {**BASE, "model_type": "regression", "algorithms": ["LR"], "features": "*", "date": "d", "group": "g", "lags": 2, "forecast": 1, "leaders": ["b"]}
    out = train(spec, rows)
    assert {"a[-1]", "a[-2]", "y[-1]", "y[-2]", "b"} <= set(out.plan.parts["final"]) and "a" not in out.plan.parts["final"]
    assert out.predictions.count() == 160


@pytest.mark.parametrize("how", [{"sampling": "undersample"}, {"sampling": "oversample"}, {"class_weights": True}])
def test_rare_classes_are_balanced(table, how):
    rows = table.withColumn("y", ((F.col("key") % 8 == 0) & (F.col("a") > 0.2)).cast("double")).drop("s")
    spec = {**BASE, "algorithms": ["LOGR"], "features": ["a", "b"]}
    plain, balanced = (train({**spec, **more}, rows.filter("key % 4 <> 1"), rows.filter("key % 4 = 1")).predictions for more in ({}, how))
    share = lambda p: p.filter("partition = 'train'").agg(F.avg("prob_LOGR")).first()[0]
    assert balanced.count() == plain.count() == 160 and share(balanced) > share(plain) + 0.15


def test_weights_are_refused_where_they_have_no_place():
    with pytest.raises(ValueError, match="weights"):
        models.build("AB", {"weight": "w"})


def doubled(column):
    """A user's transform: named columns from one column."""
    return {"twice": 2 * column, "squared": column * column}


def test_user_transforms(spark, table, tmp_path):
    out = run(table, "regression", algorithms=["LR"], features=["a", "b", "a_twice", "a_squared"], transforms=[("a", "tests.test_runs:doubled")])
    assert {"a_twice", "a_squared"} <= set(out.plan.parts["final"])
    out.save(spark, str(tmp_path / "r"))
    rows = labelled(table, "regression")
    a, b = (sorted(map(tuple, r.score(rows).collect())) for r in (out, load_run(spark, str(tmp_path / "r"))))
    assert a == b
