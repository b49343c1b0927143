"""Training and scoring runs: features, models, calibration, blend, metrics, saved artefacts."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import metrics, models, search, sequence, split
from tabforge.operators.blending import blend_class_probabilities, blend_classes, blend_predictions, blend_probabilities
from tabforge.operators.calibration import CALIBRATORS
from tabforge.operators.frame import quoted
from tabforge.operators.neighbours import NeighbourModel
from tabforge.operators.selection import kept
from tabforge.operators.unsupervised import assemble
from tabforge.plans.features import FeaturePlan
from tabforge.plans.scale import materialise
from tabforge.sources import io

# Run settings next to those of the feature plan. ``best_on``: choose the best model by "cv" or on the "test" rows;
# ``split`` (share of test rows), ``split_by`` ("key", "time"), ``lags``, ``forecast``, ``leaders``, ``lag_target``: see ``partitions``;
# ``sampling`` ("undersample", "oversample") and ``class_weights``: the rows that models are fitted on.
RUN_DEFAULTS: dict = {
    "algorithms": ["RF"], "estimators": 51, "seed": 42, "cv_folds": 3, "scorer": None, "params": {}, "grid_search": 0, "search_seconds": None,
    "calibration": None, "stopping_share": None, "lofo": False, "rfe": None, "best_on": "cv",
    "split": 0.25, "split_by": "key", "lags": 0, "forecast": None, "leaders": [], "lag_target": True, "sampling": None, "class_weights": False,
}
# The scorer of each kind of model when none is named.
SCORER = {"classification": "roc_auc", "multiclass": "accuracy", "ranking": "ndcg_score", "regression": "r2"}


# Models of this package that save and load themselves; all others use the ML library's format.
OWN_MODELS = {
    c.__name__: c
    for c in (models.AdaBoostModel, models.ExtraTreesModel, models.KernelSVCModel, models.PairwiseRankerModel, models.ScaledBayesModel, models.SoftmaxBoostModel,
              NeighbourModel)
}


class ScoredModel:
    """A fitted model with the columns its predictions come from, and an optional calibrator."""

    def __init__(self, algo: str, model, classify: bool, calibrator=None, columns: list[str] | None = None):
        self.algo, self.model, self.classify, self.calibrator = algo, model, classify, calibrator
        self.columns = columns

    def scores(self, df: DataFrame, key: str) -> DataFrame:
        """(key, pred_<algo>[, prob_<algo>]): only what later steps need is kept."""
        # a model fitted on selected features gets a vector of those alone
        out = self.model.transform(assemble(df.drop("features"), self.columns) if self.columns else df)
        pred = F.col("prediction").alias(f"pred_{self.algo}")
        if not self.classify:
            shares = [vector_to_array("probability").alias(f"prob_{self.algo}")] if "probability" in out.columns else []
            return out.select(key, pred, *shares)
        out = out.withColumn("_score", models.positive_score(out))
        if self.calibrator is None:
            return out.select(key, pred, F.col("_score").alias(f"prob_{self.algo}"))
        out = self.calibrator.transform(out, "_score", "_cal")
        return out.select(key, (F.col("_cal") > 0.5).cast("double").alias(f"pred_{self.algo}"), F.col("_cal").alias(f"prob_{self.algo}"))


def _calibrated(df: DataFrame, estimator, method: str, spec: Mapping, fold: str):
    """Model fitted for calibration, and the calibrator fitted on rows that model did not see."""
    label, key = spec["target"], spec["key"]
    if method == "vennabers":
        fit_rows, held = split.train_test_split(df, key, 0.2, spec["seed"] + 1)
        model = estimator.fit(fit_rows)
        held = model.transform(held)
    else:
        held = models.out_of_fold(df, estimator, fold, spec["cv_folds"])
        model = estimator.fit(df)
    held = held.select(F.col(label).cast("double").alias(label), models.positive_score(held).alias("_score"))
    return model, CALIBRATORS[method].fit(held, "_score", label)


class Run:
    """Result of a training run."""

    def __init__(self, plan: FeaturePlan, spec: Mapping, scored: list[ScoredModel], predictions: DataFrame, metric_table: DataFrame,
                 best: str | None, notes: dict):
        self.plan, self.spec, self.models, self.predictions = plan, spec, scored, predictions
        self.metrics, self.best, self.notes = metric_table, best, notes

    def score(self, df: DataFrame) -> DataFrame:
        return score_rows(self.plan, self.models, self.spec, df)

    def save(self, spark: SparkSession, path: str, registry: str | None = None) -> None:
        """Plan, models and calibrators, and what the run found: predictions (also ranked by the best model), metrics, importances, elimination
        and search tables. ``registry`` names the run table that ``io.latest_run`` looks in."""
        self.plan.save(spark, f"{path}/features")
        self._save_tables(path)
        kinds = {}
        for m in self.models:
            target = f"{path}/model_{m.algo}"
            own = type(m.model).__name__ if type(m.model).__name__ in OWN_MODELS else None
            if own:
                m.model.save(target)
            else:
                m.model.write().overwrite().save(target)
            method = next((k for k, c in CALIBRATORS.items() if isinstance(m.calibrator, c)), None)
            if method:
                m.calibrator.save(f"{path}/calibrator_{m.algo}")
            kinds[m.algo] = [m.classify, m.columns, own, method]
        notes = {kind: list(self.notes.get(kind, {})) for kind in TABLES}
        chosen = {algo: found[0] for algo, found in self.notes.get("params", {}).items()}
        state = json.dumps({"spec": self.spec, "kinds": kinds, "best": self.best, "notes": notes, "cv": self.notes.get("cv", {}), "chosen": chosen,
                            "tables": [n for n in ("predictions", "metrics") if getattr(self, n) is not None]})
        spark.createDataFrame([(state,)], "state string").write.mode("overwrite").parquet(f"{path}/run")
        if registry:
            io.record_run(spark, registry, path.rstrip("/").rsplit("/", 1)[-1], path)


    def _save_tables(self, path: str) -> None:
        if self.predictions is not None:
            self.predictions.write.mode("overwrite").partitionBy("partition").parquet(f"{path}/predictions")
            best = self.ranking
            if best:
                io.ranked_predictions(self.predictions.select(self.spec["key"], "partition"), self.predictions.drop("partition"), self.spec["key"], best).write.mode(
                    "overwrite").parquet(f"{path}/ranked")
        if self.metrics is not None:
            io.save_metrics(self.metrics, f"{path}/metrics")
        for kind in TABLES:
            for algo, found in self.notes.get(kind, {}).items():
                table = found[1] if kind == "params" else found
                table.write.mode("overwrite").parquet(f"{path}/{kind}_{algo}")

    @property
    def ranking(self) -> str | None:
        """The column that ranks predictions: the best model's probability, else its prediction."""
        names = [f"prob_{self.best}", f"pred_{self.best}"]
        return next((n for n in names if self.predictions is not None and n in self.predictions.columns), None)

    def submission(self, sample: DataFrame, partition: str = "test") -> DataFrame:
        """The sample with its second column taken from the best model's predictions of the same ids."""
        rows = self.predictions.filter(F.col("partition") == partition)
        return io.submission(sample, rows.select(self.spec["key"], self.ranking), self.ranking)


# Tables by algorithm that a run keeps: search results, LOFO and elimination tables, importances.
TABLES = ("params", "lofo", "rfe", "importances")


def load_run(spark: SparkSession, path: str) -> Run:
    """The run as it was saved; its tables are read when they are used."""
    state = json.loads(spark.read.parquet(f"{path}/run").first()["state"])
    scored = []
    for algo, (classify, columns, own, method) in state["kinds"].items():
        source = f"{path}/model_{algo}"
        model = OWN_MODELS[own].load(source) if own else DefaultParamsReader.loadParamsInstance(source, spark)
        calibrator = CALIBRATORS[method].load(f"{path}/calibrator_{algo}") if method else None
        scored.append(ScoredModel(algo, model, classify, calibrator, columns))
    tables = {n: spark.read.parquet(f"{path}/{n}") if n in state["tables"] else None for n in ("predictions", "metrics")}
    notes: dict = {kind: {a: spark.read.parquet(f"{path}/{kind}_{a}") for a in algos} for kind, algos in state["notes"].items()}
    notes["params"] = {a: (state["chosen"][a], t) for a, t in notes["params"].items()}
    notes["cv"] = state["cv"]
    return Run(FeaturePlan.load(spark, f"{path}/features"), state["spec"], scored, tables["predictions"], tables["metrics"], state["best"], notes)


def score_rows(plan: FeaturePlan, scored: list[ScoredModel], spec: Mapping, df: DataFrame) -> DataFrame:
    """Predictions of all models (and their blend) for new rows, one row per key."""
    ready = plan.transform(df)
    if len(scored) > 1:
        ready = materialise(ready, columnar=True)
    return _blend(_join_scores(ready, scored, spec["key"]), scored, spec)


def _join_scores(ready: DataFrame, scored: list[ScoredModel], key: str) -> DataFrame:
    out = scored[0].scores(ready, key)
    for m in scored[1:]:
        out = out.join(m.scores(ready, key), key)
    return out


def _blend(df: DataFrame, scored: list[ScoredModel], spec: Mapping) -> DataFrame:
    if len(scored) < 2:
        return df
    if scored[0].classify:
        return blend_probabilities(df, [f"prob_{m.algo}" for m in scored], "prob_BLEND", "pred_BLEND")
    if spec["model_type"] == "multiclass":
        df = blend_classes(df, [f"pred_{m.algo}" for m in scored], "pred_BLEND")
        shares = [f"prob_{m.algo}" for m in scored]
        return blend_class_probabilities(df, shares, "prob_BLEND") if set(shares) <= set(df.columns) else df
    return blend_predictions(df, [f"pred_{m.algo}" for m in scored], "pred_BLEND")


def _metric_table(df: DataFrame, spec: Mapping, algos: list[str]) -> DataFrame:
    parts = []
    for partition in ("train", "test"):
        rows = df.filter(F.col("partition") == partition)
        for a in algos:
            if spec["model_type"] == "classification":
                t = metrics.classification_metrics(rows, spec["target"], f"pred_{a}", f"prob_{a}")
            elif spec["model_type"] == "multiclass":
                t = metrics.classification_metrics(rows, spec["target"], f"pred_{a}")
                if f"prob_{a}" in rows.columns:
                    t = t.unionAll(metrics.multiclass_log_loss(rows, spec["target"], f"prob_{a}"))
            elif spec["model_type"] == "ranking":
                t = metrics.ranking_metrics(rows, spec["target"], f"pred_{a}", spec["key"], [spec["group"]])
            else:
                t = metrics.regression_metrics(rows, spec["target"], f"pred_{a}")
            parts.append(t.select(F.lit(a).alias("algo"), F.lit(partition).alias("partition"), "metric", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _best(table: DataFrame, cv: Mapping[str, list[float]], algos: list[str], scorer: str, on: str) -> str | None:
    """Best algorithm by mean cross-validation score; by the test rows, else the training rows, where asked or not every score is defined."""
    means = {a: sum(cv[a]) / len(cv[a]) for a in algos if cv.get(a)}
    if on == "cv" and len(means) == len(algos) and not any(math.isnan(m) for m in means.values()):
        sign = -1.0 if metrics.SCORERS[scorer][1] else 1.0
        return min(means, key=lambda a: (sign * means[a], a))
    for partition in ("test", "train"):
        row = metrics.best_algorithm(table, scorer, partition).first()
        if row is not None and row["algo"] is not None:
            return row["algo"]
    return None


def partitions(spec: Mapping, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one table: by time where the specification names a date and lags or ``split_by="time"``, else by a hash of the key.

    With ``lags`` (or a ``forecast``) the table is first put in sequence: lagged columns per group, the target of ``forecast`` rows ahead.
    """
    spec = {**RUN_DEFAULTS, **spec}
    sequenced = bool(spec["lags"] or spec["forecast"])
    if sequenced:
        rows = sequence.sequence_frame(rows, spec["target"], spec["date"], spec["key"], spec["forecast"] or 1, spec["lags"], list(spec["leaders"]),
                                       spec.get("group"), lag_target=spec["lag_target"])
        rows = materialise(rows, columnar=True)
    if spec["split_by"] == "time" or sequenced:
        boundary = sequence.split_date(rows, spec["date"], spec["split"])
        late = quoted(spec["date"]) > F.lit(boundary)
        return rows.filter(~late), rows.filter(late)
    return split.train_test_split(rows, spec["key"], spec["split"], spec["seed"])


def _sampled(spec: Mapping, rows: DataFrame) -> DataFrame:
    """Training rows balanced by class as the specification asks: ``undersample`` or ``oversample``."""
    if spec["sampling"] is None:
        return rows
    return {"undersample": split.undersample, "oversample": split.oversample}[spec["sampling"]](rows, spec["key"], spec["target"], seed=spec["seed"] + 2)  # another seed than the split has


def train(spec: Mapping, train_rows: DataFrame, test_rows: DataFrame | None = None) -> Run:
    """Fit the feature plan and every algorithm on training rows; score and judge both partitions.

    Without ``test_rows`` the specification splits (and, with lags, sequences) the one table: see ``partitions``.

    The training table in model form is written to the checkpoint folder once:
    cross-validation, elimination and search read it many times. Search is left out for algorithms without a
    parameter list, elimination for those that rank no features; the pairwise ranker takes part in neither.
    """
    spec = {**RUN_DEFAULTS, **spec}
    plan = FeaturePlan(spec)
    spec = {**spec, **plan.spec}
    if test_rows is None:
        train_rows, test_rows = partitions(spec, train_rows)
    classify = spec["model_type"] == "classification"
    scorer = spec["scorer"] or SCORER[spec["model_type"]]
    key, target, folds = spec["key"], spec["target"], spec["cv_folds"]

    ready = plan.fit_transform(train_rows.filter(quoted(target).isNotNull()))
    if spec["model_type"] in ("classification", "multiclass"):
        ready = split.add_stratified_folds(ready, key, target, folds, spec["seed"])
    else:
        ready = split.add_folds(ready, key, folds, spec["seed"])
    if spec["stopping_share"]:
        ready = split.mark_validation(ready, key, spec["stopping_share"], spec["seed"])
    if spec["class_weights"]:
        ready = split.class_weights(ready, target, "weight")
    ready = materialise(ready, columnar=True)
    fitting = _sampled(spec, ready)
    fitting = ready if fitting is ready else materialise(fitting, columnar=True)
    columns = list(plan.parts["final"])
    build_spec = {"features": "features", "label": target, "key": key, "group": spec["group"], "estimators": spec["estimators"], "seed": spec["seed"]}
    if spec["class_weights"]:
        build_spec["weight"] = "weight"
    notes: dict = {"cv": {}, "params": {}, "lofo": {}, "rfe": {}, "importances": {}}

    scored = []
    for algo in spec["algorithms"]:
        params = dict(spec["params"].get(algo, {}))
        if algo == "XGRK":
            ranker = models.PairwiseRanker(columns, spec["group"], target, **params)
            scored.append(ScoredModel(algo, ranker.fit(fitting), False))
            continue
        local = dict(build_spec)
        if spec["stopping_share"] and algo.startswith(("XGB", "LGB", "CATB", "GB")):
            local["validation"] = "validation"
        use = columns
        if spec["lofo"]:
            notes["lofo"][algo] = models.lofo(fitting, use, algo, build_spec, scorer, "fold", folds)
            use = [c for c in use if c in set(kept(notes["lofo"][algo]))] or use
        if spec["rfe"] and algo in models.RANKED:
            notes["rfe"][algo] = models.eliminate(fitting, use, algo, build_spec, scorer, "fold", folds, spec["rfe"])
            use = [c for c in use if c in set(kept(notes["rfe"][algo]))]
        chosen = use if len(use) < len(columns) else None
        data = assemble(fitting.drop("features"), use) if chosen else fitting
        if spec["grid_search"] and algo in search.GRIDS:
            params, table = search.search(data, algo, local, scorer, "fold", folds, spec["grid_search"], seed=spec["seed"],
                                           timeout=spec["search_seconds"])
            notes["params"][algo] = (params, table)
        estimator = models.build(algo, local, **params)
        notes["cv"][algo] = models.cv_scores(data, estimator, scorer, "fold", folds, target, key, spec["group"])
        if classify and spec["calibration"]:
            model, calibrator = _calibrated(data, estimator, spec["calibration"], spec, "fold")
        else:
            model, calibrator = estimator.fit(data), None
        scored.append(ScoredModel(algo, model, classify, calibrator, chosen))
        last = model.stages[-1] if isinstance(model, PipelineModel) else model
        if hasattr(last, "featureImportances") or hasattr(last, "coefficients"):
            notes["importances"][algo] = models.importance_table(ready.sparkSession, model, use)

    parts = []
    for name, rows in (("train", ready), ("test", materialise(plan.transform(test_rows), columnar=True))):
        got = _blend(_join_scores(rows, scored, key), scored, spec)
        carried = [c for c in (target, spec["group"]) if c and c in rows.columns]
        parts.append(rows.select(key, *carried).join(got, key).withColumn("partition", F.lit(name)))
    predictions = materialise(parts[0].unionByName(parts[1], allowMissingColumns=True), columnar=True)
    algos = [m.algo for m in scored] + (["BLEND"] if len(scored) > 1 else [])
    table = _metric_table(predictions, spec, algos)
    best = _best(table, notes["cv"], [m.algo for m in scored], scorer, spec["best_on"])
    return Run(plan, spec, scored, predictions, table, best, notes)
