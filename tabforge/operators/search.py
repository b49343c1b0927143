"""Hyper-parameter search, its report, and score curves over sizes or parameter values."""

from __future__ import annotations

import math
import random
import threading
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, wait
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.models import build, cv_scores, evaluator
from tabforge.operators.split import hash_share

# Parameter lists to search, by algorithm.
GRIDS: dict[str, dict[str, list]] = {
    "AB": {"n_estimators": [10, 50, 100, 150, 200], "learning_rate": [0.2, 0.5, 0.7, 1.0, 1.5, 2.0]},
    "CATB": {"learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2], "max_depth": [4, 6, 8, 10], "n_estimators": [100, 200, 500, 1000]},
    "CATBR": {"learning_rate": [0.01, 0.03, 0.05, 0.1, 0.2], "max_depth": [4, 6, 8, 10], "n_estimators": [100, 200, 500, 1000]},
    "GB": {"learning_rate": [0.05, 0.1, 0.15], "n_estimators": [50, 100, 200], "max_depth": [3, 5, 10]},
    "KNN": {"n_neighbors": [3, 5, 7, 10], "weights": ["uniform", "distance"]},
    "LGB": {"n_estimators": [100, 200, 500, 1000], "max_depth": [5, 10, 15, 20], "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.6, 0.8, 1.0]},
    "LGBR": {"n_estimators": [100, 200, 500, 1000], "max_depth": [5, 10, 15, 20], "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.6, 0.8, 1.0]},
    "LOGR": {"reg": [0.0, 1e-5, 1e-4, 1e-3, 1e-2, 0.1], "fit_intercept": [True, False]},
    "LR": {"fit_intercept": [True, False]},
    "LSVC": {"tol": [0.0005, 0.001, 0.005], "max_iter": [500, 1000, 2000]},
    "NB": {"alpha": [0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0, 2.0, 5.0, 10.0]},
    "RF": {"n_estimators": [21, 51, 101, 201, 501], "max_depth": [5, 7, 10, 20], "min_samples_leaf": [1, 2, 3], "bootstrap": [True, False], "criterion": ["gini", "entropy"]},
    "RBF": {"C": [10.0 ** e for e in range(-2, 11)], "gamma": [10.0 ** e for e in range(-9, 4)], "tol": [0.0005, 0.001, 0.005]},
    "SVM": {"C": [10.0 ** e for e in range(-2, 11)], "gamma": [10.0 ** e for e in range(-9, 4)], "tol": [0.0005, 0.001, 0.005]},
    "XGB": {"n_estimators": [21, 51, 101, 201, 501], "max_depth": [5, 6, 7, 8, 9, 10, 12, 15, 20], "learning_rate": [0.01, 0.02, 0.05, 0.1, 0.2], "subsample": [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]},
    "XT": {"n_estimators": [21, 51, 101, 201, 501, 1001, 2001], "max_depth": [3, 5, 7, 10, 20, 30], "min_samples_leaf": [1, 2], "bootstrap": [True, False]},
}


def trials(grid: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """Up to n distinct parameter choices, drawn at random from the grid."""
    names = list(grid)
    every = [dict(zip(names, values)) for values in product(*grid.values())]
    return every if len(every) <= n else random.Random(seed).sample(every, n)


def search(df: DataFrame, algo: str, spec: dict, scorer: str, fold: str, folds: int, n_trials: int,
           grid: Mapping[str, Sequence] | None = None, seed: int = 0, timeout: float | None = None, parallelism: int = 2) -> tuple[dict, DataFrame]:
    """Best parameters, and one row per finished trial: params, mean, std, rank. Trials without a defined score come last.

    ``parallelism`` trials run at a time. After ``timeout`` seconds no trial begins, and the jobs of running ones are cancelled by their tags; what
    finished before counts. Without any finished trial the parameters are {}, the algorithm's defaults.
    """
    label = spec.get("label", "label")
    better = evaluator(scorer, label)[1]
    context, run, stop = df.sparkSession.sparkContext, uuid.uuid4().hex, threading.Event()
    choices = trials(GRIDS[algo] if grid is None else grid, n_trials, seed)

    def trial(i: int) -> tuple[dict, float, float] | None:
        if stop.is_set():
            return None
        context.addJobTag(f"{run}-{i}")
        try:
            scores = cv_scores(df, build(algo, spec, **choices[i]), scorer, fold, folds, label, spec.get("key"), spec.get("group"))
        except Exception:
            if stop.is_set():  # cancelled
                return None
            raise
        finally:
            context.removeJobTag(f"{run}-{i}")
        mean = sum(scores) / folds
        return choices[i], mean, (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(trial), i) for i in range(len(choices))]
        open_ = wait(running, timeout).not_done
        if open_:
            stop.set()
            while wait(running, 0.2).not_done:  # a trial between two jobs is met by the next round
                for i, work in enumerate(running):
                    if not work.done():
                        context.cancelJobsWithTag(f"{run}-{i}")
    rows = [r for r in (work.result() for work in running) if r]
    rows.sort(key=lambda r: (math.isnan(r[1]), 0.0 if math.isnan(r[1]) else -r[1] if better else r[1], str(r[0])))
    out = [(i, str(p), float(m), float(s)) for i, (p, m, s) in enumerate(rows, 1)]
    return rows[0][0] if rows else {}, df.sparkSession.createDataFrame(out, "rank int, params string, mean double, std double")


def report(results: DataFrame, n_top: int = 3) -> DataFrame:
    return results.orderBy("rank").limit(n_top)


def _curve_row(scores_train: Sequence[float], scores_cv: Sequence[float]) -> tuple[float, float, float, float]:
    out = []
    for s in (scores_train, scores_cv):
        m = sum(s) / len(s)
        out += [m, (sum((x - m) ** 2 for x in s) / len(s)) ** 0.5]
    return tuple(float(x) for x in out)


def _both_scores(df: DataFrame, estimator, spec: dict, scorer: str, fold: str, folds: int, label: str, keep=None):
    judge, _ = evaluator(scorer, label, spec.get("key"), spec.get("group"))
    on_train, on_test = [], []
    for i in range(folds):
        train, test = df.filter(F.col(fold) != i), df.filter(F.col(fold) == i)
        train = train if keep is None else train.filter(keep)
        model = estimator.fit(train)
        on_train.append(judge.evaluate(model.transform(train)))
        on_test.append(judge.evaluate(model.transform(test)))
    return _curve_row(on_train, on_test)


_CURVE = "train_mean double, train_std double, cv_mean double, cv_std double"


def learning_curve(df: DataFrame, algo: str, spec: dict, scorer: str, key: str, fold: str, folds: int,
                   shares: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0)) -> DataFrame:
    """Training and held-out scores for growing shares of the training rows (nested hash samples)."""
    label = spec.get("label", "label")
    rows = []
    for s in shares:
        rows.append((float(s), *_both_scores(df, build(algo, spec), spec, scorer, fold, folds, label, hash_share(key, 97) < s)))
    return df.sparkSession.createDataFrame(rows, "share double, " + _CURVE)


def validation_curve(df: DataFrame, algo: str, spec: dict, scorer: str, fold: str, folds: int, name: str, values: Sequence) -> DataFrame:
    """Training and held-out scores for each value of one parameter."""
    label = spec.get("label", "label")
    rows = [(str(v), *_both_scores(df, build(algo, spec, **{name: v}), spec, scorer, fold, folds, label)) for v in values]
    return df.sparkSession.createDataFrame(rows, "value string, " + _CURVE)
