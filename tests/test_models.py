"""Metrics, models, calibration and whole runs: brute force, invariants, save and load."""

import functools
import itertools

import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabforge.catalogue import model_queries
from tabforge.operators import calibration, curves, metrics, models, neighbours, search, split, text, unsupervised
from tabforge.operators.neighbours import Cells, k_nearest, lsh_nearest
from tabforge.plans import scale, steps
from tabforge.plans.training import load_run, train
from tabforge.sources import io
from tabforge.streaming.score import score_stream, write_scores


def value(df, metric):
    return df.filter(F.col("metric") == metric).first()["value"]


@pytest.fixture(scope="module")
def points(spark):
    """Two classes told apart by two of four numbers; one noisy text and one group."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.5, 600) > 0).astype(float)
    rows = [(i, *map(float, r), float(t), "abc"[i % 3], i % 12) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double, label double, kind string, g long")
    return split.add_folds(df, "key", 3).coalesce(2).persist()


COLS = ["a", "b", "c", "d"]


# -- metrics ---------------------------------------------------------------------


@pytest.mark.parametrize("block", [10, 1_000_000])
def test_pair_counts_by_brute_force(spark, block):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(150) < 0.5, 0, rng.integers(1, 4, 150))
    x, y = rng.integers(0, 9, 150), rng.integers(0, 30, 150)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(g, x, y)], "g int, p int, y int")
    got = {r.g: r for r in metrics.pair_counts(df, "y", "p", ["g"], block_rows=block).collect()}
    for k in set(g):
        pairs = list(itertools.combinations(np.flatnonzero(g == k), 2))
        signs = [np.sign(int(x[i]) - int(x[j])) * np.sign(int(y[i]) - int(y[j])) for i, j in pairs]
        assert got[k].pairs == len(pairs)
        assert got[k].concordant == sum(s > 0 for s in signs) and got[k].discordant == sum(s < 0 for s in signs)


def test_kendall_of_whole_table_and_degenerate_group(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 5, 1), (1, 5, 2)], "g int, y int, p int")
    assert [tuple(r) for r in metrics.kendall_tau(df, "y", "p", ["g"]).collect()] == [(0, 1.0)]
    assert metrics.kendall_tau(df.filter("g = 0"), "y", "p", []).first().kendall_tau == 1.0


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_auc_equals_pair_definition(spark, block):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 120), rng.integers(0, 25, 120) / 25
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert value(metrics.curve_metrics(df, "y", "p", block_rows=block), "roc_auc") == pytest.approx(np.mean(wins))


def test_multiclass_labels(spark):
    t, p = [0, 0, 1, 1, 2, 2, 2, 1], [0, 1, 1, 1, 2, 0, 2, 2]
    df = spark.createDataFrame(list(zip(t, p)), "y int, pred int")
    out = metrics.label_metrics(df, "y", "pred")
    f1 = []
    for c in range(3):
        hit = sum(a == b == c for a, b in zip(t, p))
        f1.append(2 * hit / (t.count(c) + p.count(c)))
    assert value(out, "f1_macro") == pytest.approx(np.mean(f1))
    assert value(out, "f1_weighted") == pytest.approx(sum(f * t.count(c) for c, f in enumerate(f1)) / 8)
    assert value(out, "accuracy") == pytest.approx(5 / 8)


def test_metrics_are_skipped_without_labels(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (None, 0, 0.1)], "y int, pred int, p double")
    assert metrics.classification_metrics(df, "y", "pred", "p").isEmpty()
    assert metrics.regression_metrics(df.fillna(3, ["y"]), "y", "p").isEmpty()


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_dcg_averages_ties(spark, block):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 5, 60), rng.integers(0, 6, 60)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(y, p))], "k int, y int, p int")
    disc = 1 / np.log2(np.arange(60) + 2)
    order = np.argsort(-p, kind="stable")
    gain = sum(y[p == v].mean() * disc[np.flatnonzero(p[order] == v)].sum() for v in set(p))
    got = metrics.dcg(df, "y", "p", "k", block_rows=block).first()
    assert got.dcg_score == pytest.approx(gain)
    assert got.ndcg_score == pytest.approx(gain / (np.sort(y)[::-1] * disc).sum())


def test_best_algorithm_ignores_the_blend(spark):
    rows = [("A", "test", "roc_auc", 0.7), ("B", "test", "roc_auc", 0.8), ("BLEND", "test", "roc_auc", 0.9), ("A", "test", "neg_log_loss", 0.1), ("B", "test", "neg_log_loss", 0.2)]
    df = spark.createDataFrame(rows, "algo string, partition string, metric string, value double")
    assert metrics.best_algorithm(df, "roc_auc", "test").first().algo == "B"
    assert metrics.best_algorithm(df, "neg_log_loss", "test").first().algo == "A"


# -- models -----------------------------------------------------------------------


@pytest.mark.parametrize("algo,params", [
    ("LOGR", {}), ("RF", {}), ("GB", {"n_estimators": 5}), ("LSVC", {"max_iter": 20}), ("NB", {}), ("AB", {"n_estimators": 6}), ("RBF", {}), ("KNN", {}), ("XT", {})])
def test_classifiers_learn(points, algo, params):
    data = unsupervised.assemble(points, COLS)
    out = models.build(algo, {"key": "key", "estimators": 10}, **params).fit(data).transform(data)
    assert value(metrics.label_metrics(out, "label", "prediction"), "accuracy") > (0.5 if algo == "NB" else 0.78)


@pytest.mark.parametrize("algo", ["LR", "RFR", "GBR", "KNR"])
def test_regressors_learn(points, algo):
    data = unsupervised.assemble(points.withColumn("label", 3 * F.col("a") - F.col("b")), COLS)
    params = {"n_estimators": 10} if algo == "GBR" else {}
    out = models.build(algo, {"key": "key", "estimators": 10}, **params).fit(data).transform(data)
    assert value(metrics.regression_metrics(out, "label", "prediction"), "r2") > 0.75


def test_forests_keep_the_nodes_of_rows(spark):
    """A level of a forest starts from the last one's nodes, not from the roots; the panel it reads is written once."""
    spec = {"key": "key", "estimators": 3, "seed": 42}
    assert all(models.build(a, spec).getCacheNodeIds() for a in ("RF", "RFR"))
    assert all(models.build(a, spec).forest.getCacheNodeIds() for a in ("XT", "XTR"))
    plan = model_queries._panel_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "event_id" in plan


def test_neighbour_blocks_equal_broadcast(points):
    data = unsupervised.assemble(points, COLS)
    one = k_nearest(data, data, "features", "key", "key", "label", 4, broadcast=True)
    many = k_nearest(data, data, "features", "key", "key", "label", 4, block=90, broadcast=False)
    assert one.count() == 2400
    cols = ["key", "neighbour", "value"]
    assert one.select(cols).exceptAll(many.select(cols)).isEmpty()


@pytest.mark.parametrize("spread, block", [(0.05, 60), (1.0, 40), (0.0, 30)])
def test_neighbours_by_cells_equal_brute_force(spark, spread, block):
    """Clusters, one cloud and copies of few points; other queries than points, whose keys are the same numbers."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 3))
    points = centres[rng.integers(0, 12, 500)] + spread * rng.standard_normal((500, 3))
    asked = centres[rng.integers(0, 12, 150)] + spread * rng.standard_normal((150, 3))
    frames = [unsupervised.assemble(spark.createDataFrame([(i, *map(float, r), float(i % 3)) for i, r in enumerate(rows)], "key long, a double, b double, c double, label double"),
                                    ["a", "b", "c"]) for rows in (asked, points)]
    for exclude in (True, False):
        near = k_nearest(*frames, "features", "key", "key", "label", 6, block=block, broadcast=False, exclude_self=exclude)
        got = {}
        for r in near.collect():
            got.setdefault(r.key, []).append((r.distance, r.neighbour))
        for i, x in enumerate(asked):
            d = np.sqrt(((points - x) ** 2).sum(axis=1))
            want = sorted(d[j] for j in range(500) if not (exclude and j == i))[:6]
            assert sorted(a for a, _ in got[i]) == pytest.approx(want, abs=1e-7)
            assert all(d[j] == pytest.approx(a, abs=1e-7) for a, j in got[i])


def test_queries_visit_only_cells_in_reach():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 2)) * 10
    cells = Cells(centres)
    points = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 2))
    home, gap = cells.home(points)
    radii = np.full(40, -np.inf)
    np.maximum.at(radii, home, gap)
    limit = np.full(3000, 0.2)
    row, cell = cells.reached(points, radii, limit)
    assert len(row) < 0.1 * 3000 * 40
    visits = set(zip(row.tolist(), cell.tolist()))
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)) if len(points) <= 3000 else None
    for i, j in zip(*np.nonzero(d <= 0.2)):
        assert home[i] == home[j] or (i, home[j]) in visits


def test_lsh_neighbours_are_near(points):
    data = unsupervised.assemble(points, COLS)
    exact = {(r.key, r.neighbour) for r in k_nearest(data, data, "features", "key", "key", "label", 3).collect()}
    found = lsh_nearest(data, data, "features", "key", "key", "label", 3, radius=5.0, bucket_length=4.0)
    rows = found.collect()
    assert all(r.distance < 5.0 and r.key != r.neighbour for r in rows)
    assert len(exact & {(r.key, r.neighbour) for r in rows}) >= 0.9 * len(exact)


@pytest.mark.parametrize("width, block", [(0.5, 50), (6.0, 40)])
def test_lsh_neighbours_equal_all_pairs_of_shared_buckets(spark, width, block):
    """Narrow and wide buckets, larger than a block too; copies, equal keys and equal rows."""
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.standard_normal(3)), float(i % 3)) for i in range(150)]
    rows += [(200 + i, *rows[i][1:4], 1.0) for i in range(20)] + [(7, 0.1, 0.2, 0.3, 0.0), rows[3]]
    data = unsupervised.assemble(spark.createDataFrame(rows, "key long, a double, b double, c double, label double"), ["a", "b", "c"])
    out = lsh_nearest(data, data, "features", "key", "key", "label", 4, radius=1.2, bucket_length=width, tables=3, block=block).collect()
    hashed = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=width, numHashTables=3, seed=42).fit(data).transform(data)
    held = [(r.key, r.features.toArray(), r.label, [v[0] for v in r.h]) for r in hashed.distinct().collect()]
    want = {}
    for a, x, _, h in held:
        for b, y, label, g in held:
            d = float(np.sqrt(((x - y) ** 2).sum()))
            if a != b and d < 1.2 and any(m == n for m, n in zip(h, g)):
                want.setdefault(a, []).append((d, b, label))
    got = {}
    for r in out:
        got.setdefault(r.key, []).append((r.distance, r.neighbour, r.value))
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert sorted(got[key]) == [(pytest.approx(d, abs=1e-12), b, v) for d, b, v in sorted(near)[:4]]


@pytest.mark.parametrize("width, tables, exclude", [(3.0, 1, True), (3.0, 1, False), (6.0, 3, True), (6.0, 3, False)])
def test_blocks_that_meet_are_not_copied(spark, monkeypatch, width, tables, exclude):
    """Large buckets, met one by one or all at once, and cells: no row is copied for each block it meets; the nearest are those of all pairs."""
    plans = []
    stored = neighbours.materialise
    monkeypatch.setattr(neighbours, "materialise", lambda df, **kw: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, **kw))
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.standard_normal(3).astype("float32" if tables == 1 else "float64")), float(i % 3)) for i in range(200)]
    rows += [(300 + i, *rows[i][1:4], 1.0) for i in range(10)] + [(7, 0.1, 0.2, 0.3, 0.0), rows[3], (None, 0.5, 0.25, 0.5, 2.0), (0, 0.5, 0.25, 0.75, 2.0)]
    data = unsupervised.assemble(spark.createDataFrame(rows, "key long, a double, b double, c double, label double"), ["a", "b", "c"])
    found = lsh_nearest(data, data, "features", "key", "key", "label", 4, radius=1.2, bucket_length=width, tables=tables, exclude_self=exclude, block=30).collect()
    hashed = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=width, numHashTables=tables, seed=42).fit(data).transform(data)
    held = [(r.key, r.features.toArray(), r.label, [v[0] for v in r.h]) for r in hashed.distinct().collect()]
    least = lambda key: -1 if key is None else key
    want = {}
    for a, x, _, h in held:
        for b, y, _, g in held:
            d = float(np.sqrt(((x - y) ** 2).sum()))
            if d < 1.2 and (not exclude or None not in (a, b) and a != b) and any(m == n for m, n in zip(h, g)):
                want.setdefault(a, []).append((d, least(b)))
    got = {}
    for r in found:
        got.setdefault(r.key, []).append((r.distance, least(r.neighbour)))
    assert got.keys() == want.keys()
    for key, near in want.items():
        assert sorted(got[key]) == [(pytest.approx(d, abs=1e-12), b) for d, b in sorted(near)[:4]]
    if exclude:
        one = data.filter("key IS NOT NULL").dropDuplicates(["key"])
        near = k_nearest(one, one, "features", "key", "key", "label", 4, block=20, broadcast=False).collect()
        near = {(r.key, r.neighbour): r.distance for r in near}
        assert near == pytest.approx({(r.key, r.neighbour): r.distance for r in k_nearest(one, one, "features", "key", "key", "label", 4, broadcast=True).collect()}, abs=1e-6)
    assert not any("explode(sequence(" in plan for plan in plans)


def test_neighbours_hold_one_tile_of_distances(monkeypatch):
    """The matrix of distances is bounded whatever the numbers of queries, points and cells."""
    held = []
    squares, nearest = neighbours._squares, neighbours._nearest
    monkeypatch.setattr(neighbours, "TILE", 6000)
    monkeypatch.setattr(neighbours, "FIRST", 16)
    monkeypatch.setattr(neighbours, "_squares", lambda a, b: held.append(len(a) * len(b)) or squares(a, b))
    monkeypatch.setattr(neighbours, "_nearest", lambda q, p, *rest: held.append(len(q) * len(p)) or nearest(q, p, *rest))
    rng = np.random.default_rng(8)
    keys, rows = np.arange(700), rng.integers(0, 4, (700, 3)).astype(float)
    best = neighbours._best(keys, rows, keys, rows, np.zeros(700), 5, True)
    cells = Cells(np.unique(rows[:70], axis=0))
    held.clear()
    neighbours._best(keys, rows, keys, rows, np.zeros(700), 5, True)
    home, gap = cells.home(rows)
    assert max(held) <= 6000 and len(best) == 3500
    d = ((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    for i, near in best.groupby("_q"):
        assert near["_p"].tolist() == sorted((j for j in range(700) if j != i), key=lambda j: (d[i, j], j))[:5]
    assert gap == pytest.approx(np.sqrt(((rows - cells.centres[home]) ** 2).sum(axis=1)), abs=1e-7)


def test_pairwise_ranker_equals_regression_over_all_pairs(points):
    pdf = points.toPandas()
    dx, dy = [], []
    for _, part in pdf.groupby("g"):
        x, y = part[["a", "b"]].to_numpy(), (part["c"] + 2 * part["a"]).to_numpy()
        for i, j in itertools.combinations(range(len(part)), 2):
            dx.append(x[i] - x[j])
            dy.append(y[i] - y[j])
    want = np.linalg.lstsq(np.array(dx), np.array(dy), rcond=None)[0]
    model = models.PairwiseRanker(["a", "b"], "g", "t", loss="squared").fit(points.withColumn("t", F.col("c") + 2 * F.col("a")))
    assert np.allclose(model.weights, want)


def test_pairwise_logistic_equals_plain_newton(points, tmp_path):
    """Groups of one block and of many give the fit of a list of all pairs; equal labels form no pair."""
    df = points.withColumn("t", F.round(F.col("c") + F.col("a") - 0.5 * F.col("b"), 0))
    pdf = df.toPandas()
    dx = []
    for _, part in pdf.groupby("g"):
        x, y = part[["a", "b"]].to_numpy(), part["t"].to_numpy()
        dx += [x[i] - x[j] for i, j in itertools.permutations(range(len(part)), 2) if y[i] > y[j]]
    dx, w = np.array(dx), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(dx @ w))
        w = w - np.linalg.solve((dx * (p * (1 - p))[:, None]).T @ dx / len(dx) + 0.01 * np.eye(2), -(dx * p[:, None]).mean(axis=0) + 0.01 * w)
    for block in (2048, 7):
        model = models.PairwiseRanker(["a", "b"], "g", "t", reg=0.01, block=block).fit(df)
        assert np.allclose(model.weights, w, atol=1e-8)
    model.save(str(tmp_path / "r"))
    assert models.PairwiseRankerModel.load(str(tmp_path / "r")).weights == model.weights
    assert models.PairwiseRanker(["a", "b"], "g", "t").fit(df.withColumn("t", F.lit(1.0))).weights == [0.0, 0.0]


def test_pairs_of_kinds_equal_pairs_of_rows(spark, monkeypatch):
    """Few different features: pairs of kinds are counted over ranges of labels, and no block of rows meets another."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 5 == 4 else f"g{i % 5}", float(rng.integers(0, 4)), float(rng.integers(0, 3)), float(rng.integers(0, 40))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, a double, b double, t double")
    ranker = models.PairwiseRanker(["a", "b"], "g", "t", reg=0.01)
    want = {}
    for g, a, b, t in rows:
        for h, c, d, u in rows:
            if g == h and t > u:
                want[(a - c, b - d)] = want.get((a - c, b - d), 0) + 1
    for block in (7, 65_536):
        assert {tuple(r.x): r.n for r in ranker.kind_pairs(df, block).collect()} == want
    plain = models.PairwiseRanker(["a", "b"], "g", "t", reg=0.01, kinds=0)
    assert plain.kind_pairs(df) is None
    by_rows = plain.fit(df).weights
    monkeypatch.setattr(models.PairwiseRanker, "meetings", lambda *a: pytest.fail("rows met"))
    assert ranker.fit(df).weights == pytest.approx(by_rows, abs=1e-9)


def test_pair_sums_of_blocks_equal_those_of_the_group():
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(50, 3)), rng.integers(0, 4, 50).astype(float), rng.normal(size=3)
    whole = models.pair_sums(y, x, 50, w)
    cut = [np.arange(0, 20), np.arange(20, 35), np.arange(35, 50)]
    parts = sum(models.pair_sums(y[c], x[c], len(c), w) for c in cut)
    parts = parts + sum(models.pair_sums(np.concatenate([y[a], y[b]]), np.concatenate([x[a], x[b]]), len(a), w) for a, b in itertools.combinations(cut, 2))
    assert np.allclose(whole, parts)


@pytest.mark.parametrize("algo", ["XT", "XTR"])
def test_extra_trees_cut_at_random(points, algo, tmp_path):
    data = unsupervised.assemble(points, COLS)
    fits = [models.build(algo, {"key": "key", "estimators": 10, "seed": seed}).fit(data) for seed in (1, 1, 2)]
    same, other = fits[0].thresholds() == fits[1].thresholds(), fits[0].thresholds() == fits[2].thresholds()
    assert same and not other and all(len(t) > 3 for t in fits[0].thresholds()[:2])
    assert fits[0].forest.toDebugString == fits[1].forest.toDebugString.replace(fits[1].forest.uid, fits[0].forest.uid)
    fits[0].save(str(tmp_path / "x"))
    back = models.ExtraTreesModel.load(str(tmp_path / "x"))
    a, b = (sorted((r.key, r.prediction) for r in m.transform(data).collect()) for m in (fits[0], back))
    assert a == b
    ranked = dict(models.importances(fits[0], COLS))
    assert ranked["a"] == max(ranked.values()) and sum(ranked.values()) == pytest.approx(1)


def test_importances_lofo_and_elimination(points):
    spec = {"key": "key", "estimators": 5}
    table = models.lofo(points, ["a", "c", "d"], "LOGR", spec, "roc_auc", "fold", 3)
    assert table.orderBy(F.desc("importance")).first().feature == "a"
    kept = models.eliminate(points, COLS, "LOGR", spec, "accuracy", "fold", 3, step=1)
    assert {r.feature for r in kept.filter("keep").collect()} >= {"a"} and kept.count() == 4


def test_search_and_curves(points):
    data = unsupervised.assemble(points, COLS)
    best, table = search.search(data, "LOGR", {"key": "key"}, "roc_auc", "fold", 3, 2, {"reg": [0.0, 50.0]})
    assert best == {"reg": 0.0} and [r.rank for r in search.report(table).collect()] == [1, 2]
    curve = search.learning_curve(data, "LOGR", {"key": "key"}, "balanced_accuracy", "key", "fold", 3, (0.5, 1.0))
    assert curve.filter("train_mean < 0.6").isEmpty() and curve.count() == 2


def test_partial_dependence_is_monotone_for_a_line(points):
    data = points.withColumn("label", 2 * F.col("a"))
    put = lambda d: unsupervised.assemble(d, ["a", "b"])
    model = models.build("LR", {}).fit(put(data))
    rows = curves.partial_dependence(model, data, "a", put, points=5).orderBy("value").collect()
    assert [r.mean_prediction for r in rows] == pytest.approx([2 * r.value for r in rows], abs=1e-6)
    assert all(r.n == 600 for r in rows)


def test_clusters_and_components(points):
    data = unsupervised.assemble(points, COLS)
    assert unsupervised.Clusters.fit(data, "features", 2, 4, 2).transform(data).select("cluster_2", "cluster_4").count() == 600
    scaled = unsupervised.assemble(_standard(points), COLS)
    out = unsupervised.Components.fit(scaled, "features", 1, 3, 1, whiten=True).transform(scaled)
    spread = out.agg(*[F.stddev_samp(c).alias(c) for c in ("pca_1_1", "pca_3_1", "pca_3_3")]).first()
    assert all(v == pytest.approx(1.0) for v in spread)


def _standard(df):
    from tabforge.operators.scaling import fit_standard

    return fit_standard(df, COLS).transform(df)


# -- calibration ----------------------------------------------------------------------


def _isotonic_at(scores, labels, weights, s):
    """Isotonic fit at a score, by pooling adjacent violators over merged equal scores."""
    blocks = []
    for v in sorted(set(scores)):
        idx = [i for i, x in enumerate(scores) if x == v]
        blocks.append([[v], sum(weights[i] for i in idx), sum(weights[i] * labels[i] for i in idx)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return next(b[2] / b[1] for b in blocks if s in b[0])


def test_venn_abers_by_brute_force(spark):
    rng = np.random.default_rng(7)
    s = np.round(rng.random(40), 1)
    y = (rng.random(40) < s).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "s double, y double")
    fitted = calibration.VennAbers.fit(df, "s", "y")
    tests = [-1.0, 0.0, 0.05, 0.3, 0.33, 0.5, 0.77, 0.9, 1.0, 2.0]
    out = {r.s: r.p for r in fitted.transform(spark.createDataFrame([(t,) for t in tests], "s double"), "s", "p").collect()}
    for t in tests:
        p0, p1 = (_isotonic_at([*s, t], [*y, v], [1.0] * 41, t) for v in (0.0, 1.0))
        assert out[t] == pytest.approx(p1 / (1 - p0 + p1)), t


def test_venn_abers_keeps_every_score(spark):
    n = 12_000
    rows = [((i + 0.5) / n, float((i * 7919) % n < i)) for i in range(n)]
    df = spark.createDataFrame(rows, "s double, y double")
    fitted = calibration.VennAbers.fit(df, "s", "y")
    want = calibration.venn_abers_table([(s, 1.0, y) for s, y in rows])
    assert fitted.steps.table.count() == n + 1 and len(fitted.steps.cuts) <= steps.CUTS
    out = {r.s: r.p for r in fitted.transform(df, "s", "p").collect()}
    assert all(out[s] == pytest.approx(p1 / (1 - p0 + p1)) for (s, _), (p0, p1) in zip(rows, want[1::2]))


def _noisy(n, seed, digits=None):
    rng = np.random.default_rng(seed)
    s = rng.random(n) if digits is None else np.round(rng.random(n), digits)
    return [(float(a), float(b)) for a, b in zip(s, rng.random(n) < s**2)]


@pytest.mark.parametrize("rows, range_rows", [
    (_noisy(500, 1), 131_072), (_noisy(500, 1), 7), (_noisy(700, 2, 2), 5), ([(float(i), float(i < 40)) for i in range(80)], 3),
    ([(float(i), float(i >= 40)) for i in range(80)], 3), ([(1.0, 1.0)], 5)])
def test_isotonic_equals_plain_pooling(spark, rows, range_rows):
    """Ranges merged eight at a time give the fit of one list; scores between blocks are interpolated."""
    from pyspark.ml.regression import IsotonicRegression

    df = spark.createDataFrame(rows, "s double, y double")
    fitted = calibration.Isotonic.fit(df, "s", "y", range_rows=range_rows)
    s, y = [a for a, _ in rows], [b for _, b in rows]
    out = {r.s: r.p for r in fitted.transform(df, "s", "p").collect()}
    assert all(out[a] == pytest.approx(_isotonic_at(s, y, [1.0] * len(s), a)) for a in set(s))
    probe = spark.createDataFrame([(float(x),) for x in np.linspace(-1, max(s) + 1, 97)] + [(None,), (float("nan"),)], "s double")
    spans = IsotonicRegression(featuresCol="s", labelCol="y", predictionCol="p").fit(df)
    want = {r.s: r.p for r in spans.transform(probe.filter("s is not null and not isnan(s)")).collect()}
    got = [(r.s, r.p) for r in fitted.transform(probe, "s", "p").collect()]
    assert sum(p is None for _, p in got) == 2 and all(p == pytest.approx(want[x]) for x, p in got if p is not None)


@pytest.mark.parametrize("rows, range_rows", [(_noisy(900, 3), 4), (_noisy(600, 4, 2), 11), ([(float(i), float(i < 150)) for i in range(300)], 6)])
def test_venn_abers_of_many_ranges_equals_one(spark, rows, range_rows, tmp_path):
    df = spark.createDataFrame(rows, "s double, y double")
    probe = spark.createDataFrame([(x,) for x in {a for a, _ in rows} | {float(x) for x in np.linspace(-1, 310, 400)} | {float(x) for x in np.linspace(0, 1, 300)}], "s double")
    one = calibration.VennAbers.fit(df, "s", "y")
    many = calibration.VennAbers.fit(df, "s", "y", range_rows=range_rows)
    many.save(str(tmp_path / "v"))
    many = calibration.VennAbers.load(str(tmp_path / "v"))
    a, b = ({r.s: r.p for r in m.transform(probe, "s", "p").collect()} for m in (one, many))
    assert len(a) == probe.count() and all(a[x] == pytest.approx(b[x]) for x in a)
    knots = sorted({x for x, _ in rows})
    table = calibration.venn_abers_table([(k, float(sum(x == k for x, _ in rows)), sum(y for x, y in rows if x == k)) for k in knots])
    assert all(a[k] == pytest.approx(p1 / (1 - p0 + p1)) for k, (p0, p1) in zip(knots, table[1::2]))


def test_steps_with_many_cuts(spark, monkeypatch):
    """Several cuts, several ranges between two cuts, tables too large to broadcast."""
    monkeypatch.setattr(steps, "CUTS", 5)
    monkeypatch.setattr(steps, "PER_CUT", 2)
    monkeypatch.setattr(steps, "fits", lambda df: False)
    rows = _noisy(800, 5)
    df = spark.createDataFrame(rows, "s double, y double")
    fitted = calibration.VennAbers.fit(df, "s", "y", range_rows=64)
    assert len(fitted.steps.cuts) == 4
    want = calibration.venn_abers_table([(a, 1.0, b) for a, b in sorted(rows)])
    out = {r.s: r.p for r in fitted.transform(df, "s", "p").collect()}
    assert len(out) == 800 and all(out[a] == pytest.approx(p1 / (1 - p0 + p1)) for (a, _), (p0, p1) in zip(sorted(rows), want[1::2]))


def test_steps_of_several_blocks(spark, monkeypatch):
    """Tables of more rows than a block: neighbours by tiles, and places by running counts over values and beginnings."""
    monkeypatch.setattr(steps, "shifted", functools.partial(steps.shifted, block_rows=40))
    monkeypatch.setattr(steps, "positions", functools.partial(steps.positions, block_rows=40))
    monkeypatch.setattr(steps, "prefix_sums", functools.partial(steps.prefix_sums, block_rows=40))
    bounds = [i / 2 for i in range(100)]
    table = spark.createDataFrame([(float("-inf"), -1.0)] + [(b, b * 10) for b in bounds], "lo double, fit double")
    values = [None, float("nan"), float("-inf"), float("inf"), -7.0, 0.0, -0.0, 0.25, 0.5, 13.2, 13.5, 13.5, 49.5, 60.0]
    asked = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = []
    for small in (True, False):
        monkeypatch.setattr(steps, "fits", lambda df, small=small: small)
        out = steps.Steps.build(table, following=["lo"]).join(asked, "v")
        got.append({r.i: (r._step_lo, r._step_fit, r._step_next_lo) for r in out.collect()})
        assert out.columns == ["i", "v", "_value", "_step_lo", "_step_fit", "_step_next_lo"]
    assert got[0] == got[1] and len(got[0]) == len(values)
    assert got[0][0] == (None, None, None) and got[0][9] == (13.0, 130.0, 13.5) and got[0][13] == (49.5, 495.0, None)


def test_many_scores_share_knots(spark):
    df = spark.range(3000).select((F.col("id") / 3000).alias("s"), (F.col("id") % 2 + F.col("id") > 1500).cast("double").alias("y"))
    out = calibration.VennAbers.fit(df, "s", "y", max_knots=50).transform(df, "s", "p")
    assert out.count() == 3000 and out.filter("p is null or p < 0 or p > 1").isEmpty()


# -- runs ---------------------------------------------------------------------------------


SPEC = {
    "key": "key", "target": "label", "features": ["a", "b", "c", "d", "kind"], "factors": ["kind"], "encoder": "mestimate",
    "counts": True, "numpy": True, "clustering": [2, 3, 1], "pca": [1, 2, 1], "interactions": [30, 2], "variance": 1e-9,
    "algorithms": ["LOGR", "RF"], "estimators": 5, "calibration": "isotonic",
}


def _halves(points):
    rows = points.withColumn("key", F.col("key")).drop("fold")
    return split.train_test_split(rows, "key", 0.3)


def test_run_is_saved_and_reloaded(spark, points, tmp_path):
    fit_rows, test_rows = _halves(points)
    run = train(SPEC, fit_rows, test_rows)
    assert run.best in ("LOGR", "RF")
    auc = run.metrics.filter("metric = 'roc_auc' and partition = 'test'").collect()
    assert {r.algo for r in auc} == {"LOGR", "RF", "BLEND"} and min(r.value for r in auc) > 0.8
    run.save(spark, str(tmp_path / "r"))
    back = load_run(spark, str(tmp_path / "r"))
    a, b = (r.score(test_rows.drop("label")).orderBy("key").toPandas() for r in (run, back))
    assert list(a.columns) == list(b.columns) and np.allclose(a.to_numpy(float), b.to_numpy(float))
    c = back.score(test_rows.repartition(11)).orderBy("key").toPandas()
    assert np.allclose(a.to_numpy(float), c.to_numpy(float))


def test_stream_scores_equal_batch_scores(spark, points, tmp_path):
    fit_rows, test_rows = _halves(points)
    run = train({**SPEC, "algorithms": ["LOGR"], "clustering": None, "calibration": None}, fit_rows, test_rows)
    test_rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test_rows.schema).parquet(str(tmp_path / "in"))
    write_scores(score_stream(run, stream), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    a = spark.read.parquet(str(tmp_path / "out")).orderBy("key").select("key", "prob_LOGR").toPandas()
    b = run.score(test_rows).orderBy("key").select("key", "prob_LOGR").toPandas()
    assert len(a) == len(b) and np.allclose(a.to_numpy(float), b.to_numpy(float))
    with pytest.raises(ValueError):
        score_stream(run, stream.withColumnRenamed("a", "a[-1]"))


def test_ranking_and_regression_runs(points):
    fit_rows, test_rows = _halves(points)
    rank = {"key": "key", "target": "t", "features": COLS, "group": "g", "model_type": "ranking", "algorithms": ["XGRK"]}
    put = lambda d: d.withColumn("t", F.round(3 * F.col("a") + F.col("b"), 1)).drop("label")
    run = train(rank, put(fit_rows), put(test_rows))
    assert value(run.metrics.filter("partition = 'test'"), "kendall_tau") > 0.9
    line = {**rank, "model_type": "regression", "algorithms": ["LR", "RFR"], "group": None, "estimators": 5, "lofo": True, "rfe": 1}
    run = train(line, put(fit_rows), put(test_rows))
    assert run.best == "LR" and value(run.metrics.filter("partition = 'test' and algo = 'LR'"), "r2") > 0.99


def test_text_features_and_unlabelled_rows(spark):
    words = ["red hot pepper", "cold blue water", "hot red sauce", "blue cold ice"]
    rows = [(i, words[i % 4], float(i % 4 in (0, 2))) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, note string, label double")
    new = df.filter("key < 8").withColumn("label", F.lit(None).cast("double"))
    run = train({"key": "key", "target": "label", "vectorize": True, "ngrams": 2, "algorithms": ["LOGR"], "cv_folds": 2}, df, new)
    got = {r.key: r.pred_LOGR for r in run.predictions.filter("partition = 'test'").collect()}
    assert got == {i: float(i % 4 in (0, 2)) for i in range(8)}
    assert run.metrics.filter("partition = 'test'").isEmpty() and run.best == "LOGR"


def test_softmax_boosting(spark, tmp_path):
    """Three classes along a line: probabilities sum to 1, the log loss falls with the rounds, saved and loaded models agree, seeds repeat."""
    rng = np.random.default_rng(8)
    x = rng.random((400, 2)) * 3
    df = spark.createDataFrame([(i, *map(float, r), float(min(int(r[0]), 2))) for i, r in enumerate(x)], "key long, a double, b double, label double")
    data = unsupervised.assemble(df, ["a", "b"])
    losses = []
    for n in (1, 12):
        fitted = models.build("XGBM", {"key": "key"}, n_estimators=n, max_depth=3).fit(data)
        out = fitted.transform(data).select("key", "label", "prediction", vector_to_array("probability").alias("p"))
        rows = out.collect()
        assert all(len(r.p) == 3 and sum(r.p) == pytest.approx(1) and r.prediction == max(range(3), key=lambda k: r.p[k]) for r in rows)
        losses.append(value(metrics.multiclass_log_loss(out, "label", "p"), "neg_log_loss"))
        assert losses[-1] == pytest.approx(np.mean([-np.log(r.p[int(r.label)]) for r in rows]))
    assert losses[1] < 0.3 < losses[0] < np.log(3) and np.mean([r.prediction == r.label for r in rows]) > 0.97
    fitted.save(str(tmp_path / "s"))
    again = models.build("XGBM", {"key": "key"}, n_estimators=12, max_depth=3).fit(data)
    for other in (models.SoftmaxBoostModel.load(str(tmp_path / "s")), again):
        same = {r.key: r.p for r in other.transform(data).select("key", vector_to_array("probability").alias("p")).collect()}
        assert all(same[r.key] == pytest.approx(r.p) for r in rows)
    assert dict(models.importances(fitted, ["a", "b"]))["a"] > 0.9


def _class_rows(spark, n, classes, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    y = (x[:, 0] * 3 + x[:, 1] + rng.normal(size=n)).astype(int) % classes
    rows = [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double, e double, label double")
    return unsupervised.assemble(df, list("abcde")).coalesce(2)


def _probabilities(model, df):
    return {r.key: list(r.p) for r in model.transform(df).select("key", vector_to_array("probability").alias("p")).collect()}


def test_softmax_boosting_grows_the_trees_of_spark(spark, monkeypatch):
    """As one forest of Spark per class and round, also in narrow chunks and several passes a level."""
    from pyspark.ml.regression import RandomForestRegressor

    from tabforge.operators import trees

    df = _class_rows(spark, 400, 3).cache()
    est = models.SoftmaxBoost(n_estimators=3, max_depth=4, seed=11)
    got = _probabilities(est.fit(df), df)
    data = df.withColumn("_f", F.array(*[F.lit(p) for p in est.fit(df).priors]))
    for t in range(3):
        shares = data.withColumn("_p", models.softmax(F.col("_f")))
        for k in range(3):
            one = RandomForestRegressor(numTrees=1, bootstrap=False, subsamplingRate=0.9, featureSubsetStrategy="all", maxDepth=4, seed=11 + 3 * t + k,
                                        labelCol="_g", predictionCol=f"_t{k}")
            gradient = (F.col("label") == k).cast("double") - F.get("_p", F.lit(k))
            data = one.fit(shares.withColumn("_g", gradient).select("features", "_g")).transform(data)
        data = data.withColumn("_f", F.array(*[F.get("_f", F.lit(k)) + 0.1 * 3 * F.col(f"_t{k}") for k in range(3)])).drop("_t0", "_t1", "_t2")
    wanted = {r.key: r.p for r in data.select("key", models.softmax(F.col("_f")).alias("p")).collect()}
    assert all(got[k] == pytest.approx(p, abs=1e-9) for k, p in wanted.items()) and len(got) == 400
    monkeypatch.setattr(trees, "CHUNK", 2)
    monkeypatch.setattr(trees, "HELD_BYTES", 3 * 24 * 5 * 32)
    monkeypatch.setattr(trees, "CELLS", 70)
    again = _probabilities(est.fit(df), df)
    assert all(again[k] == pytest.approx(p, abs=1e-9) for k, p in got.items())


def test_softmax_boosting_takes_no_jobs_per_class(spark):
    context, jobs = spark.sparkContext, []
    for classes in (3, 9):
        df = _class_rows(spark, 300, classes).cache()
        df.count()
        context.setJobGroup(f"boost{classes}", "")
        try:
            models.SoftmaxBoost(n_estimators=2, max_depth=3).fit(df)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"boost{classes}")))
    assert 0 < jobs[1] <= jobs[0] + 6


def test_softmax_boosting_of_odd_rows(spark):
    df = _class_rows(spark, 200, 2)
    gone, nan = F.when(F.col("key") != 7, F.col("label")), F.when(F.col("key") == 7, float("nan")).otherwise(F.col("a"))
    for label, a in ((gone, F.col("a")), (F.col("label"), nan)):
        with pytest.raises(ValueError, match="without nulls"):
            models.SoftmaxBoost(n_estimators=1).fit(df.select(label.alias("label"), array_to_vector(F.array(a, "b")).alias("features")))
    flat = df.select("key", "label", array_to_vector(F.array(F.lit(1.0), F.lit(0.0))).alias("features"))
    fitted = models.SoftmaxBoost(n_estimators=2).fit(flat)
    shares = np.array(list(_probabilities(fitted, flat).values()))
    assert np.ptp(shares, axis=0).max() == 0 and list(fitted.featureImportances) == [0.0, 0.0]
    # one partition of many rows is spread over the cores
    parted = models.SoftmaxBoost(n_estimators=12, block=50)
    assert parted._rows(df.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    out = parted.fit(df.coalesce(1)).transform(df).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in out]) > 0.9


def test_feature_cuts_pass_equal_shares(spark):
    from tabforge.operators.trees import feature_cuts

    rng = np.random.default_rng(5)
    n = 3000
    x = np.column_stack([rng.normal(size=n), np.zeros(n), rng.integers(0, 20, n), np.where(rng.random(n) < 0.4, -5.0, rng.normal(size=n)),
                         np.where(rng.random(n) < 0.5, 0.0, rng.integers(-30, 30, n)), -rng.exponential(size=n).round(2)])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>")
    got = feature_cuts(df, "x")
    for column, cuts in zip(x.T, got):
        values, counts = np.unique(column, return_counts=True)
        wanted, target, upto = [], n / 32, counts[0]
        for i in range(1, len(values)):
            before, upto = upto, upto + counts[i]
            if len(values) <= 32 or abs(before - target) < abs(upto - target):
                wanted.append((values[i - 1] + values[i]) / 2)
                target += n / 32
        assert list(cuts) == wanted
    assert len(got[1]) == 0 and len(got[2]) == 19 and len(got[0]) == 31


class _Sleeper:
    """An estimator whose fits are Spark jobs of a given length."""

    def __init__(self, seconds):
        self.seconds = seconds

    def fit(self, df):
        def wait(rows):
            import time

            time.sleep(self.seconds)
            yield from rows

        df.sparkSession.range(0, 1, 1, 1).mapInPandas(wait, "id long").collect()
        return self

    def transform(self, df):
        return df.withColumn("prediction", F.col("label"))


def test_search_keeps_its_time_budget(points, monkeypatch):
    """Trials that would take minutes are cancelled at the deadline; those that finished before are kept."""
    import time

    monkeypatch.setattr(search, "build", lambda algo, spec, seconds: _Sleeper(seconds))
    data = unsupervised.assemble(points, COLS)
    search.search(data, "LOGR", {"key": "key"}, "accuracy", "fold", 3, 1, {"seconds": [0.1]})
    start = time.monotonic()
    best, table = search.search(data, "LOGR", {"key": "key"}, "accuracy", "fold", 3, 4, {"seconds": [0.1, 600.0, 601.0, 602.0]}, timeout=25.0)
    assert time.monotonic() - start < 80
    assert best == {"seconds": 0.1} and [r.params for r in table.collect()] == ["{'seconds': 0.1}"]
    best, table = search.search(data, "LOGR", {"key": "key"}, "accuracy", "fold", 3, 1, {"seconds": [600.0]}, timeout=1.0)
    assert best == {} and table.count() == 0
    assert points.count() == 600  # no later job is cancelled


def test_members_prune_folders(spark, tmp_path):
    """Only the members' sub-folders are read; a large member lies in several files; names that look like numbers stay text."""
    df = spark.range(9000).select(F.when(F.col("id") < 6000, "big").otherwise(F.concat(F.lit("0"), (F.col("id") % 3).cast("string"))).alias("tag_id"), "id")
    io.dump_frames(df, str(tmp_path / "g"), file_rows=1000)
    assert len(list((tmp_path / "g" / "tag_id=big").glob("*.parquet"))) >= 4
    members = spark.createDataFrame([("01",), ("none",)], "member string")
    out = io.load_frames(spark, str(tmp_path / "g"), members, extension="partitions")
    assert out.columns == ["tag_id", "id"] and {r.tag_id for r in out.collect()} == {"01"} and out.count() == 1000
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString().lower()
    read = io.load_frames(spark, str(tmp_path / "g"), members, extension="partitions")
    rows = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("tag_id=01" in r.f for r in rows)


def test_text_vectors_equal_term_weights(spark, tmp_path):
    """Numbers follow the sorted vocabulary; unseen terms have no place, texts without terms are empty vectors; repeated rows stay."""
    texts = ["b a a c", "a d", "", None, "zz b b", "b a a c"]
    df = spark.createDataFrame([(i, t and " ".join(w * 2 for w in t.split())) for i, t in enumerate(texts)], "key long, note string").fillna("nulltext")
    fitted = text.TextVectors.fit(df, "note", "v", 2)
    fitted.save(str(tmp_path / "v"))
    fitted = text.TextVectors.load(str(tmp_path / "v"))
    want = {(r.key, r.term): r.weight for r in text.tf_idf(df, "key", "note", 2).collect()}
    terms = [r.term for r in fitted.terms.orderBy("number").collect()]
    assert terms == sorted({t for _, t in want}) and [r.number for r in fitted.terms.orderBy("number").collect()] == list(range(len(terms)))
    rows = fitted.transform(df.union(df.filter("key = 0")).union(spark.createDataFrame([(9, "new words only")], "key long, note string")), "note", 2).collect()
    assert sorted(r.key for r in rows) == [0, 0, 1, 2, 3, 4, 5, 9]
    for r in rows:
        got = {(r.key, terms[i]): v for i, v in zip(r.v.indices, r.v.values)}
        assert r.v.size == len(terms) and got == pytest.approx({k: w for k, w in want.items() if k[0] == r.key})


def test_term_weights_of_a_large_vocabulary(spark, monkeypatch):
    """Too large to broadcast: one join, by term; terms of one document need no row of the vocabulary."""
    notes = ["aa bb aa cc", "aa dd", None, "", "zz bb bb zz", "aa bb aa cc"]
    df = spark.createDataFrame(list(enumerate(notes)), "key long, note string")
    small = {(r.key, r.term): r.weight for r in text.tf_idf(df, "key", "note", 2).collect()}
    monkeypatch.setattr(text, "fits", lambda df: False)
    monkeypatch.setattr(scale, "fits", lambda *a: False)
    out = text.tf_idf(df, "key", "note", 2)
    assert {(r.key, r.term): r.weight for r in out.collect()} == pytest.approx(small)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    idf = lambda n: np.log(7 / (1 + n)) + 1
    raw = {"aa": idf(3), "dd": idf(1), "aa dd": idf(1)}
    assert {t: w for (k, t), w in small.items() if k == 1} == pytest.approx({t: w / np.sqrt(sum(x * x for x in raw.values())) for t, w in raw.items()})


@pytest.mark.parametrize("kind", ["long", "string"])
def test_runs_of_a_large_text_are_weighed_in_blocks(spark, monkeypatch, kind):
    """No term is shuffled or joined; weights are those of a small text, also of repeated and missing keys and of texts without words."""
    rng = np.random.default_rng(3)
    notes = [" ".join(f"w{i}" for i in rng.integers(0, 12, rng.integers(0, 30))) for _ in range(40)] + [None, "", "?", "once only here"]
    rows = [*enumerate(notes), (3, notes[5]), (7, notes[7]), (7, "w1 w2 w1"), (None, "w3 w4"), (None, "w4 w3 w4")]
    df = spark.createDataFrame(rows, "key long, note string").withColumn("key", F.col("key").cast(kind))
    weights = lambda out: {(r.key, r.term): r.weight for r in out.collect()}
    for some in (df, df.filter("key IS NOT NULL").dropDuplicates(["key"])):
        monkeypatch.undo()
        small = text.tf_idf(some, "key", "note", 2)
        for name, size in (("LARGE_TEXT", 100), ("BLOCK_TEXT", 400), ("SHARE_TEXT", 500), ("BATCH", 7)):
            monkeypatch.setattr(text, name, size, raising=False)
        out = text.tf_idf(some, "key", "note", 2)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join " not in plan and "Window" not in plan and out.schema == small.schema
        assert out.count() == small.count() and weights(out) == pytest.approx(weights(small))


def test_rows_of_one_key_are_one_document(spark):
    df = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "bb bb")], "key long, note string")
    one = spark.createDataFrame([(1, "aa bb aa cc"), (2, "bb bb")], "key long, note string")
    a, b = (sorted((r.key, r.term, r.weight) for r in text.tf_idf(d, "key", "note").collect()) for d in (df, one))
    assert [x[:2] for x in a] == [x[:2] for x in b]


# -- files ----------------------------------------------------------------------------------


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_frame(spark, str(tmp_path / "none.csv")).count()


def test_types_are_inferred_and_overridden(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,f,b,d,s\n1,1.5,true,2020-01-01,x\n2,,false,2020-01-02,\n")
    df = io.read_frame(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert dict(io.read_frame(spark, str(tmp_path / "t.csv"), dtypes={"i": "float", "f": "odd"}).dtypes) | {} == {
        "i": "double", "f": "string", "b": "boolean", "d": "string", "s": "string"}


def test_latest_run_metrics_and_submission(spark, tmp_path):
    reg = str(tmp_path / "runs")
    for name in ("r1", "r2"):
        io.record_run(spark, reg, name, f"/x/{name}")
    assert io.latest_run(spark, reg) == "/x/r2"
    sample = spark.createDataFrame([(3, 0.0), (1, 0.0), (2, 0.0)], "id int, y double")
    scores = spark.createDataFrame([(1, 0.1), (3, 0.3)], "k int, p double")
    assert {r.id: r.y for r in io.submission(sample, scores, "p").collect()} == {1: 0.1, 2: None, 3: 0.3}
    table = spark.createDataFrame([("A", "test", "r2", 1.0)], "algo string, partition string, metric string, value double")
    io.save_metrics(table, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


