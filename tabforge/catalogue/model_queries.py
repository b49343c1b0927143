"""Models, calibration, search, clustering and whole runs (G, B, X, F07-F09, Q, J10, flagship)."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from tabforge.catalogue.metric_queries import _S, scored
from tabforge.catalogue.registry import query, table
from tabforge.functions.calendar import dateparts
from tabforge.operators import calibration, curves, metrics, models, scaling, search, selection, sequence, split, unsupervised
from tabforge.operators.frame import literal, positive_importances, top_n
from tabforge.operators.neighbours import k_nearest, lsh_nearest
from tabforge.operators.text import spread, words
from tabforge.plans.scale import materialise
from tabforge.plans.training import load_run, train
from tabforge.sources import io
from tabforge.streaming.score import score_stream, write_scores

_TEXT = ("n_chars", "n_words", "word_length", "upper_share", "digit_share", "lines", "distinct_share")


def labelled_documents(spark, sf):
    """Whole texts described by a few numbers, with the quality label."""
    # texts become a few numbers where they are read, and those are joined
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")).withColumn("_w", words("text"))
    size = F.greatest(F.char_length("text"), F.lit(1))
    n = F.greatest(F.size("_w"), F.lit(1))
    rows = docs.select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        F.size("_w").cast("double").alias("n_words"), (size / n).alias("word_length"),
        (F.char_length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / size).alias("upper_share"),
        (F.char_length(F.regexp_replace("text", r"[^0-9]", "")) / size).alias("digit_share"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.size(F.array_distinct("_w")) / n).alias("distinct_share"))
    marked = rows.join(table(spark, sf, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    return materialise(split.add_folds(marked.select("doc_id", "label", "toxic", "lang", *_TEXT), "doc_id", 3))


def _vectors(spark, sf):
    df = labelled_documents(spark, sf)
    df = scaling.fit_standard(df, _TEXT).transform(df)
    return unsupervised.assemble(df, _TEXT).select("doc_id", "label", "fold", "features", *_TEXT)


_SPEC = {"key": "doc_id", "estimators": 51, "seed": 42}


def _classifier(name, algo, **params):
    @query(name)
    def run(spark, sf):
        df = _vectors(spark, sf)
        out = models.build(algo, _SPEC, **params).fit(df).transform(df)
        return out.select("doc_id", "label", "prediction")

    return run


_classifier("g01_logistic", "LOGR")
_classifier("g03_random_forest", "RF")
_classifier("g04_gradient_boosting", "GB")
_classifier("g05_boosting_xgb", "XGB")
_classifier("g05_boosting_lgb", "LGB")
_classifier("g05_boosting_catb", "CATB")
_classifier("g08_linear_svc", "LSVC")
_classifier("g09_kernel_svc", "RBF")
_classifier("g10_naive_bayes", "NB")
_classifier("g12_adaboost", "AB")
_classifier("g13_extra_trees", "XT")


@query("g02_linear", """
with z as (select regr_slope(l_extendedprice, l_quantity) a, regr_intercept(l_extendedprice, l_quantity) b from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(a * l_quantity + b, 3) as prediction from lineitem, z""")
def g02(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    data = unsupervised.assemble(df, ["l_quantity"])
    out = models.build("LR", _SPEC).fit(data).transform(data)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 3).alias("prediction"))


@query("g03_forest_regression")
def g03r(spark, sf):
    data = _panel_vectors(spark, sf)
    out = models.build("RFR", {**_SPEC, "key": "event_id"}).fit(data).transform(data)
    return out.select("event_id", "label", "prediction")


@query("g04_boosted_regression")
def g04r(spark, sf):
    data = _panel_vectors(spark, sf)
    out = models.build("GBR", {**_SPEC, "key": "event_id"}).fit(data).transform(data)
    return out.select("event_id", "label", "prediction")


def _panel_vectors(spark, sf):
    lags = [f"value[-{i}]" for i in (1, 2, 3)]
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    # read by the medians and by every pass of a fit: lagged once, written once
    seq = materialise(sequence.sequence_frame(events, "value", "ts", "event_id", 1, 3, group="user_id", lag_target=True), columnar=True)
    ready = scaling.fit_median(seq, lags).transform(seq)
    return unsupervised.assemble(ready, lags).withColumnRenamed("value", "label")


@query("g06_multiclass")
def g06(spark, sf):
    data = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features"))
    est = models.build("XGBM", {**_SPEC, "key": "vec_id"})
    return est.fit(data).transform(data).select("vec_id", "label", "prediction")


@query("g07_pairwise_ranker", """
with w as (select sum((a.p_retailprice - b.p_retailprice) * (a.p_size - b.p_size)) / sum(pow(a.p_size - b.p_size, 2)) as w
           from part a join part b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey)
select p_partkey, p_brand, round(p_size * w, 6) as score from part, w""")
def g07(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    model = models.PairwiseRanker(["p_size"], "p_brand", "p_retailprice", prediction="score", loss="squared").fit(part)
    return model.transform(part).select("p_partkey", "p_brand", F.round("score", 6).alias("score"))


def _newton(steps):
    """SQL: Newton steps for the mean logistic loss over pairs, from 0."""
    at = ["w0 as (select 0::double as w)"]
    for i in range(steps):
        at.append(f"""w{i + 1} as materialized (select any_value(w) - avg(-d / (1 + exp(w * d))) / avg(d * d / ((1 + exp(w * d)) * (1 + exp(-w * d)))) as w from d, w{i})""")
    return ", ".join(at)


@query("g07_pairwise_logistic", f"""
with d as materialized (select (a.p_size - b.p_size)::double as d from part a join part b on a.p_brand = b.p_brand and a.p_retailprice > b.p_retailprice),
{_newton(8)} select p_partkey, p_brand, round(p_size * w, 6) + 0 as score from part, w8""")
def g07l(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    model = models.PairwiseRanker(["p_size"], "p_brand", "p_retailprice", reg=0.0, prediction="score").fit(part)
    return model.transform(part).select("p_partkey", "p_brand", (F.round("score", 6) + 0).alias("score"))


_NEAR = """near as (select a.vec_id, b.vec_id as neighbour, b.label, list_distance(a.embedding::double[], b.embedding::double[]) as d
  from embeddings a join embeddings b on a.vec_id <> b.vec_id qualify row_number() over (partition by a.vec_id order by d, b.vec_id) <= 5)"""


def _points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("j10_neighbours", f"with {_NEAR} select vec_id, neighbour, label::double as value, round(d, 6) as distance from near")
def j10(spark, sf):
    p = _points(spark, sf)
    return k_nearest(p, p, "features", "vec_id", "vec_id", "label", 5).withColumn("distance", F.round("distance", 6))


@query("j10_projection_neighbours", "select count(*) as queries, true as sound, true as recalled from embeddings")
def j10l(spark, sf):
    """Neighbours by random projections: none farther than asked, distances right, nine tenths of the exact ones found."""
    p = _points(spark, sf)
    exact = k_nearest(p, p, "features", "vec_id", "vec_id", "label", 5)
    found = lsh_nearest(p, p, "features", "vec_id", "vec_id", "label", 5, radius=1.5, bucket_length=2.0)
    both = exact.alias("e").join(found.alias("f"), ["vec_id", "neighbour"], "full")
    near = (F.col("f.distance") < 1.5) & (F.col("e.distance").isNull() | (F.abs(F.col("f.distance") - F.col("e.distance")) < 1e-6))
    judged = both.agg(F.min(F.coalesce(near, F.lit(True))).alias("sound"), F.sum(F.col("e.distance").isNotNull().cast("long")).alias("wanted"),
                      F.sum((F.col("e.distance").isNotNull() & F.col("f.distance").isNotNull()).cast("long")).alias("met"))
    return judged.crossJoin(p.agg(F.count(F.lit(1)).alias("queries"))).select("queries", "sound", (F.col("met") >= 0.9 * F.col("wanted")).alias("recalled"))


@query("g11_knn", f"""with {_NEAR}, v as (select vec_id, label, count(*) c from near group by 1, 2)
select vec_id, label::double as prediction from v qualify row_number() over (partition by vec_id order by c desc, label) = 1""")
def g11(spark, sf):
    p = _points(spark, sf)
    return models.build("KNN", {**_SPEC, "key": "vec_id"}).fit(p).transform(p).select("vec_id", "prediction")


@query("g11_knr", f"with {_NEAR} select vec_id, round(avg(label), 6) as prediction from near group by 1")
def g11r(spark, sf):
    p = _points(spark, sf)
    out = models.build("KNR", {**_SPEC, "key": "vec_id"}).fit(p).transform(p)
    return out.select("vec_id", F.round("prediction", 6).alias("prediction"))


@query("m06_argmax", "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as best from embeddings")
def m06(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", models.argmax("embedding").alias("best"))


# -- calibration -------------------------------------------------------------------


_KNOTS = f"""with {_S}, k as (select p as k, count(*)::double as n, sum(y)::double as s from s group by 1),
c as (select *, row_number() over (order by k) as i, sum(n) over (order by k) as cn, sum(s) over (order by k) as cs from k)"""


def _monotone(name, n, s):
    """SQL: the increasing fit at each distinct score, the greatest over left ends of the least mean over right ends."""
    return f"""{name}m as (select a.i as l, b.i as r, (b.cs - a.cs + a.s + {s}) / (b.cn - a.cn + a.n + {n}) as mean from c a join c b on b.i >= a.i),
{name}l as (select l, r as i, min(mean) over (partition by l order by r rows between current row and unbounded following) as low from {name}m),
{name} as (select i, max(low) as fit from {name}l group by i)"""


_FITTED = "select l_orderkey, l_linenumber, l_partkey, p, round({}, 9) as calibrated from s join c on p = k"


def _calibrated(df, method):
    fitted = calibration.CALIBRATORS[method].fit(df, "p", "y")
    return fitted.transform(df, "p", "calibrated").select("l_orderkey", "l_linenumber", "l_partkey", "p", F.round("calibrated", 9).alias("calibrated"))


def _calibrator(name, method, sql=None):
    @query(name, sql)
    def run(spark, sf):
        return _calibrated(scored(spark, sf).withColumn("y", F.col("y").cast("double")), method)

    return run


def _unrounded(name, method):
    """Nearly every row has a score of its own."""

    @query(name)
    def run(spark, sf):
        p = F.col("l_extendedprice") / 110_000 + F.col("l_discount") / 10 - F.col("l_tax") / 10
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p.alias("p"), (F.col("l_quantity") > 25).cast("double").alias("y"))
        return _calibrated(df, method)

    return run


_calibrator("b01_sigmoid", "sigmoid")
_calibrator("b02_isotonic", "isotonic", f"{_KNOTS}, {_monotone('f', 0, 0)} {_FITTED.format('fit')} join f using (i)")
# the new score meets a knot: one row more there, with label 0 and with label 1
_calibrator("b03_venn_abers", "vennabers", f"{_KNOTS}, {_monotone('f0', 1, 0)}, {_monotone('f1', 1, 1)} "
            f"{_FITTED.format('f1.fit / (1 - f0.fit + f1.fit)')} join f0 using (i) join f1 using (i)")
_unrounded("b02_isotonic_unrounded", "isotonic")
_unrounded("b03_venn_abers_unrounded", "vennabers")


# -- clusters, components ------------------------------------------------------------------


@query("x01_kmeans")
def x01(spark, sf):
    p = _points(spark, sf)
    fitted = unsupervised.Clusters.fit(p, "features", 3, 7, 2, seed=1)
    return fitted.transform(p).select("vec_id", *fitted.names)


@query("x02_pca")
def x02(spark, sf):
    df = labelled_documents(spark, sf)
    p = unsupervised.assemble(scaling.zero_then_standard(df, _TEXT), _TEXT)
    fitted = unsupervised.Components.fit(p, "features", 1, 3, 1, whiten=True)
    return fitted.transform(p).select("doc_id", *fitted.names)


# -- elimination, search, curves over fits ---------------------------------------------------


@query("f07_lofo")
def f07(spark, sf):
    return models.lofo(labelled_documents(spark, sf), _TEXT, "LOGR", _SPEC, "roc_auc", "fold", 3)


@query("f08_rfe")
def f08(spark, sf):
    return models.eliminate(labelled_documents(spark, sf), _TEXT, "LOGR", _SPEC, "roc_auc", "fold", 3, step=2)


@query("f09_v06_importances")
def f09(spark, sf):
    model = models.build("RF", _SPEC).fit(_vectors(spark, sf))
    return top_n(models.importance_table(spark, model, _TEXT).filter("importance > 0"), 20, F.desc("importance"), F.col("feature"))


@query("n21_cross_validation")
def n21(spark, sf):
    scores = models.cv_scores(_vectors(spark, sf), models.build("LOGR", _SPEC), "roc_auc", "fold", 3)
    return spark.createDataFrame(list(enumerate(scores)), "fold int, score double")


@query("q01_search")
def q01(spark, sf):
    return search.search(_vectors(spark, sf), "LOGR", _SPEC, "roc_auc", "fold", 3, 12)[1]


@query("q02_report")
def q02(spark, sf):
    return search.report(search.search(_vectors(spark, sf), "NB", _SPEC, "accuracy", "fold", 3, 10)[1])


@query("v04_learning_curve")
def v04(spark, sf):
    return search.learning_curve(_vectors(spark, sf), "LOGR", _SPEC, "roc_auc", "doc_id", "fold", 3)


@query("v05_validation_curve")
def v05(spark, sf):
    return search.validation_curve(_vectors(spark, sf), "LOGR", _SPEC, "roc_auc", "fold", 3, "reg", (0.0, 1e-5, 1e-4, 1e-3, 1e-2, 0.1))


@query("v07_partial_dependence")
def v07(spark, sf):
    df = labelled_documents(spark, sf)
    model = models.build("RF", _SPEC).fit(unsupervised.assemble(df, _TEXT))
    return curves.partial_dependence(model, df, "n_chars", lambda d: unsupervised.assemble(d, _TEXT))


@query("v08_boundary")
def v08(spark, sf):
    df = labelled_documents(spark, sf)
    pair = ["n_chars", "word_length"]
    model = models.build("RF", _SPEC).fit(unsupervised.assemble(df, pair))
    return curves.boundary_grid(model, df, *pair, lambda d: unsupervised.assemble(d, pair))


# -- whole runs -------------------------------------------------------------------------------


@query("b04_b07_training_run")
def training_run(spark, sf):
    """Documents with labels as training rows, the others scored: features, three models, blend, metrics."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "quality", "lang", "source", "n_chars", F.size(words("text")).alias("n_words"))
    halves = split.train_test_split(docs.filter("quality is not null"), "doc_id", 0.3)
    spec = {"key": "doc_id", "target": "quality", "factors": ["lang", "source"], "encoder": "target", "scaling": "standard",
            "algorithms": ["LOGR", "RF"], "counts": False}
    return train(spec, *halves).metrics


@query("flagship_panel_forecast")
def flagship(spark, sf):
    """Event panel: date parts, lags per user, imputation, scaling, time split, linear forecast of the value, metrics."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events = events.withColumns(dateparts("ts"))
    seq = sequence.sequence_frame(events, "value", "ts", "event_id", 1, 3, ["event_type", "year", "month", "day", "dayofweek"],
                                  "user_id", lag_target=True)
    inputs = ["value[-1]", "value[-2]", "value[-3]", "dayofweek"]
    boundary = literal(events, "ts", sequence.split_date(events, "ts", 0.25))
    # read many times below: lagged once, written once
    seq = materialise(seq.withColumn("partition", F.when(F.col("ts") <= boundary, "train").otherwise("test")), columnar=True)
    fitting = seq.filter("partition = 'train'")
    fill = scaling.fit_imputer(fitting.select(*[f"`{c}`" for c in inputs]))
    scaler = scaling.fit_standard(fill.transform(fitting), inputs)
    ready = unsupervised.assemble(scaler.transform(fill.transform(seq)), inputs).select("event_id", "partition", "value", "features")
    model = models.build("LR", {"label": "value"}).fit(ready.filter("partition = 'train'"))
    out = materialise(model.transform(ready).select("partition", "value", "prediction"))
    parts = [
        metrics.regression_metrics(out.filter(F.col("partition") == p), "value", "prediction").select(
            F.lit("LR").alias("algo"), F.lit(p).alias("partition"), "metric", "value")
        for p in ("train", "test")
    ]
    return parts[0].unionAll(parts[1])




# -- columns, vectors, saved models and streams ----------------------------------------------------


@query("j04_assemble", "select doc_id, [n_chars::double, length(source)::double] as features from documents")
def j04(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars", F.char_length("source").alias("size"))
    return unsupervised.assemble(df, ["n_chars", "size"]).select("doc_id", vector_to_array("features").alias("features"))


@query("p08_support_mask", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linenumber as line from lineitem")
def p08(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("line", F.col("l_linenumber"))
    features = ["l_extendedprice", "l_discount", "l_tax", "line"]
    mask = selection.low_variance(df, features, 0.5)
    return selection.apply_support(df.select("l_orderkey", "l_linenumber", "l_partkey", *features), features, mask)


@query("f05_selection_modes", """
with f as (select unnest(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_tax']) as feature),
k as (select unnest(['kbest', 'fpr', 'fdr', 'fwe']) as kind)
select feature, kind, feature = 'l_extendedprice' as keep from f cross join k""")
def f05(spark, sf):
    # price is the only feature that tells dear lines from cheap ones beyond chance
    df = table(spark, sf, "lineitem").withColumn("y", (F.col("l_extendedprice") > 50000).cast("int"))
    scores = selection.f_classif(df, ["l_discount", "l_extendedprice", "l_linenumber", "l_tax"], "y")
    parts = [selection.support(scores, mode, value) for mode, value in (("kbest", 1), ("fpr", 1e-6), ("fdr", 1e-6), ("fwe", 1e-6))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("j03_s11_saved_model_scores", """
with z as (select regr_slope(o_totalprice, o_custkey) a, regr_intercept(o_totalprice, o_custkey) b from orders)
select o_orderkey, o_totalprice, round(a * o_custkey + b, 2) as prediction from orders, z""")
def s11(spark, sf):
    """Fit, save, record the run, find it again, load and score."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("x"))
    data = unsupervised.assemble(orders.withColumnRenamed("o_totalprice", "label"), ["x"])
    folder = io.scratch_folder(spark)
    models.build("LR", _SPEC).fit(data).write().overwrite().save(f"{folder}/model")
    io.record_run(spark, f"{folder}/runs", "run1", f"{folder}/model")
    back = LinearRegressionModel.load(io.latest_run(spark, f"{folder}/runs"))
    scored_rows = back.transform(data).select("o_orderkey", F.round("prediction", 2).alias("prediction"))
    return orders.select("o_orderkey", "o_totalprice").join(scored_rows, "o_orderkey")


@query("s11_b07_saved_run", """
with h as (select o_orderkey, o_totalprice::double as y, o_custkey::double as x,
  (('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint)::double / 4294967296.0 < 0.25 as test from orders),
z as (select regr_slope(y, x) a, regr_intercept(y, x) b from h where not test)
select o_orderkey, test, round(a * x + b, 2) as prediction, y as value from h, z""")
def saved_run(spark, sf):
    """One table split by key, a run on it saved and recorded; found again, it scores all rows, and its kept predictions are read back."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.col("o_custkey").cast("double").alias("x"))
    spec = {"key": "o_orderkey", "target": "value", "model_type": "regression", "scaling": None, "algorithms": ["LR"]}
    folder = io.scratch_folder(spark)
    train(spec, orders).save(spark, f"{folder}/run1", f"{folder}/runs")
    back = load_run(spark, io.latest_run(spark, f"{folder}/runs"))
    kept = back.predictions.select("o_orderkey", (F.col("partition") == "test").alias("test"))
    scores = back.score(orders).select("o_orderkey", F.round("pred_LR", 2).alias("prediction"))
    return kept.join(scores, "o_orderkey").join(orders.select("o_orderkey", "value"), "o_orderkey")


@query("s10_metrics_sink", """
select 'RULE' as algo, 'all' as partition, 'accuracy' as metric, round(avg(((l_quantity > 25) = (l_extendedprice > 37500))::int), 8) as value from lineitem""")
def s10(spark, sf):
    df = table(spark, sf, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_extendedprice") > 37500).cast("int").alias("pred"))
    rows = metrics.label_metrics(df, "y", "pred").filter("metric = 'accuracy'").select(
        F.lit("RULE").alias("algo"), F.lit("all").alias("partition"), "metric", F.round("value", 8).alias("value"))
    path = io.scratch_folder(spark)
    io.save_metrics(rows, path)
    return spark.read.parquet(path)


@query("o05_positive_importances")
def o05(spark, sf):
    model = models.build("GB", _SPEC).fit(_vectors(spark, sf))
    return positive_importances(models.importance_table(spark, model, _TEXT))


@query("k06_early_stopping")
def k06s(spark, sf):
    df = split.mark_validation(_vectors(spark, sf), "doc_id", 0.2)
    model = models.build("GB", {**_SPEC, "validation": "validation"}).fit(df)
    return model.transform(df).select("doc_id", "label", "prediction")


@query("z01_stream_scores", """
with z as (select regr_slope(value, hour(ts)) a, regr_intercept(value, hour(ts)) b from events)
select event_id, round(a * hour(ts) + b, 6) as prediction from events, z""")
def z01(spark, sf):
    """The event table read as a stream and scored by a fitted run; the sink's rows are returned."""
    events = table(spark, sf, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    run = train({"key": "event_id", "target": "value", "model_type": "regression", "algorithms": ["LR"], "cv_folds": 2}, events, events)
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select("event_id", F.hour("ts").cast("double").alias("hour"))
    folder = io.scratch_folder(spark)
    write_scores(score_stream(run, rows), f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", F.round("pred_LR", 6).alias("prediction"))


@query("g05_boosted_regression_xgbr")
def g05r(spark, sf):
    data = _panel_vectors(spark, sf)
    out = models.build("XGBR", {**_SPEC, "key": "event_id"}).fit(data).transform(data)
    return out.select("event_id", "label", "prediction")


@query("g13_extra_trees_regression")
def g13r(spark, sf):
    data = _panel_vectors(spark, sf)
    out = models.build("XTR", {**_SPEC, "key": "event_id"}).fit(data).transform(data)
    return out.select("event_id", "label", "prediction")
