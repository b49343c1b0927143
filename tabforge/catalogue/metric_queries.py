"""Metrics, curve tables, splits, feature tests, text and interactions (N, V, K, F, T, X03, B05, B06, L)."""

from pyspark.sql import functions as F

from tabforge.catalogue.registry import query, table
from tabforge.operators import curves, frame, metrics, selection, split, text
from tabforge.operators.scaling import fit_standard

# A deterministic classifier score: y, probability p (with many ties) and label.
_S = """s as (select l_orderkey, l_linenumber, l_partkey, (l_quantity > 25)::int as y,
  floor((l_quantity / 50 + (l_partkey % 100) / 100) * 50) / 100 as p from lineitem),
t as (select *, (p > 0.5)::int as pred from s)"""


def scored(spark, sf):
    p = F.floor((F.col("l_quantity") / 50 + (F.col("l_partkey") % 100) / 100) * 50) / 100
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 25).cast("int").alias("y"), p.alias("p")
    ).withColumn("pred", (F.col("p") > 0.5).cast("int"))


def _rows(pairs, source):
    return " union all ".join(f"select '{m}' as metric, round(({e})::double, 8) as value from {source}" for m, e in pairs.items())


def _rounded(df, digits=8):
    return df.withColumn("value", F.round("value", digits))


_CNT = f"with {_S}, c as (select count(*)::double n, sum((y=1 and pred=1)::int)::double tp, sum((y=0 and pred=0)::int)::double tn, " \
       "sum((y=0 and pred=1)::int)::double fp, sum((y=1 and pred=0)::int)::double fn from t) "


@query("n01_label_metrics", _CNT + _rows({
    "accuracy": "(tp+tn)/n", "f1_micro": "(tp+tn)/n", "balanced_accuracy": "(tp/(tp+fn)+tn/(tn+fp))/2",
    "matthews_corrcoef": "(tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))",
    "cohen_kappa": "((tp+tn)/n-((tp+fn)*(tp+fp)+(tn+fp)*(tn+fn))/(n*n))/(1-((tp+fn)*(tp+fp)+(tn+fp)*(tn+fn))/(n*n))",
    "f1": "2*tp/(2*tp+fp+fn)", "precision": "tp/(tp+fp)", "recall": "tp/(tp+fn)",
    "f1_macro": "(2*tp/(2*tp+fp+fn)+2*tn/(2*tn+fp+fn))/2",
    "f1_weighted": "((tp+fn)*2*tp/(2*tp+fp+fn)+(tn+fp)*2*tn/(2*tn+fp+fn))/n"}, "c"))
def n01(spark, sf):
    return _rounded(metrics.label_metrics(scored(spark, sf), "y", "pred"))


@query("n04_n09_probability_metrics", f"with {_S}, c as (select avg(pow(p-y,2)) b, -avg(case when y=1 then ln(greatest(least(p,1-2.220446049250313e-16),2.220446049250313e-16)) "
       "else ln(1-greatest(least(p,1-2.220446049250313e-16),2.220446049250313e-16)) end) l from t) "
       + _rows({"neg_brier_score": "b", "neg_log_loss": "l"}, "c"))
def n04(spark, sf):
    return _rounded(metrics.probability_metrics(scored(spark, sf), "y", "p"))


@query("n02_n11_curve_metrics", f"""with {_S}, g as (select p, sum(y)::double pos, sum(1-y)::double neg from t group by p),
w as (select *, sum(pos) over (order by p desc) tp, sum(neg) over (order by p desc) fp, sum(pos) over () np, sum(neg) over () nn from g),
c as (select sum(pos*(nn-fp+neg/2))/any_value(np*nn) auc, sum(pos/np*tp/(tp+fp)) ap from w) """
       + _rows({"roc_auc": "auc", "average_precision": "ap"}, "c"))
def n02(spark, sf):
    return _rounded(metrics.curve_metrics(scored(spark, sf), "y", "p"))


@query("n07_confusion", f"with {_S} select y as actual, pred as predicted, count(*)::bigint as n from t group by 1, 2")
def n07(spark, sf):
    return metrics.confusion(scored(spark, sf), "y", "pred")


@query("v03_confusion_shares", f"""with {_S} select y as actual, pred as predicted, count(*)::bigint as n,
  round(count(*) / sum(count(*)) over (partition by y), 9) as share from t group by y, pred""")
def v03(spark, sf):
    return metrics.confusion_shares(scored(spark, sf), "y", "pred").withColumn("share", F.round("share", 9))


@query("n12_n17_regression_metrics", """
with t as (select l_extendedprice as y, l_quantity * 1500 as p from lineitem),
c as (select 1 - var_pop(y-p)/var_pop(y) ev, avg(abs(y-p)) mae, avg(abs(y-p)/greatest(abs(y),2.220446049250313e-16)) mape,
  quantile_cont(abs(y-p), 0.5) med, avg(pow(y-p,2)) mse, 1 - avg(pow(y-p,2))/var_pop(y) r2 from t) """
       + " union all ".join(f"select '{m}' as metric, round({e}, {d}) as value from c" for m, e, d in (
           ("explained_variance", "ev", 5), ("neg_mean_absolute_error", "mae", 5), ("neg_mean_absolute_percentage_error", "mape", 5),
           ("neg_median_absolute_error", "med", 5), ("neg_mean_squared_error", "mse / 1e6", 5), ("r2", "r2", 5))))
def n12(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = metrics.regression_metrics(df, "y", "p")
    value = F.when(F.col("metric") == "neg_mean_squared_error", F.col("value") / 1e6).otherwise(F.col("value"))
    return out.withColumn("value", F.round(value, 5))


_RANK = """r as (select p_partkey, p_brand, p_size as y, round(p_retailprice / 50, 0) + p_size % 7 as p from part)"""


def ranked(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.col("p_size").alias("y"),
        (F.round(F.col("p_retailprice") / 50, 0) + F.col("p_size") % 7).alias("p"))


def _dcg_sql(part):
    by = f"partition by {part}" if part else ""
    group = f"{part}, " if part else ""
    return f"""a as (select *, 1 / log2(row_number() over ({by} order by p desc) + 1) as d, 1 / log2(row_number() over ({by} order by y desc) + 1) as b from r),
g as (select {group} p, avg(y) * sum(d) as gain from a group by {group} p),
x as (select {group or ''} sum(gain) as dcg from g {'group by ' + part if part else ''}),
z as (select {group or ''} sum(y * b) as best from a {'group by ' + part if part else ''})"""


@query("n18_dcg", f"with {_RANK}, {_dcg_sql('')} select round(dcg, 6) as dcg_score, round(dcg / best, 8) as ndcg_score from x, z")
def n18(spark, sf):
    out = metrics.dcg(ranked(spark, sf), "y", "p", "p_partkey")
    return out.select(F.round("dcg_score", 6).alias("dcg_score"), F.round("ndcg_score", 8).alias("ndcg_score"))


@query("n18_dcg_by_group", f"with {_RANK}, {_dcg_sql('p_brand')} select p_brand, round(dcg, 6) as dcg_score, round(dcg / best, 8) as ndcg_score from x join z using (p_brand)")
def n18g(spark, sf):
    out = metrics.dcg(ranked(spark, sf), "y", "p", "p_partkey", ["p_brand"])
    return out.select("p_brand", F.round("dcg_score", 6).alias("dcg_score"), F.round("ndcg_score", 8).alias("ndcg_score"))


_PAIRS = f"""{_RANK}, q as (select a.p_brand, count(*)::double pairs,
  sum(((a.y - b.y) * (a.p - b.p) > 0)::int)::double concordant, sum(((a.y - b.y) * (a.p - b.p) < 0)::int)::double discordant,
  sum((a.y = b.y)::int)::double tied_y, sum((a.p = b.p)::int)::double tied_pred, sum((a.y = b.y and a.p = b.p)::int)::double tied_both
  from r a join r b on a.p_brand = b.p_brand and a.p_partkey < b.p_partkey group by 1)"""


@query("j09_group_pairs", f"with {_PAIRS} select * from q")
def j09(spark, sf):
    return metrics.pair_counts(ranked(spark, sf), "y", "p", ["p_brand"])


@query("n19_kendall_tau", f"""with {_PAIRS} select p_brand, round((concordant - discordant) / sqrt((pairs - tied_y) * (pairs - tied_pred)), 9) as kendall_tau
from q where (pairs - tied_y) * (pairs - tied_pred) > 0""")
def n19(spark, sf):
    out = metrics.kendall_tau(ranked(spark, sf), "y", "p", ["p_brand"])
    return out.withColumn("kendall_tau", F.round("kendall_tau", 9))


@query("b05_blend", """
select l_orderkey, l_linenumber, l_partkey, round((l_discount * 10 + l_tax * 10 + l_quantity / 50) / 3, 9) as proba,
       round_even((l_discount * 10 + l_tax * 10 + l_quantity / 50) / 3, 0)::int as pred from lineitem""")
def b05(spark, sf):
    from tabforge.operators.blending import blend_probabilities

    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"),
        (F.col("l_quantity") / 50).alias("c"))
    out = blend_probabilities(df, ["a", "b", "c"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("proba", 9).alias("proba"), "pred")


@query("b06_best_model", f"""with {_S}, m as (select 'TWICE' as algo, avg(pow(least(2 * p, 1) - y, 2)) as value from t
  union all select 'PLAIN', avg(pow(p - y, 2)) from t union all select 'HALF', avg(pow(p / 2 - y, 2)) from t)
select algo, round(value, 9) as value from m order by value, algo limit 1""")
def b06(spark, sf):
    df = scored(spark, sf)
    parts = []
    for algo, p in (("TWICE", F.least(F.col("p") * 2, F.lit(1.0))), ("PLAIN", F.col("p")), ("HALF", F.col("p") / 2)):
        rows = metrics.probability_metrics(df.withColumn("q", p), "y", "q")
        parts.append(rows.select(F.lit(algo).alias("algo"), F.lit("train").alias("partition"), "metric", "value"))
    stacked = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return metrics.best_algorithm(stacked, "neg_brier_score", "train").withColumn("value", F.round("value", 9))


# -- curves ---------------------------------------------------------------------------


@query("v01_calibration_curve", f"""with {_S} select greatest(ceil(p * 10) - 1, 0)::int as bin, count(*)::bigint as n,
  round(avg(p), 8) as mean_predicted, round(avg(y), 8) as fraction_positive from t group by 1""")
def v01(spark, sf):
    out = curves.calibration_curve(scored(spark, sf), "y", "p")
    return out.select("bin", "n", F.round("mean_predicted", 8).alias("mean_predicted"), F.round("fraction_positive", 8).alias("fraction_positive"))


@query("v02_roc_points", f"""with {_S}, g as (select p, sum(y)::double pos, sum(1-y)::double neg from t group by p)
select p as threshold, round(sum(neg) over w / sum(neg) over (), 9) as fpr, round(sum(pos) over w / sum(pos) over (), 9) as tpr
from g window w as (order by p desc)""")
def v02(spark, sf):
    out = metrics.roc_points(scored(spark, sf), "y", "p")
    return out.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("v09_facet_histogram", """
with q as (select min(l_extendedprice) lo, max(l_extendedprice) hi, count(*)::double n,
  quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) iqr from lineitem),
b as (select lo, hi, greatest(ceil((hi - lo) / (2 * iqr * pow(n, -1.0/3))) - 1, 1) as k from q)
select l_returnflag, l_linestatus, least(floor((l_extendedprice - lo) / ((hi - lo) / k)), k - 1)::int as bin, count(*)::bigint as n
from lineitem, b group by 1, 2, 3""")
def v09(spark, sf):
    out = curves.facet_histogram(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus")
    return out.select("l_returnflag", "l_linestatus", "bin", "n")


@query("v10_histogram", """
with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
select least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*)::bigint as n from orders, b group by 1""")
def v10(spark, sf):
    return curves.histogram(table(spark, sf, "orders"), "o_totalprice", 20).select("bin", "n")


@query("v11_box_statistics", """
select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 5) as q1, round(quantile_cont(l_extendedprice, 0.5), 5) as median,
  round(quantile_cont(l_extendedprice, 0.75), 5) as q3, min(l_extendedprice) as low, max(l_extendedprice) as high, count(*)::bigint as n
from lineitem group by 1, 2""")
def v11(spark, sf):
    out = curves.box_statistics(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus")
    return out.withColumns({c: F.round(c, 5) for c in ("q1", "median", "q3")})


@query("v12_scatter", "select l_quantity, l_extendedprice, l_returnflag from lineitem")
def v12(spark, sf):
    return curves.scatter_points(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag"], "l_orderkey")


@query("v13_time_series", """
select date_trunc('hour', ts) as bucket, round(avg(value), 8) as mean, min(value) as low, max(value) as high, count(*)::bigint as n from events group by 1""")
def v13(spark, sf):
    out = curves.time_series(table(spark, sf, "events"), "ts", "value", "hour")
    return out.withColumn("mean", F.round("mean", 8)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# -- splits ----------------------------------------------------------------------------


def _h(key, seed=0):
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint"


@query("k01_split", f"select o_orderkey, {_h('o_orderkey')} / 4294967296.0 < 0.25 as is_test from orders")
def k01(spark, sf):
    train, test = split.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.25)
    return train.withColumn("is_test", F.lit(False)).unionAll(test.withColumn("is_test", F.lit(True)))


@query("k03_folds", f"select o_orderkey, ({_h('o_orderkey', 7)} % 5)::int as fold from orders")
def k03(spark, sf):
    return split.add_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5, seed=7)


@query("k04_stratified", f"""select o_orderkey, o_orderstatus,
  ((row_number() over (partition by o_orderstatus order by {_h('o_orderkey')}, o_orderkey) - 1) % 5)::int as fold from orders""")
def k04(spark, sf):
    return split.add_stratified_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5)


@query("k05_shuffle", "select o_orderkey, o_totalprice from orders")
def k05(spark, sf):
    return split.shuffle_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", seed=3)


@query("k06_validation_mark", f"select o_orderkey, {_h('o_orderkey', 1)} / 4294967296.0 < 0.2 as validation from orders")
def k06(spark, sf):
    return split.mark_validation(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, seed=1)


@query("l01_undersample", f"""with c as (select o_orderpriority, count(*)::double n from orders group by 1)
select o_orderkey, o_orderpriority from orders join c using (o_orderpriority)
where {_h('o_orderkey')} / 4294967296.0 < least(1.0, (select min(n) from c) / n)""")
def l01u(spark, sf):
    return split.undersample(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query("l01_oversample", f"""with c as (select quality, count(*)::double n from labels group by 1),
t as (select doc_id, quality, (select max(n) from c) / n as k from labels join c using (quality))
select doc_id, quality, (floor(k) + ({_h('doc_id')} / 4294967296.0 < k - floor(k))::int)::bigint as copies from t""")
def l01o(spark, sf):
    out = split.oversample(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")
    return out.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("copies"))


@query("l02_class_weights", """select o_orderkey, round((select count(*) from orders)::double / (3 * count(*) over (partition by o_orderstatus)), 9) as weight from orders""")
def l02(spark, sf):
    out = split.class_weights(table(spark, sf, "orders"), "o_orderstatus")
    return out.select("o_orderkey", F.round("weight", 9).alias("weight"))


# -- feature tests --------------------------------------------------------------------------

_FEATURES = ("l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _y(spark, sf):
    return table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))


def _f_sql(c):
    return f"""select '{c}' as feature, round((b / 1) / (w / (n - 2)), 4) as score from (
      select sum(nc * pow(mc - m, 2)) b, sum(ss) w, sum(nc) n from (
        select count(*)::double nc, avg({c}) mc, sum(pow({c} - mm, 2)) ss, any_value(m) m from (
          select {c}, (l_quantity > 25) y, avg({c}) over (partition by l_quantity > 25) mm, avg({c}) over () m from lineitem) group by y))"""


@query("f01_anova", " union all ".join(_f_sql(c) for c in _FEATURES))
def f01(spark, sf):
    return selection.f_classif(_y(spark, sf), _FEATURES, "y").select("feature", F.round("score", 4).alias("score"))


@query("f02_freg", " union all ".join(
    f"select '{c}' as feature, round(pow(r, 2) / (1 - pow(r, 2)) * (n - 2), 4) as score from (select corr({c}, l_quantity) r, count(*) n from lineitem)"
    for c in _FEATURES))
def f02(spark, sf):
    return selection.f_regression(table(spark, sf, "lineitem"), _FEATURES, "l_quantity").select("feature", F.round("score", 4).alias("score"))


@query("f03_chi2", " union all ".join(
    f"""select '{c}' as feature, round(sum(pow(o - nc / n * t, 2) / (nc / n * t)), 3) as score from (
    select sum({c}) o, count(*)::double nc, sum(sum({c})) over () t, sum(count(*)) over () n from lineitem group by l_quantity > 25)"""
    for c in _FEATURES))
def f03(spark, sf):
    return selection.chi2(_y(spark, sf), _FEATURES, "y").select("feature", F.round("score", 3).alias("score"))


@query("f04_percentile_support", f"""with s as ({" union all ".join(_f_sql(c) for c in _FEATURES)})
select feature, 'percentile' as kind, row_number() over (order by score desc, feature) <= 2 as keep from s""")
def f04(spark, sf):
    return selection.support(selection.f_classif(_y(spark, sf), _FEATURES, "y"), "percentile", 50)


@query("f06_variance", " union all ".join(
    f"select '{c}' as feature, 'variance' as kind, var_pop({c}) > 0.001 as keep from lineitem" for c in _FEATURES))
def f06(spark, sf):
    return selection.low_variance(table(spark, sf, "lineitem"), _FEATURES, 0.001)


@query("x03_interactions", """
with z as (select avg(l_extendedprice * l_discount) a, stddev_pop(l_extendedprice * l_discount) d from lineitem)
select l_orderkey, l_linenumber, l_partkey, round((l_extendedprice * l_discount - a) / d, 7) as product from lineitem, z""")
def x03(spark, sf):
    # the two features that best tell large from small discounted revenue
    df = table(spark, sf, "lineitem").withColumn("y", (F.col("l_extendedprice") * F.col("l_discount") > 1000).cast("int"))
    model = selection.fit_interactions(df, ["l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "y", 50, 2)
    out = model.transform(df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(f"`{model.names[0]}`", 7).alias("product"))


# -- text -------------------------------------------------------------------------------------

_TOKENS = r"""tok as (select doc_id, regexp_extract_all(lower(coalesce(text, 'NULLTEXT')), '[\p{L}\p{N}_]{2,}') as w from documents)"""


def _tfidf_sql(grams):
    return f"""with {_TOKENS}, g as ({grams}), c as (select doc_id, term, count(*)::double tf from g group by 1, 2),
f as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*)::double)) + 1 as idf from c group by 1),
w as (select doc_id, term, tf * idf as w from c join f using (term))
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 8) as weight from w"""


@query("t01_tfidf", _tfidf_sql("select doc_id, unnest(w) as term from tok"))
def t01(spark, sf):
    out = text.tf_idf(table(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 8))


@query("t01_tfidf_bigrams", _tfidf_sql("""select doc_id, unnest(w) as term from tok union all
  select doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from tok"""))
def t01b(spark, sf):
    out = text.tf_idf(table(spark, sf, "documents"), "doc_id", "text", ngrams_max=2)
    return out.withColumn("weight", F.round("weight", 8))
