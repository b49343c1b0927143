"""Scores of predictions as tables (metric, value).

Counts come from one small table of classes. Ranking curves first count equal
scores, then use running sums that split over range partitions, so no score
list is sorted in one place and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.plans.scale import BLOCK_ROWS, exact_quantiles, lookup_join, materialise, positions, prefix_sums

# Scorer name -> kind of model and whether larger is better.
SCORERS = {
    "accuracy": ("classification", True),
    "average_precision": ("classification", True),
    "balanced_accuracy": ("classification", True),
    "neg_brier_score": ("classification", False),
    "f1": ("classification", True),
    "f1_macro": ("classification", True),
    "f1_micro": ("classification", True),
    "f1_weighted": ("classification", True),
    "neg_log_loss": ("classification", False),
    "precision": ("classification", True),
    "recall": ("classification", True),
    "roc_auc": ("classification", True),
    "dcg_score": ("ranking", True),
    "kendall_tau": ("ranking", True),
    "ndcg_score": ("ranking", True),
    "explained_variance": ("regression", True),
    "neg_mean_absolute_error": ("regression", False),
    "neg_mean_absolute_percentage_error": ("regression", False),
    "neg_mean_squared_error": ("regression", False),
    "neg_median_absolute_error": ("regression", False),
    "r2": ("regression", True),
}
# Clip of probabilities in the log loss, floor of |y| in the percentage error.
EPSILON = 2.220446049250313e-16


def labeled(df: DataFrame, y: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull())


def has_classes(df: DataFrame, y: str) -> bool:
    """False when labels are all missing or all equal: no metric is worked out then."""
    low, high = df.agg(F.min(y), F.max(y)).first()
    return low is not None and low != high


def _metric_rows(wide: DataFrame) -> DataFrame:
    items = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns]
    return wide.select(F.inline(F.array(*items)))


# -- classification -------------------------------------------------------------


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return labeled(df, y).groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_shares(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Confusion counts with each row's share of its actual class."""
    counts = confusion(df, y, pred)
    totals = counts.groupBy("actual").agg(F.sum("n").alias("_t"))
    return lookup_join(counts, totals, "actual", "inner").withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def _class_table(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class: hits, actual count, predicted count."""
    both = F.array(
        F.struct(F.col("actual").cast("double").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").cast("double").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("hit")),
    )
    rows = confusion(df, y, pred).select(F.inline(both))
    return rows.groupBy("c").agg(F.sum("hit").cast("double").alias("hit"), F.sum("t").cast("double").alias("t"),
                                 F.sum("p").cast("double").alias("p"))


def label_metrics(df: DataFrame, y: str, pred: str, positive: float = 1.0) -> DataFrame:
    """Metrics of predicted labels; binary ones refer to the positive class."""
    c = _class_table(df, y, pred)
    hit, t, p = F.col("hit"), F.col("t"), F.col("p")
    f1 = 2 * hit / (t + p)
    is_pos = F.col("c") == positive
    sums = c.agg(
        F.sum("t").alias("n"), F.sum("hit").alias("hits"), F.avg(F.when(t > 0, hit / t)).alias("balanced"),
        F.avg(f1).alias("macro"), F.sum(t * f1).alias("weighted"), F.sum(t * p).alias("tp"), F.sum(t * t).alias("tt"),
        F.sum(p * p).alias("pp"), F.sum(F.when(is_pos, hit)).alias("h1"), F.sum(F.when(is_pos, t)).alias("t1"),
        F.sum(F.when(is_pos, p)).alias("p1"),
    )
    n = F.col("n")
    chance = F.col("tp") / (n * n)
    spread = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    accuracy = F.col("hits") / n
    wide = sums.select(
        accuracy.alias("accuracy"),
        F.col("balanced").alias("balanced_accuracy"),
        F.coalesce((accuracy - chance) / F.nullif(1 - chance, F.lit(0.0)), F.lit(0.0)).alias("cohen_kappa"),
        F.coalesce((F.col("hits") * n - F.col("tp")) / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("matthews_corrcoef"),
        F.coalesce(2 * F.col("h1") / F.nullif(F.col("t1") + F.col("p1"), F.lit(0.0)), F.lit(0.0)).alias("f1"),
        F.col("macro").alias("f1_macro"),
        accuracy.alias("f1_micro"),
        (F.col("weighted") / n).alias("f1_weighted"),
        F.coalesce(F.col("h1") / F.nullif(F.col("p1"), F.lit(0.0)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("h1") / F.nullif(F.col("t1"), F.lit(0.0)), F.lit(0.0)).alias("recall"),
    )
    return _metric_rows(wide)


def probability_metrics(df: DataFrame, y: str, proba: str) -> DataFrame:
    """Brier score and log loss."""
    p = F.col(proba)
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    loss = F.when(F.col(y) == 1, F.log(clipped)).otherwise(F.log(1 - clipped))
    wide = labeled(df, y).agg(
        F.avg((p - F.col(y)) * (p - F.col(y))).alias("neg_brier_score"), (-F.avg(loss)).alias("neg_log_loss"))
    return _metric_rows(wide)


def score_table(df: DataFrame, y: str, score: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per distinct score: positives, negatives, and those at lower scores."""
    counted = labeled(df, y).groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    counted = materialise(counted)
    sums = {"pos_below": F.col("pos"), "neg_below": F.col("neg")}
    return prefix_sums(counted, [], [F.col("score")], sums, inclusive=False, block_rows=block_rows)


def curve_metrics(df: DataFrame, y: str, proba: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ROC AUC and average precision, exact."""
    s = score_table(df, y, proba, block_rows)
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    total = s.agg(pos.alias("p"), neg.alias("n")).first()
    p, n = F.lit(total["p"]), F.lit(total["n"])
    above = p - F.col("pos_below")
    precision = above / (above + n - F.col("neg_below"))
    wide = s.agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2) / (p * n)).alias("roc_auc"),
        F.sum(F.col("pos") / p * precision).alias("average_precision"),
    )
    return _metric_rows(wide)


def roc_points(df: DataFrame, y: str, proba: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    s = score_table(df, y, proba, block_rows)
    total = s.agg(F.sum("pos"), F.sum("neg")).first()
    return s.select(
        F.col("score").alias("threshold"),
        ((F.lit(total[1]) - F.col("neg_below")) / F.lit(total[1])).alias("fpr"),
        ((F.lit(total[0]) - F.col("pos_below")) / F.lit(total[0])).alias("tpr"),
    )


def classification_metrics(df: DataFrame, y: str, pred: str, proba: str | None = None) -> DataFrame:
    df = labeled(df, y)
    if not has_classes(df, y):
        return df.sparkSession.createDataFrame([], "metric string, value double")
    out = label_metrics(df, y, pred)
    if proba:
        out = out.unionAll(probability_metrics(df, y, proba)).unionAll(curve_metrics(df, y, proba))
    return out


def multiclass_log_loss(df: DataFrame, y: str, probabilities: str) -> DataFrame:
    """Mean of -ln p of the true class, probabilities clipped away from 0; a class beyond the array has probability 0."""
    p = F.coalesce(F.get(probabilities, F.col(y).cast("int")), F.lit(0.0))
    value = F.avg(-F.log(F.greatest(F.lit(EPSILON), F.least(p, F.lit(1.0) - EPSILON))))
    return labeled(df, y).agg(value.alias("value")).filter("value is not null").select(F.lit("neg_log_loss").alias("metric"), "value")


# -- regression --------------------------------------------------------------------


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    e = t - p
    df = labeled(df, y)
    if not has_classes(df, y):
        return df.sparkSession.createDataFrame([], "metric string, value double")
    wide = df.agg(
        (1 - F.var_pop(e) / F.var_pop(t)).alias("explained_variance"),
        F.avg(F.abs(e)).alias("neg_mean_absolute_error"),
        F.avg(F.abs(e) / F.greatest(F.abs(t), F.lit(EPSILON))).alias("neg_mean_absolute_percentage_error"),
        F.avg(e * e).alias("neg_mean_squared_error"),
        (1 - F.avg(e * e) / F.var_pop(t)).alias("r2"),
    )
    median = exact_quantiles(df.select(F.abs(e).alias("e")), ["e"], [0.5])["e"][0]
    return _metric_rows(wide.withColumn("neg_median_absolute_error", F.lit(median)))


# -- ranking ----------------------------------------------------------------------


def _discounted(df: DataFrame, group: Sequence[str], order: Sequence[Column], block_rows: int) -> DataFrame:
    ranked = positions(df, group, order, "_rank", block_rows)
    return ranked.withColumn("_discount", 1 / F.log2(F.col("_rank") + 1))


def dcg(df: DataFrame, y: str, pred: str, key: str, group: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Discounted cumulative gain of the predicted order (ties averaged) and its normalised form, per group."""
    group = list(group)
    df = labeled(df, y).select(*group, F.col(key).alias("_key"), F.col(y).cast("double").alias("_y"), F.col(pred).alias("_p"))
    got = _discounted(df, group, [F.desc("_p"), F.col("_key")], block_rows).groupBy(*group, "_p").agg(
        (F.avg("_y") * F.sum("_discount")).alias("_g"))
    got = got.groupBy(*group).agg(F.sum("_g").alias("dcg_score"))
    best = _discounted(df, group, [F.desc("_y"), F.col("_key")], block_rows).groupBy(*group).agg(
        F.sum(F.col("_y") * F.col("_discount")).alias("_best"))
    if group:
        both = got.join(best, group)
    else:
        both = got.withColumn("_best", F.lit(best.first()[0]))
    ratio = F.coalesce(F.col("dcg_score") / F.nullif(F.col("_best"), F.lit(0.0)), F.lit(0.0))
    return both.withColumn("ndcg_score", ratio).drop("_best")


def pair_counts(df: DataFrame, y: str, pred: str, group: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Concordant, discordant and tied pairs per group, counted without forming pairs.

    Equal (prediction, value) rows are counted first. A discordant pair has the
    smaller prediction with the larger value: with values numbered 0, 1, ... per
    group, the two numbers agree in their leading bits and differ in one, which
    is 1 for the earlier row. So for every bit, rows sharing the leading bits are
    walked in order of prediction and zeros count the ones before them. Each row
    takes part once per bit, and long walks split into blocks.
    """
    group = list(group)
    cells = labeled(df, y).groupBy(*group, F.col(pred).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c"))
    cells = materialise(cells)

    def pairs(keys: Sequence[str], name: str) -> DataFrame:
        n = F.col("_n").cast("double")
        sizes = cells.groupBy(*group, *keys).agg(F.sum("_c").alias("_n"))
        return sizes.groupBy(*group).agg(F.sum(n * (n - 1) / 2).alias(name))

    values = positions(cells.select(*group, "_y").distinct(), group, [F.col("_y")], "_r", block_rows)
    values = materialise(values.withColumn("_r", F.col("_r") - 1))
    bits = max(int(values.agg(F.max("_r")).first()[0] or 0).bit_length(), 1)
    ranked = lookup_join(cells, values, [*group, "_y"], "inner")
    levels = F.array(
        *[
            F.struct(F.lit(b).alias("_bit"), F.shiftright("_r", b + 1).alias("_lead"), F.shiftright("_r", b).bitwiseAND(F.lit(1)).alias("_one"))
            for b in range(bits)
        ]
    )
    walk = ranked.select(*group, "_x", "_y", "_c", F.inline(levels))
    ones = {"_ones": F.when(F.col("_one") == 1, F.col("_c")).otherwise(0)}
    run = prefix_sums(walk, [*group, "_bit", "_lead"], [F.col("_x"), F.col("_y")], ones, inclusive=False, block_rows=block_rows)
    crossed = F.when(F.col("_one") == 0, F.col("_c").cast("double") * F.col("_ones")).otherwise(0.0)
    out = run.groupBy(*group).agg(F.sum(crossed).alias("discordant"))
    for keys, name in (([], "pairs"), (["_y"], "tied_y"), (["_x"], "tied_pred"), (["_x", "_y"], "tied_both")):
        part = pairs(keys, name)
        out = out.join(part, group) if group else out.withColumn(name, F.lit(part.first()[0]))
    same = F.col("pairs") - F.col("tied_y") - F.col("tied_pred") + F.col("tied_both") - F.col("discordant")
    return out.withColumn("concordant", same)


def kendall_tau(df: DataFrame, y: str, pred: str, group: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kendall's tau-b per group; groups where it is undefined are left out."""
    c = pair_counts(df, y, pred, group, block_rows)
    root = F.sqrt((F.col("pairs") - F.col("tied_y")) * (F.col("pairs") - F.col("tied_pred")))
    tau = (F.col("concordant") - F.col("discordant")) / F.nullif(root, F.lit(0.0))
    return c.select(*group, tau.alias("kendall_tau")).filter("kendall_tau is not null")


def ranking_metrics(df: DataFrame, y: str, pred: str, key: str, group: Sequence[str]) -> DataFrame:
    """DCG and NDCG of the whole table, their means over groups, and the mean Kendall tau over groups."""
    whole = _metric_rows(dcg(df, y, pred, key))
    per = dcg(df, y, pred, key, group).agg(
        F.avg("dcg_score").alias("mean_group_dcg_score"), F.avg("ndcg_score").alias("mean_group_ndcg_score"))
    tau = kendall_tau(df, y, pred, group).agg(F.avg("kendall_tau").alias("kendall_tau"))
    return whole.unionAll(_metric_rows(per)).unionAll(_metric_rows(tau))


# -- comparison ------------------------------------------------------------------------


def best_algorithm(metrics: DataFrame, scorer: str, partition: str) -> DataFrame:
    """The algorithm with the best value of a scorer; the blend is no candidate."""
    larger = SCORERS[scorer][1]
    rows = metrics.filter((F.col("metric") == scorer) & (F.col("partition") == partition) & (F.col("algo") != "BLEND"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rank = F.struct(-F.col("value") if larger else F.col("value"), F.col("algo"))
    return rows.agg(F.min_by("algo", rank).alias("algo"), F.min_by("value", rank).alias("value"))
