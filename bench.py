"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores.
Every query is run to completion by writing its rows to the noop sink.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from tabforge import catalogue
from tabforge.session import get_spark

HEADLINE = [
    "c01_dateparts", "c03_bizday", "c16_next_prev_holiday", "j05_holidays_in_month", "j06_nearest_events",
    "w01_lags", "w02_forecast_target", "w05_topk_group", "w07_time_split", "p09_variables", "p15_symbols",
    "a03_distinct", "a05_crosstab", "a09_profile", "a10_normality", "r02_digit_counts", "r03_rowstats", "r13_scipy",
    "i01_median", "i02_mode", "i07_standard", "e02_onehot", "e10_target", "e13_leaveone", "e14_w06_catboost", "e17_t02_factorize",
    "t01_tfidf", "t01_tfidf_bigrams", "f01_anova", "f02_freg", "f03_chi2", "x03_interactions", "k01_split", "k04_stratified",
    "n01_label_metrics", "n02_n11_curve_metrics", "n12_n17_regression_metrics", "n18_dcg", "n19_kendall_tau",
    "v01_calibration_curve", "v09_facet_histogram", "v11_box_statistics", "b03_venn_abers", "j10_neighbours",
    "g01_logistic", "g02_linear", "g03_random_forest", "g07_pairwise_ranker", "x01_kmeans", "x02_pca", "flagship_panel_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = get_spark(
        f"local[{cpus}]", app="bench", spark__sql__shuffle__partitions="16", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": pathlib.Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
