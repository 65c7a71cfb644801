"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import logging
import os
import time

from dawnscore.plans import load_all
from dawnscore.plans.registry import QUERIES
from dawnscore.session import local_session

HEADLINE = [
    "a05_wide_sink", "b08_soft_target", "c09_overlap_weighted", "c14_dense_grid", "d05_file_stats",
    "d21_aliveness", "d26_transitions", "e01_percentile_rank", "e15_adaptive_blend",
    "e18_gaussian_nearest", "e25_kalman_rts", "e29_file_coherence", "f03_site_capped",
    "h03_zscore_blend", "h20_rescue_rules", "h23_best_class_weight", "i02_shrunk_prior",
    "j05_refine", "k03_centroid_similarity", "k05_knn", "l02_macro_auc", "l06_row_spearman",
    "l28_parameter_grid", "m08_saved_detector", "n08_hard_pairs", "p01_flagship_macro_auc",
    "p02_fused_scores"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cores, app="dawnscore-bench", **{"spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # one untimed run of two queries: JVM and Python workers start up
    for name in ("e15_adaptive_blend", "k03_centroid_similarity"):
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    cells = QUERIES["c14_dense_grid"](spark, sf_dir).count()
    total = sum(seconds.values())
    print(json.dumps({"metric": "headline_queries_total", "value": round(total, 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cores": int(cores), "score_cells": cells,
                      "cells_per_sec": {k: round(cells / v) for k, v in seconds.items() if k[0] in "dehilp"}}))
    spark.stop()


if __name__ == "__main__":
    main()
