"""Seconds per headline query; prints one JSON line.

Every query is timed from building its plan to writing all its rows to a sink that drops
them, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from layerlens.plans.catalog import QUERIES
from layerlens.session import local_session

HEADLINE = (
    "a21_evaluation_results",
    "a22_prompt_results",
    "a18_confusion_matrix",
    "a24_layer_pooling_interaction",
    "w4_best_per_pooling",
    "x4_test_table",
    "a2_length_summary",
    "a3_length_spread",
    "a6_distinct_counts",
    "a7_vocabulary_size",
    "a9_length_histogram_words",
    "a10_length_density_words",
    "a11_box_statistics",
    "a12_profile_report",
    "w9_top_words",
    "w10_top_bigrams",
    "r2_shuffle",
    "r3_bounded_reduction",
    "f1_truncate_pad_tuning",
    "f8_masked_mean_pooling",
    "f9_pooling_dispatch",
    "f11_standardised_features",
    "e1_state_extraction",
    "e5_prompt_dispatch",
    "e6_batch_generation",
    "s8_prediction_source",
    "s14_resume_list",
    "v2_incremental_evaluation",
    "j4_nearest_neighbours",
    "j4_approximate_neighbours",
    "m1_logistic_regression",
    "m2_linear_svm",
    "m4_kernel_svm",
    "m5_decision_tree",
    "m6_random_forest",
    "m9_gaussian_naive_bayes",
    "m10_nearest_neighbour_vote",
    "m10_indexed_neighbour_vote",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run("a13_accuracy")
    seconds = {name: round(run(name), 3) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
