"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores;
``BENCH_QUERIES`` restricts the list. Results go to a no-op sink, so all columns of all
rows are computed. The first query is run once beforehand to start the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestor.session import build_session  # noqa: E402

HEADLINE = [
    "d6_feature_auroc",
    "d6_sparse_feature_auroc",
    "d14_probe_report",
    "d20_decompose_draws",
    "d21_average_precision",
    "b22_topk_encode",
    "d1_norm_stats",
    "d2_reconstruction_metrics",
    "f1_top_units",
    "c2_window_element_classes",
    "c3_window_genes",
    "c4_points_in_windows",
    "d37_genomic_verdicts",
    "c10_pooled_sweep_rows",
    "d25_cluster_bootstrap_mean",
    "d28_pooled_interaction",
    "d31_fdr_adjust",
    "d34_agreement",
    "d38_log_log_curve",
    "c7_dosage_expression_join",
    "d49_mediation_points",
    "a3_annotation_scan",
    "a10_variant_dosage",
    "b12_haplotype_sequences",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", app="bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    from attestor.workload import load_catalog

    queries, _ = load_catalog()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE

    def run(name: str) -> float:
        begin = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run(names[0])
    timings = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
