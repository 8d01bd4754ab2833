"""End-to-end runs, and registered queries next to their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from attestor.operators.probing import ProbeConfig
from attestor.operators.vectors import Dictionary
from attestor.plans import evaluation as E
from attestor.session import materialize, release
from tools.check_queries import normal


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    n, m, d = 240, 8, 24
    x = rng.normal(size=(n, m))
    w = rng.normal(size=(d, m))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "unit_id int, vec array<double>").cache()
    weights = spark.createDataFrame(
        [(i, [float(v) for v in r], 0.0, [float(v) for v in r]) for i, r in enumerate(w)],
        "feature_idx int, w_enc array<double>, b_enc double, w_dec array<double>",
    )
    strong = x @ w[3] > np.quantile(x @ w[3], 0.7)
    labels = [(int(i), "strong") for i in np.where(strong)[0]] + [(int(i), f"noise{k}") for k in range(3) for i in rng.choice(n, 15 * (k + 1), replace=False)]
    return vectors, weights, spark.createDataFrame(labels, "unit_id int, concept_id string")


def test_evaluate_and_sweep(spark, world):
    vectors, weights, labels = world
    features = E.encode_units(vectors, Dictionary(weights, [0.0] * 8), 6, normalize=True)
    units = vectors.select("unit_id")
    config = ProbeConfig(min_positives=10)
    out = E.evaluate(features, units, labels, config, n_permutations=2)
    report = {r["concept_id"]: r for r in out["report"].collect()}
    assert report["strong"]["single_feature_auroc"] > 0.75  # encoded from the direction that defines the label
    assert out["summary"].first()["n_concepts"] == 4
    assert {r["concept_id"]: r["n_seeds"] for r in out["decomposition"].collect()} == {c: 2 for c in report}
    rows = E.sweep(features, units, labels, config, points=[10, 20, 40]).collect()
    got = {}
    for r in rows:
        got.setdefault(r["min_positives"], set()).add(r["concept_id"])
    assert got == {10: {"strong", "noise0", "noise1", "noise2"}, 20: {"strong", "noise1", "noise2"}, 40: {"strong", "noise2"}}
    assert all(r["single_feature_auroc"] == pytest.approx(report[r["concept_id"]]["single_feature_auroc"]) for r in rows)


def test_confirmatory_fit_runs_on_the_join(spark):
    rng = np.random.default_rng(2)
    rows, entries = [], []
    for model in ("a", "b"):
        for f in range(40):
            status = ["confirmed", "plausible", "spurious"][rng.integers(0, 3)]
            entries.append((model, f, status, [f"c{f}"]))
            rows += [(model, int(p), f"c{f}", f) for p in rng.choice([10, 50, 100, 300], 2, replace=False)]
    sweeps = spark.createDataFrame(rows, "model string, min_positives int, concept_id string, best_feature_idx int")
    registry = spark.createDataFrame(entries, "model string, feature_idx int, status string, claimed array<string>")
    slopes, summary = E.confirmatory_fit(sweeps, registry, draws=20)
    assert {r["model"] for r in slopes.collect()} == {"a", "b"} and summary.first()["n_rows"] == 160


def test_materialized_tables_can_be_released(spark):
    kept = materialize(spark.range(5).select(F.col("id"), F.array("id").alias("a")))
    assert kept.count() == 5
    assert release(spark) >= 1 and release(spark) == 0


SAMPLE = [
    "d6_feature_auroc", "d14_probe_report", "d22_f1_mcc", "b22_topk_encode", "c2_window_element_classes", "c3_window_genes",
    "d31_fdr_adjust", "d34_agreement", "d49_mediation_points", "d25_cluster_bootstrap_mean", "a11_window_calls", "f5_strided_sample",
    "e2_running_positives", "b12_haplotype_sequences",
]


@pytest.fixture(scope="module")
def twin(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql_twin(spark, sf, twin, name):
    df = entry_module.queries()[name](spark, sf)
    result = twin.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(tuple(normal(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(normal(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert mine == theirs


def test_registry_is_complete():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 160
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}
    assert own <= set(oracles)
