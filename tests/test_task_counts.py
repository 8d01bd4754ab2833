"""Large joins and groupings are dealt into tasks counted by rows, with the same results."""

import random

from attestor import session
from attestor.operators import registry as R
from attestor.workload.registry_queries import strongest_lines


def test_sweep_rows_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 40)
    rng = random.Random(3)
    sweep = [(rng.choice("AB"), 10 * rng.randrange(1, 4), rng.randrange(20), rng.randrange(9)) for _ in range(600)]
    entries = [(rng.choice("AB"), rng.randrange(9), rng.choice(["confirmed", "spurious", "pending"]), [rng.randrange(20) for _ in range(4)]) for _ in range(60)]
    left = spark.createDataFrame(sweep, "model string, min_positives int, concept_id int, best_feature_idx int")
    right = spark.createDataFrame(entries, "model string, feature_idx int, status string, claimed array<int>")
    out = R.sweep_rows(left, right, keys=["model"])
    target = {"confirmed": 1.0, "spurious": 0.0}
    claims = {(m, f, s, c) for m, f, s, listed in entries for c in listed if s in target}
    expected = [(m, p, c, f, target[s]) for m, p, c, f in sweep for cm, cf, s, cc in claims if (cm, cf, cc) == (m, f, c)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    assert out.rdd.getNumPartitions() >= 600 // 40


def test_strongest_lines_in_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    rng = random.Random(4)
    lines = [(rng.randrange(5), rng.randrange(60), float(rng.randrange(50))) for _ in range(500)]
    out = strongest_lines(spark.createDataFrame(lines, "l_suppkey int, l_orderkey int, l_quantity double"))
    best = {}
    for f, u, a in lines:
        best[f, u] = max(a, best.get((f, u), a))
    assert {(r.feature_idx, r.unit_id): r.act for r in out.collect()} == best
    assert out.rdd.getNumPartitions() >= 500 // 50
