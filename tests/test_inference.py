"""Bootstrap, regression, meta-analysis, multiplicity, equivalence and tails."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import stats as ST
from attestor.functions import tails as T
from attestor.operators import inference as N
from attestor.operators import registry as R


def test_tails_match_known_values():
    assert T.norm_cdf_value(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert T.norm_ppf_value(0.975) == pytest.approx(1.959963984540054, abs=1e-10)
    # textbook quantiles
    for p, df, value in ((0.975, 1, 12.706204736), (0.975, 3, 3.182446305), (0.975, 4, 2.776445105), (0.95, 10, 1.812461123)):
        assert T.t_ppf_value(p, df) == pytest.approx(value, abs=1e-8)
        assert T.t_sf_value(value, df) == pytest.approx(1 - p, abs=1e-9)
    for x, df, p in ((3.841458821, 1, 0.05), (7.814727903, 3, 0.05), (18.307038053, 10, 0.05)):
        assert T.chi2_sf_value(x, df) == pytest.approx(p, abs=1e-9)


def test_tail_batches_equal_single_values():
    rng = np.random.default_rng(4)
    n = 400
    df = np.concatenate([rng.integers(1, 40, n), rng.integers(200, 5000, 40)]).astype(float)
    t = np.concatenate([rng.normal(size=n) * 4, rng.normal(size=40)])
    p = np.concatenate([rng.uniform(1e-9, 1, n), [0.5, 1e-7, 1 - 1e-7], rng.uniform(0.4, 0.6, 37)])
    x = np.abs(t) * df / 2
    close = lambda got, want: np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-13)
    close(T._t_sf_batch(t, df), [T.t_sf_value(*v) for v in zip(t, df)])
    close(T._chi2_batch(x, df), [T.chi2_sf_value(*v) for v in zip(x, df)])
    close(T._cdf_batch(t), [T.norm_cdf_value(v) for v in t])
    np.testing.assert_allclose(T._ppf_batch(p), [T.norm_ppf_value(v) for v in p], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(T._t_ppf_batch(p, df), [T.t_ppf_value(*v) for v in zip(p, df)], rtol=1e-7, atol=1e-12)
    far = T._t_ppf_batch(np.array([1e-12]), np.array([300.0]))  # the single value loses digits in 1 - p here
    close(T._t_sf_batch(-far, np.array([300.0])) * 1e12, [1.0])
    assert np.isnan(T._cdf_batch(np.array([np.nan, np.inf]))).all()
    assert list(T._ppf_batch(np.array([0.0, 1.0]))) == [-np.inf, np.inf] and np.isnan(T._ppf_batch(np.array([-1.0]))).all()
    assert len(T._chi2_batch(np.array([]), np.array([]))) == 0


def test_sql_forms_equal_the_columns(spark):
    T.register_sql(spark)
    df = spark.createDataFrame([(0.7, 12.0, 80.0), (0.5, 3.0, 3.0), (0.99, 1.0, 500.0)], "a double, p double, n double")
    same = df.select(
        F.expr("auroc_variance(a, p, n)").alias("v1"), ST.auroc_variance(F.col("a"), F.col("p"), F.col("n")).alias("v2"),
        F.expr("expected_max_inflation(a, n)").alias("e1"), ST.expected_max_inflation(F.col("a"), F.col("n")).alias("e2"),
        F.expr("logistic_prediction(a, p, n)").alias("l1"), ST.logistic_prediction(F.col("a"), F.col("p"), F.col("n")).alias("l2"),
    )
    for r in same.collect():
        assert (r["v1"], r["e1"], r["l1"]) == pytest.approx((r["v2"], r["e2"], r["l2"]))


def test_tail_columns_keep_nulls(spark):
    df = spark.createDataFrame([(0.0, 5), (None, 5), (2.0, 0)], "z double, df int")
    out = df.select(T.norm_cdf(F.col("z")).alias("n"), T.t_sf(F.col("z"), F.col("df")).alias("t")).collect()
    assert out[0]["n"] == pytest.approx(0.5) and out[0]["t"] == pytest.approx(0.5)
    assert out[1]["n"] is None and out[1]["t"] is None and out[2]["t"] is None
    T.register_sql(spark)
    assert spark.sql("SELECT norm_cdf(0.0D) v").first()["v"] == pytest.approx(0.5)
    assert spark.sql("SELECT auroc_variance(0.5D, 10D, 90D) v").first()["v"] == pytest.approx(0.0093518, abs=1e-6)


def test_random_effects_pinned(spark):
    thetas = [-0.8398398196469706, -0.8383409142708652, -0.7536480358971068, -0.4555700611362833]
    cis = [
        (-1.4152943658295376, -0.26438527346440366), (-1.3821310250431047, -0.2945508034986257),
        (-1.2491893507975507, -0.25810672099666304), (-0.7381358288068831, -0.17300429346568347),
    ]
    fits = spark.createDataFrame([(f"m{i}", t, lo, hi, 6) for i, (t, (lo, hi)) in enumerate(zip(thetas, cis))], "model string, slope double, ci_lo double, ci_hi double, n_points long")
    out = N.pool_route(fits).first()
    assert out["theta_re"] == pytest.approx(-0.6747, abs=1e-3)
    assert (out["ci_lo"], out["ci_hi"]) == (pytest.approx(-0.8933, abs=1e-3), pytest.approx(-0.4561, abs=1e-3))
    assert out["q_statistic"] == pytest.approx(5.5346, abs=1e-3)
    assert out["i_squared"] == pytest.approx(45.8, abs=0.1)
    assert (out["kh_lo"], out["kh_hi"]) == (pytest.approx(-1.0296, abs=1e-3), pytest.approx(-0.3198, abs=1e-3))
    assert out["kh_covers"] and out["normal_covers"]


def test_equivalence_pinned(spark):
    values = [
        -0.0534, 0.0309, -0.236, 0.0095, 0.0049, -0.011, -0.0231, -0.1586, 0.118, 0.0146, 0.0123, 0.2682, 0.0025, 0.0769,
        0.0169, 0.0799, -0.1686, 0.0177,
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = N.equivalence_test(df, value="v", margin=0.10).first()
    assert out["n"] == 18 and min(out["z_lower"], out["z_upper"]) == pytest.approx(3.79, abs=0.01)
    assert out["p_value"] == pytest.approx(0.00008, abs=1e-5)
    assert out["ci_lo"] == pytest.approx(-0.0516, abs=1e-3) and out["ci_hi"] == pytest.approx(0.0518, abs=1e-3)
    assert out["equivalent_05"]
    with pytest.raises(ValueError):
        N.equivalence_test(df, value="v", margin=0)
    with pytest.raises(Exception):
        N.equivalence_test(df.limit(1), value="v", margin=0.1).collect()


def test_fdr_matches_definition(spark):
    rng = random.Random(1)
    p = [rng.choice([rng.random(), 0.01, 0.0, 1.0, rng.random() ** 6]) for _ in range(400)]
    df = spark.createDataFrame([(i, "f" if i % 3 else "g", v) for i, v in enumerate(p)] + [(999, "f", None)], "id int, fam string, p double")
    out = {r["id"]: r for r in N.adjust_fdr(df, family=["fam"]).collect()}
    for fam in "fg":
        ids = [i for i in range(400) if ("f" if i % 3 else "g") == fam]
        order = sorted(ids, key=lambda i: p[i])
        running, expected = 1.0, {}
        for rank in range(len(order), 0, -1):
            running = min(running, p[order[rank - 1]] * len(order) / rank)
            expected[order[rank - 1]] = running
        for i in ids:
            assert out[i]["p_adjusted"] == pytest.approx(expected[i], abs=1e-12)
    assert out[999]["p_adjusted"] is None and out[999]["significant"] is False


def irls(x, y, clusters):
    design = np.column_stack([np.ones(len(x)), np.log(x)])
    beta = np.zeros(2)
    for _ in range(100):
        mu = 1 / (1 + np.exp(-design @ beta))
        info = design.T @ (design * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (y - mu))
    scores = design * (y - mu)[:, None]
    meat = sum(np.outer(s, s) for s in (scores[clusters == g].sum(0) for g in np.unique(clusters)))
    return beta, np.linalg.inv(info), meat


def sweep_data(seed, slope=0.6, n=560, n_clusters=70):
    rng = np.random.default_rng(seed)
    x = rng.choice([10, 20, 50, 100, 150, 200, 300], n).astype(float)
    cluster = rng.integers(0, n_clusters, n)
    shift = rng.normal(0, 0.5, n_clusters)[cluster]
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1.5 + slope * np.log(x) + shift)))).astype(float)
    y[rng.random(n) < 0.1] = 0.5
    return x, y, cluster


def test_logistic_fit_with_clustered_errors(spark):
    x, y, c = sweep_data(0)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for a, b, k in zip(x, y, c)], "x double, y double, cluster int")
    out = N.fit_verified_rate(df, draws=60).first()
    beta, bread, meat = irls(x, y, c)
    g, n = len(np.unique(c)), len(x)
    cov = bread @ meat @ bread * g / (g - 1) * (n - 1) / (n - 2)
    assert out["slope"] == pytest.approx(beta[1], abs=1e-8) and out["intercept"] == pytest.approx(beta[0], abs=1e-8)
    assert out["slope_se"] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-6)
    assert out["slope_lo"] > 0 and out["slope_p"] < 0.05
    assert out["n_bootstrap"] == 60 and out["bootstrap_lo"] < beta[1] < out["bootstrap_hi"]
    few = df.where("cluster < 8")
    assert N.fit_verified_rate(few, draws=60).first()["n_bootstrap"] == 0


def test_pooled_interaction_equals_joint_fit(spark):
    parts = {"a": sweep_data(1, 0.2), "b": sweep_data(2, 0.9), "c": sweep_data(3, 0.5)}
    rows = [(m, float(x), float(y), int(k)) for m, d in parts.items() for x, y, k in zip(*d)]
    df = spark.createDataFrame(rows, "model string, x double, y double, cluster int")
    slopes, summary = N.fit_pooled_interaction(df, draws=40, model_sizes={"a": 1e6, "b": 1e7, "c": 1e8})
    got = {r["model"]: r for r in slopes.collect()}
    # joint design: intercept, log x, dummies, interactions
    model = np.array([r[0] for r in rows])
    lx, y = np.log([r[1] for r in rows]), np.array([r[2] for r in rows])
    dummies = [(model == m).astype(float) for m in "bc"]
    design = np.column_stack([np.ones(len(y)), lx, *dummies, *[d * lx for d in dummies]])
    beta = np.zeros(6)
    for _ in range(60):
        mu = 1 / (1 + np.exp(-design @ beta))
        info = design.T @ (design * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (y - mu))
    keys = np.array([f"{r[0]}:{r[3]}" for r in rows])
    scores = design * (y - mu)[:, None]
    meat = sum(np.outer(s, s) for s in (scores[keys == g].sum(0) for g in np.unique(keys)))
    g, n = len(np.unique(keys)), len(y)
    bread = np.linalg.inv(info)
    cov = bread @ meat @ bread * g / (g - 1) * (n - 1) / (n - 6)
    for name, contrast in (("a", [0, 1, 0, 0, 0, 0]), ("b", [0, 1, 0, 0, 1, 0]), ("c", [0, 1, 0, 0, 0, 1])):
        r = np.array(contrast, float)
        assert got[name]["slope"] == pytest.approx(r @ beta, abs=1e-7)
        assert got[name]["slope_se"] == pytest.approx(math.sqrt(r @ cov @ r), rel=1e-6)
    pick = np.zeros((2, 6))
    pick[0, 4] = pick[1, 5] = 1
    wald = (pick @ beta) @ np.linalg.solve(pick @ cov @ pick.T, pick @ beta)
    s = summary.first()
    assert s["wald"] == pytest.approx(wald, rel=1e-6) and s["n_bootstrap"] == 40
    assert s["trend_lo"] <= s["trend_hi"] and s["trend_p"] >= 1 / 40
    with pytest.raises(ValueError):
        N.fit_pooled_interaction(df.where("model = 'a'"))


def test_cluster_bootstrap_widens_the_interval(spark):
    rng = np.random.default_rng(4)
    level = np.repeat(rng.normal(0, 1, 40), 25)
    rows = [("m", i // 25, i, float(v + e)) for i, (v, e) in enumerate(zip(level, rng.normal(0, 0.2, 1000)))]
    df = spark.createDataFrame(rows, "model string, cluster_id int, row_id int, v double")
    clustered = N.bootstrap_mean(df, keys=["model"], value="v", cluster="cluster_id", draws=200).first()
    plain = N.bootstrap_mean(df, keys=["model"], value="v", cluster="row_id", draws=200).first()
    assert clustered["mean"] == pytest.approx(np.mean([r[3] for r in rows]))
    assert clustered["n_clusters"] == 40 and clustered["n_rows"] == 1000
    assert (clustered["ci_hi"] - clustered["ci_lo"]) > 2 * (plain["ci_hi"] - plain["ci_lo"])
    assert not clustered["few_clusters"]


def test_max_inflation_against_simulation(spark):
    rng = np.random.default_rng(0)
    d, sigma = 500, 0.09
    simulated = np.mean([np.max(np.abs(rng.normal(0, sigma, d))) for _ in range(2000)])
    row = spark.range(1).select(
        ST.expected_max_inflation(F.lit(sigma), F.lit(d)).alias("v"), ST.auroc_variance(F.lit(0.5), F.lit(10), F.lit(90)).alias("var")
    ).first()
    assert row["v"] / simulated == pytest.approx(1.0, abs=0.03)
    draws = [np.mean(p[:, None] > q[None, :]) for p, q in ((rng.random(10), rng.random(90)) for _ in range(4000))]
    assert row["var"] == pytest.approx(np.var(draws), rel=0.1)


def test_sweep_join_and_unknown_match(spark):
    sweep = spark.createDataFrame([(20, "GO:A", 5), (100, "GO:B", 7), (100, "GO:C", 5), (50, "GO:D", 8)], "min_positives int, concept_id string, best_feature_idx int")
    registry = spark.createDataFrame(
        [(5, "confirmed", ["GO:A"]), (7, "spurious", ["GO:B"]), (8, "unverifiable", ["GO:D"])], "feature_idx int, status string, claimed array<string>"
    )
    out = sorted((r["min_positives"], r["target"], r["feature_idx"]) for r in R.sweep_rows(sweep, registry).collect())
    assert out == [(20, 1.0, 5), (100, 0.0, 7)]
    with pytest.raises(Exception, match="GO:D"):
        R.require_matched(sweep, spark.createDataFrame([("GO:A",), ("GO:B",), ("GO:C",)], "concept_id string"), ["concept_id"], "concept").collect()


def test_legacy_text_without_numbers_is_an_error(spark):
    df = spark.createDataFrame([(True, "no numbers", None)], "acme_reportable boolean, mediation_text string, baseline_text string")
    with pytest.raises(Exception, match="no effect"):
        N.parse_stored_effects(df).collect()


def test_theory_slope_and_power(spark):
    n = [10, 20, 50, 100, 200]
    rows = [("m", x, 0.8 * x**-0.5, None) for x in n] + [("m", 300, 0.8 * 10**-0.5, 10)]
    points = spark.createDataFrame(rows, "model string, min_positives int, mean double, duplicate_of int")
    per_model, pooled = N.log_log_fits(points)
    fit = per_model.first()
    assert fit["slope"] == pytest.approx(-0.5) and fit["n_points"] == 5 and fit["r_squared"] == pytest.approx(1.0)
    columns = N.power_columns(F.lit(0.02), F.lit(0.08), F.lit(251.0))
    out = spark.range(1).select(*[c.alias(k) for k, c in columns.items()], N.inflation_ratio(F.lit(1280), F.lit(5120)).alias("r")).first()
    assert out["required_clusters"] == pytest.approx(251.16, abs=0.1) and out["power"] == pytest.approx(0.8, abs=0.01)
    assert 1.05 < out["r"] < 1.15


def test_newton_in_rows_and_in_tables_agree(spark, monkeypatch):
    """Groups of few and many x, a singular one, one still moving at the end, an empty table."""
    rng = np.random.default_rng(12)
    rows = [("few", float(x), float(y)) for x, y in zip(rng.integers(1, 9, 80), rng.random(80), strict=True)]
    rows += [("many", float(x), float(y)) for x, y in zip(rng.random(60) * 50 + 1, rng.integers(0, 2, 60), strict=True)]
    rows += [("flat", 2.0, 1.0), ("flat", 2.0, 0.0), ("parted", 1.0, 0.0), ("parted", 2.0, 0.0), ("parted", 3.0, 1.0), ("parted", 4.0, 1.0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, x double, y double, w int")
    fits = []
    for most in (4096, 20, 0):
        monkeypatch.setattr(N, "CELLS_IN_A_ROW", most)
        fits.append({r.g: r for r in N.grouped_logit(N.collapse(df, ["g"]), ["g"], max_iter=12).collect()})
    for other in fits[1:]:
        for g, r in fits[0].items():
            assert r.converged == other[g].converged
            np.testing.assert_allclose([r.b0, r.b1, r.i11], [other[g].b0, other[g].b1, other[g].i11], rtol=1e-8, equal_nan=True)
    assert {g: r.converged for g, r in fits[0].items()} == {"few": True, "many": True, "flat": False, "parted": False}
    assert N.grouped_logit(N.collapse(df.limit(0), ["g"]), ["g"]).count() == 0
    assert N.grouped_logit(N.collapse(df.where("g = 'few'"), []), []).first().b1 == pytest.approx(fits[0]["few"].b1)


def test_missing_intervals_have_a_reason(spark):
    rows = [(float(1 + i % 4), float(i % 2), i % 6) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, cluster int")
    told = N.fit_verified_rate(df, draws=20).first()
    assert told.converged and told.bootstrap_lo is None and told.bootstrap_reason == "fewer than ten clusters"
    assert N.fit_verified_rate(df, draws=0).first().bootstrap_reason == "not asked for"


def test_draws_in_rows_and_joined_draws_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [("ab"[i % 2], int(rng.integers(0, 15)) if i % 3 else 99, float(rng.normal()), float(rng.integers(1, 5)), float(i % 5 < 2)) for i in range(400)]
    rows = spark.createDataFrame(data, "model string, cluster int, v double, x double, y double").repartition(3)

    def both():
        means = N.bootstrap_mean(rows, keys=["model"], value="v", cluster="cluster", draws=40).orderBy("model").collect()
        whole = N.bootstrap_mean(rows, keys=[], value="v", cluster="cluster", draws=40).collect()
        slopes = N._resampled_slopes(rows, keys=["model"], draws=20, seed="1").orderBy("model", "b").collect()
        return [*means, *whole], slopes

    in_rows = both()
    monkeypatch.setattr(N, "DRAWN_IN_ROW", 0)
    joined = both()
    for got, want in zip(in_rows, joined):
        assert len(got) == len(want) > 0
        for g, w in zip(got, want):
            assert g.asDict() == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in w.asDict().items()}


def test_replicates_are_summed_before_they_are_shuffled(spark):
    clusters = spark.range(500).selectExpr("'m' AS model", "CAST(id AS INT) AS cluster_no", "id AS k", "CAST(id AS DOUBLE) AS _s", "1L AS _n")
    means = N._drawn_means(clusters.withColumn("k", F.lit(500)), keys=["model"], draws=300, seed="1").groupBy("model").agg(F.count("_mean"))
    means.collect()
    plan = means._jdf.queryExecution().executedPlan()
    written = 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.metrics().contains("shuffleRecordsWritten"):
            written += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < written < 2000  # 500 clusters, 64 slices and sums; not 500 x 300 draws


def test_unusable_fits_keep_a_row_with_a_reason(spark):
    rows = [("full", 10 * 2**i, 0.5 / 2**i, None) for i in range(4)] + [("short", 10, 0.2, None), ("short", 20, 0.1, None)]
    rows += [("negative", 10 * i, -0.1, None) for i in (1, 2, 3)] + [("flat", 10, 0.1 * i, None) for i in (1, 2, 3)]
    points = spark.createDataFrame(rows, "model string, min_positives int, mean double, duplicate_of int")
    fits, pooled = N.log_log_fits(points)
    got = {r["model"]: (r["n_points"], r["reason"], r["slope"] is None) for r in fits.collect()}
    assert got == {
        "full": (4, None, False), "short": (2, "fewer than 3 points", True),
        "negative": (0, "fewer than 3 points", True), "flat": (3, "x does not vary", True),
    }
    assert pooled.first()["reason"] is None
    notes = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "concept_id int, unit_id int, evidence string")
    told = N.evidence_depth(notes, experimental=["A"]).first()
    assert (told["n_points"], told["reason"], told["slope"], told["mean_share"]) == (1, "fewer than 10 terms", None, 0.5)
