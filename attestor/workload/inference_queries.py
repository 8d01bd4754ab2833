"""Bootstrap, curve, meta-analysis and multiplicity queries on sweep rows from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import stats as ST
from attestor.functions import tails
from attestor.operators import inference as N
from attestor.operators import registry as R
from attestor.session import materialize
from attestor.workload.catalog import query, r6, table
from attestor.workload.sweep_tables import (
    CLAIMED,
    DUPLICATED,
    REGISTRY,
    SWEEP,
    claimed_registry,
    sweep,
    with_duplicate_point,
)

DRAWS = 200


def boot_sql(source: str, keys: list[str], value: str, draws: int = DRAWS) -> str:
    """SQL twin of the cluster bootstrap over ``source(keys, best_feature_idx, value)``."""
    k = ", ".join(keys)
    on = " AND ".join(f"d.{x} = c.{x}" for x in keys)
    return f"""
    cl AS (SELECT {k}, best_feature_idx AS cluster, sum({value}) AS s, count(*) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
    num AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY cluster) - 1 AS no, count(*) OVER (PARTITION BY {k}) AS kk FROM cl),
    dr AS (SELECT {k}, b, ('0x' || substr(md5('42:' || b || ':' || no), 1, 8))::BIGINT % kk AS no FROM num, (SELECT unnest(range(0, {draws})) AS b)),
    bm AS (SELECT {", ".join("d." + x for x in keys)}, d.b, sum(s) / sum(n) AS m FROM dr d JOIN num c ON {on} AND d.no = c.no GROUP BY ALL),
    ci AS (SELECT {k}, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM bm GROUP BY {k}),
    pt AS (SELECT {k}, sum(s) / sum(n) AS mean, sum(n)::BIGINT AS n_rows, count(*) AS n_clusters FROM num GROUP BY {k}),
    boot AS (SELECT * FROM pt JOIN ci USING ({k}))"""


BOOT_COLUMNS = "round(mean, 6) + 0.0 AS mean, round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi, n_rows, n_clusters"


def _boot(df, *keys):
    return df.select(*keys, *[r6(F.col(c), c) for c in ("mean", "ci_lo", "ci_hi")], "n_rows", "n_clusters")


@query("d25_cluster_bootstrap_mean", "WITH " + SWEEP + "," + boot_sql("sweep", ["model"], "auroc_inflation") + f" SELECT model, {BOOT_COLUMNS} FROM boot")
def d25(spark, sf):
    out = N.bootstrap_mean(
        sweep(spark, sf), keys=["model"], value="auroc_inflation", cluster="best_feature_idx", draws=DRAWS
    )
    return _boot(out, "model")


@query(
    "d42_hard_negative_gap",
    "WITH " + SWEEP + ", gaps AS (SELECT *, held_out_auroc - hard_negative_held_out_auroc AS gap FROM sweep),"
    + boot_sql("gaps", ["model", "min_positives"], "gap", 50)
    + f" SELECT model, min_positives, {BOOT_COLUMNS} FROM boot",
)
def d42(spark, sf):
    return _boot(N.hard_negative_gap(sweep(spark, sf), draws=50), "model", "min_positives")


@query(
    "d43_interval_backfill",
    "WITH " + SWEEP + "," + boot_sql("sweep", ["model", "min_positives"], "auroc_inflation", 50)
    + f""" SELECT model, min_positives, {BOOT_COLUMNS}, min_positives = 50 AS drifted FROM boot""",
)
def d43(spark, sf):
    rows = sweep(spark, sf)
    stored = rows.groupBy("model", "min_positives").agg(F.avg("auroc_inflation").alias("stored_mean")).withColumn(
        "stored_mean", F.col("stored_mean") + F.when(F.col("min_positives") == 50, 0.001).otherwise(0.0)
    )
    out = N.backfill_intervals(rows, stored, draws=50)
    return _boot(out.withColumn("drifted", F.col("drifted")), "model", "min_positives", "drifted")


ARMS = (
    "WITH " + SWEEP + "," + boot_sql("sweep", ["model", "min_positives"], "auroc_inflation", 50)
    + ", arms AS (SELECT model AS arm, min_positives, mean, ci_lo, ci_hi FROM boot)"
)


def _arms(spark, sf):
    out = N.bootstrap_mean(
        sweep(spark, sf), keys=["model", "min_positives"], value="auroc_inflation", cluster="best_feature_idx", draws=50
    )
    return out.withColumnRenamed("model", "arm")


@query("d44_arm_table", ARMS + " SELECT arm, min_positives, round(mean, 6) + 0.0 AS mean, round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi FROM arms")
def d44(spark, sf):
    return _arms(spark, sf).select("arm", "min_positives", *[r6(F.col(c), c) for c in ("mean", "ci_lo", "ci_hi")])


@query(
    "c20_arm_comparison",
    ARMS + """ SELECT b.arm AS other, min_positives, NOT (a.ci_hi < b.ci_lo OR b.ci_hi < a.ci_lo) AS ci_overlap, b.mean > a.mean AS b_higher
    FROM arms a JOIN arms b USING (min_positives) WHERE a.arm = 'A' AND b.arm <> 'A'""",
)
def c20(spark, sf):
    arms = materialize(_arms(spark, sf))
    told = [R.compare_arms(arms, "A", m).select(F.lit(m).alias("other"), "min_positives", "ci_overlap", "b_higher") for m in ("N", "R")]
    return told[0].unionByName(told[1])


@query(
    "d39_duplicate_points",
    "WITH " + SWEEP + "," + DUPLICATED + """, s AS (SELECT model, min_positives, md5(string_agg(DISTINCT best_feature_idx || '|' || concept_id || '|' || auroc_inflation, ';'
       ORDER BY best_feature_idx || '|' || concept_id || '|' || auroc_inflation)) AS fp FROM dup WHERE auroc_inflation IS NOT NULL GROUP BY ALL)
    SELECT model, min_positives, CASE WHEN min(min_positives) OVER w < min_positives THEN min(min_positives) OVER w END AS duplicate_of
    FROM s WINDOW w AS (PARTITION BY model, fp)""",
)
def d39(spark, sf):
    return R.fingerprint_points(with_duplicate_point(sweep(spark, sf)))


CURVE = """
means AS (SELECT model, min_positives, avg(auroc_inflation) AS mean FROM {source} WHERE auroc_inflation IS NOT NULL GROUP BY ALL),
us AS (SELECT model, ln(min_positives::DOUBLE) AS x, ln(mean) AS y FROM means WHERE min_positives <> 20 AND mean > 0),
f0 AS (SELECT model, count(*) AS n_points, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared,
  regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM us GROUP BY model),
f1 AS (SELECT 'pooled' AS model, count(*) AS n_points, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared,
  regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM us),
fu AS (SELECT *, sqrt(syy * (1 - r_squared) / (n_points - 2) / sxx) AS se,
         CASE n_points WHEN 6 THEN 2.776445105197793 WHEN 18 THEN 2.119905299221012 END::DOUBLE AS t FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1)),
fits AS (SELECT *, slope - t * se AS ci_lo, slope + t * se AS ci_hi FROM fu)
"""
FIT_COLUMNS = """model, n_points, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r_squared, 6) + 0.0 AS r_squared,
  round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi, (ci_lo <= -0.5 AND ci_hi >= -0.5) AS covers_theory"""


def _points(rows, value="auroc_inflation"):
    marks = R.fingerprint_points(rows.withColumn("auroc_inflation", F.col(value)))
    means = rows.where(F.col(value).isNotNull()).groupBy("model", "min_positives").agg(F.avg(value).alias("mean"))
    return means.join(marks, ["model", "min_positives"], "left")


def _fits(points):
    per_model, pooled = N.log_log_fits(points)
    return per_model.unionByName(pooled.withColumn("model", F.lit("pooled")))


def _fit_columns(df):
    return df.select(
        "model", "n_points", *[r6(F.col(c), c) for c in ("slope", "intercept", "r_squared", "ci_lo", "ci_hi")], "covers_theory"
    )


@query("d38_log_log_curve", "WITH " + SWEEP + "," + DUPLICATED + "," + CURVE.format(source="dup") + " SELECT " + FIT_COLUMNS + " FROM fits")
def d38(spark, sf):
    return _fit_columns(_fits(_points(with_duplicate_point(sweep(spark, sf)))))


LEVERAGE = """kept AS (SELECT dup.* FROM dup LEFT JOIN (SELECT p_partkey AS concept_id FROM part WHERE p_size > 40) x USING (concept_id)
  WHERE x.concept_id IS NULL)"""


@query("d40_leverage_filter", "WITH " + SWEEP + "," + DUPLICATED + "," + LEVERAGE + "," + CURVE.format(source="kept") + " SELECT " + FIT_COLUMNS + " FROM fits")
def d40(spark, sf):
    excluded = table(spark, sf, "part").where(F.col("p_size") > 40).select(F.col("p_partkey").alias("concept_id"))
    return _fit_columns(_fits(_points(N.exclude_concepts(with_duplicate_point(sweep(spark, sf)), excluded))))


PERMUTED = """perm AS (SELECT dup.* REPLACE (auroc_inflation * p_retailprice / 1000 AS auroc_inflation) FROM dup JOIN part ON concept_id = p_partkey)"""


def _permuted(spark, sf):
    """Decomposition rows joined to probe rows; a concept without a match is an error."""
    null = table(spark, sf, "part").select(F.col("p_partkey").alias("concept_id"), (F.col("p_retailprice") / 1000).alias("_f"))
    rows = R.require_matched(with_duplicate_point(sweep(spark, sf)), null, ["concept_id"], "concept")
    return rows.withColumn("permuted_inflation", F.col("auroc_inflation") * F.col("_f"))


@query("d41_permuted_curve", "WITH " + SWEEP + "," + DUPLICATED + "," + PERMUTED + "," + CURVE.format(source="perm") + " SELECT " + FIT_COLUMNS + " FROM fits")
def d41(spark, sf):
    return _fit_columns(_fits(_points(_permuted(spark, sf), "permuted_inflation")))


@query(
    "c11_matched_inflation",
    "WITH " + SWEEP + "," + DUPLICATED + "," + PERMUTED + " SELECT model, min_positives, count(*) AS n, round(avg(auroc_inflation), 6) AS mean FROM perm GROUP BY ALL",
)
def c11(spark, sf):
    return _permuted(spark, sf).groupBy("model", "min_positives").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("permuted_inflation"), "mean")
    )


META = """
w1 AS (SELECT {k} count(*) AS k, sum(1 / (se * se)) AS sw, sum(1 / (se * se * se * se)) AS sww, sum(theta / (se * se)) / sum(1 / (se * se)) AS tf FROM studies {g}),
w2 AS (SELECT {k} first(k) AS k, first(sw) AS sw, first(sww) AS sww, first(tf) AS tf, sum((theta - tf) * (theta - tf) / (se * se)) AS q FROM studies JOIN w1 {j} {g}),
w3 AS (SELECT *, CASE WHEN sw - sww / sw > 0 THEN greatest(0, (q - (k - 1)) / (sw - sww / sw)) ELSE 0 END AS tau2 FROM w2),
w4 AS (SELECT {k} first(k) AS k, first(tf) AS tf, first(q) AS q, first(tau2) AS tau2, sum(theta / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS re,
   sqrt(1 / sum(1 / (se * se + tau2))) AS se_re, sum(1 / (se * se + tau2)) AS c FROM studies JOIN w3 {j} {g}),
w5 AS (SELECT {k} first(w4.k) AS kk, first(tf) AS tf, first(q) AS q, first(tau2) AS tau2, first(re) AS re, first(se_re) AS se_re,
   first(se_re) * sqrt(greatest(1, sum((theta - re) * (theta - re) / (se * se + tau2)) / (first(w4.k) - 1))) AS se_kh FROM studies JOIN w4 {j} {g})
SELECT {k} kk AS k, round(re, 6) + 0.0 AS theta_re, round(se_re, 6) AS se_re, round(re - 1.959963984540054::DOUBLE * se_re, 6) + 0.0 AS ci_lo,
  round(re + 1.959963984540054::DOUBLE * se_re, 6) + 0.0 AS ci_hi, round(se_kh, 6) AS se_kh, round(re - 4.302652729696142::DOUBLE * se_kh, 6) + 0.0 AS kh_lo,
  round(re + 4.302652729696142::DOUBLE * se_kh, 6) + 0.0 AS kh_hi, round(tau2, 6) AS tau_squared, round(q, 5) AS q_statistic,
  round(CASE WHEN q > 0 THEN greatest(0, (q - (kk - 1)) / q * 100) ELSE 0 END, 5) AS i_squared FROM w5
"""


def _meta_columns(df, *keys):
    six = ("theta_re", "se_re", "ci_lo", "ci_hi", "se_kh", "kh_lo", "kh_hi", "tau_squared")
    return df.select(
        *keys, "k", *[r6(F.col(c), c) for c in six], *[F.round(c, 5).alias(c) for c in ("q_statistic", "i_squared")]
    )


@query(
    "d30_random_effects",
    "WITH studies AS (SELECT l_linestatus AS route, l_returnflag AS model, avg(l_quantity) AS theta, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL), "
    + META.format(k="route,", g="GROUP BY route", j="USING (route)"),
)
def d30(spark, sf):
    studies = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("route"), "l_returnflag").agg(
        F.avg("l_quantity").alias("theta"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    return _meta_columns(N.random_effects(studies, keys=["route"]), "route")


@query(
    "d58_pooled_route",
    "WITH " + SWEEP + "," + DUPLICATED + "," + CURVE.format(source="dup") + ", studies AS (SELECT slope AS theta, se FROM fits WHERE model <> 'pooled'), "
    + META.format(k="", g="", j="ON true"),
)
def d58(spark, sf):
    per_model, _ = N.log_log_fits(_points(with_duplicate_point(sweep(spark, sf))))
    return _meta_columns(N.pool_route(per_model))


@query(
    "b18_se_from_interval",
    "WITH " + SWEEP + "," + DUPLICATED + "," + CURVE.format(source="dup") + " SELECT model, round(se, 6) AS se FROM fits",
)
def b18(spark, sf):
    fits = _fits(_points(with_duplicate_point(sweep(spark, sf)))).withColumn("t", tails.t_ppf(F.lit(0.975), F.col("n_points") - 2))
    return fits.select("model", r6(ST.se_from_ci(F.col("ci_lo"), F.col("ci_hi"), F.col("t")), "se"))


@query(
    "d31_fdr_adjust",
    """WITH t AS (SELECT o_orderkey, o_orderstatus, ((o_orderkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS p FROM orders),
    k AS (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY p) + count(*) OVER (PARTITION BY o_orderstatus, p) - 1 AS r,
                 count(*) OVER (PARTITION BY o_orderstatus) AS m FROM t),
    a AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY o_orderstatus ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS adj FROM k)
    SELECT o_orderkey, o_orderstatus, round(adj, 6) AS p_adjusted, adj <= 0.05 AS significant FROM a""",
)
def d31(spark, sf):
    tests = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", (((F.col("o_orderkey") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("p")
    )
    out = N.adjust_fdr(tests, family=["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", r6(F.col("p_adjusted"), "p_adjusted"), "significant")


@query(
    "d32_equivalence",
    """WITH v AS (SELECT l_returnflag, l_discount - 0.05 AS d FROM lineitem),
    s AS (SELECT l_returnflag, count(*) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se FROM v GROUP BY 1)
    SELECT l_returnflag, n, round(m, 6) + 0.0 AS mean, round(se, 6) AS se, round((m + 0.01) / se, 4) AS z_lower, round((0.01 - m) / se, 4) AS z_upper,
      round(m - 1.959963984540054::DOUBLE * se, 6) + 0.0 AS ci_lo, round(m + 1.959963984540054::DOUBLE * se, 6) + 0.0 AS ci_hi FROM s""",
)
def d32(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("d", F.col("l_discount") - 0.05)
    out = N.equivalence_test(rows, value="d", margin=0.01, keys=["l_returnflag"])
    return out.select(
        "l_returnflag", "n", *[r6(F.col(c), c) for c in ("mean", "se", "ci_lo", "ci_hi")],
        *[F.round(c, 4).alias(c) for c in ("z_lower", "z_upper")],
    )


def _verified_rows(spark, sf, keys):
    rows = sweep(spark, sf)
    reg = claimed_registry(spark, sf)
    if keys:
        reg = reg.withColumn("model", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    return R.sweep_rows(rows, reg, keys=keys)


VERIFIED = (
    "WITH " + SWEEP + "," + REGISTRY + "," + CLAIMED
    + """, vr AS (SELECT model, min_positives, s.concept_id, best_feature_idx AS feature_idx,
        CASE status WHEN 'confirmed' THEN 1.0 WHEN 'plausible' THEN 0.5 WHEN 'spurious' THEN 0.0 END::DOUBLE AS target
      FROM sweep s JOIN registry r ON r.feature_idx = best_feature_idx JOIN claimed c ON c.feature_idx = best_feature_idx AND c.concept_id = s.concept_id
      WHERE status IN ('confirmed', 'plausible', 'spurious'))"""
)


@query("c9_sweep_rows", VERIFIED + " SELECT min_positives, concept_id, feature_idx, target FROM vr")
def c9(spark, sf):
    return _verified_rows(spark, sf, []).select("min_positives", "concept_id", "feature_idx", "target")


@query("c10_pooled_sweep_rows", VERIFIED + " SELECT model, min_positives, concept_id, feature_idx, target FROM vr")
def c10(spark, sf):
    return _verified_rows(spark, sf, ["model"])


@query("b13_status_target", VERIFIED + " SELECT target, count(*) AS n FROM vr GROUP BY target")
def b13(spark, sf):
    return _verified_rows(spark, sf, []).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _fit_input(spark, sf, *keys):
    rows = _verified_rows(spark, sf, ["model"])
    return rows.select(*keys, F.col("min_positives").alias("x"), F.col("target").alias("y"), F.col("feature_idx").alias("cluster"))


def newton_sql(source: str, keys: list[str], steps: int = 9) -> str:
    """Unrolled Newton steps of ``y ~ 1 + ln(x)`` per group; ``source`` has (keys, x, y, w)."""
    k = "".join(f"{c}, " for c in keys)
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    out = [f"suf AS (SELECT {k} ln(x::DOUBLE) AS lx, sum(w) AS n, sum(w * y) AS sy FROM {source} GROUP BY {k} x)"]
    out.append(f"nb0 AS (SELECT {k} 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM suf {group or 'LIMIT 1'})")
    for i in range(steps):
        out.append(
            f"""nt{i} AS (SELECT {k} first(b0) AS b0, first(b1) AS b1, sum(n * mu * (1 - mu)) AS s0, sum(n * mu * (1 - mu) * lx) AS s1,
              sum(n * mu * (1 - mu) * lx * lx) AS s2, sum(sy - n * mu) AS r0, sum((sy - n * mu) * lx) AS r1
              FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * lx))) AS mu FROM suf JOIN nb{i} {on}) {group}),
            nb{i + 1} AS (SELECT {k} b0 + (s2 * r0 - s1 * r1) / (s0 * s2 - s1 * s1) AS b0, b1 + (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) AS b1 FROM nt{i})"""
        )
    out.append(f"fit AS (SELECT * FROM nb{steps})")
    return ", ".join(out)


FIT_ROWS = VERIFIED + ", fr AS (SELECT model, min_positives AS x, target AS y, feature_idx AS cluster, 1 AS w FROM vr)"


def sandwich_sql(keys: list[str], n_params: str) -> str:
    k = "".join(f"{c}, " for c in keys)
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
    rr AS (SELECT fr.*, ln(x::DOUBLE) AS lx, 1 / (1 + exp(-(b0 + b1 * ln(x::DOUBLE)))) AS mu FROM fr JOIN fit {on}),
    inf AS (SELECT {k} sum(mu * (1 - mu)) AS s0, sum(mu * (1 - mu) * lx) AS s1, sum(mu * (1 - mu) * lx * lx) AS s2 FROM rr {group}),
    sco AS (SELECT {k} cluster, sum(y - mu) AS u0, sum((y - mu) * lx) AS u1, count(*) AS n FROM rr GROUP BY {k} cluster),
    mt AS (SELECT {k} sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11, count(*) AS g, sum(n) AS n FROM sco {group}),
    fac AS (SELECT sum(g) / (sum(g) - 1.0::DOUBLE) * (sum(n) - 1) / (sum(n) - {n_params}) AS f FROM mt),
    vv AS (SELECT {k} g, n, f * (s1 * s1 * m00 - 2 * s0 * s1 * m01 + s0 * s0 * m11) / ((s0 * s2 - s1 * s1) * (s0 * s2 - s1 * s1)) AS var1 FROM inf JOIN mt {on}, fac)"""


@query(
    "d26_logistic_cluster_fit",
    FIT_ROWS + "," + newton_sql("fr", []) + "," + sandwich_sql([], "2") + """ SELECT round(b0, 5) + 0.0 AS intercept, round(b1, 5) + 0.0 AS slope, round(sqrt(var1), 5) AS slope_se,
    round(b1 - 1.959963984540054::DOUBLE * sqrt(var1), 5) + 0.0 AS slope_lo, round(b1 + 1.959963984540054::DOUBLE * sqrt(var1), 5) + 0.0 AS slope_hi, n::BIGINT AS n_rows, g AS n_clusters FROM fit, vv""",
)
def d26(spark, sf):
    out = N.fit_verified_rate(_fit_input(spark, sf), draws=0)
    return out.select(*[(F.round(c, 5) + 0.0).alias(c) for c in ("intercept", "slope", "slope_se", "slope_lo", "slope_hi")], "n_rows", "n_clusters")


BOOT_FITS = """
cw AS (SELECT {k} cluster, x, y, count(*) AS w FROM fr GROUP BY ALL),
ids AS (SELECT DISTINCT {k} cluster FROM fr),
num AS (SELECT *, row_number() OVER ({p} ORDER BY cluster) - 1 AS no, count(*) OVER ({p}) AS kk FROM ids),
dr AS (SELECT {k} b, ('0x' || substr(md5('42:' || b || ':' || no), 1, 8))::BIGINT % kk AS no FROM num, (SELECT unnest(range(0, {draws})) AS b)),
tm AS (SELECT {k} b, no, count(*) AS times FROM dr GROUP BY ALL),
bs AS (SELECT {k2} b, x, y, cw.w * times AS w FROM tm JOIN num USING ({k} no) JOIN cw USING ({k} cluster))
"""


@query(
    "d27_logistic_bootstrap",
    FIT_ROWS + "," + BOOT_FITS.format(k="", k2="", p="", draws=100) + "," + newton_sql("bs", ["b"])
    + " SELECT round(quantile_cont(b1, 0.025), 5) + 0.0 AS bootstrap_lo, round(quantile_cont(b1, 0.975), 5) + 0.0 AS bootstrap_hi, count(*)::INT AS n_bootstrap FROM fit",
)
def d27(spark, sf):
    out = N.fit_verified_rate(_fit_input(spark, sf), draws=100)
    return out.select(*[(F.round(c, 5) + 0.0).alias(c) for c in ("bootstrap_lo", "bootstrap_hi")], "n_bootstrap")


@query(
    "d28_pooled_interaction",
    FIT_ROWS + "," + newton_sql("fr", ["model"]) + "," + sandwich_sql(["model"], "2 * count(*)") + """ SELECT model, round(b1, 5) + 0.0 AS slope, round(sqrt(var1), 5) AS slope_se,
    round(b1 - 1.959963984540054::DOUBLE * sqrt(var1), 5) + 0.0 AS slope_lo, round(b1 + 1.959963984540054::DOUBLE * sqrt(var1), 5) + 0.0 AS slope_hi, g AS n_clusters FROM fit JOIN vv USING (model)""",
)
def d28(spark, sf):
    slopes, _ = N.fit_pooled_interaction(_fit_input(spark, sf, "model"), draws=0)
    return slopes.select("model", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "slope_se", "slope_lo", "slope_hi")], "n_clusters")


@query(
    "d29_pooled_bootstrap",
    FIT_ROWS + "," + BOOT_FITS.format(k="model, ", k2="model, ", p="PARTITION BY model", draws=60) + "," + newton_sql("bs", ["model", "b"])
    + " SELECT model, round(quantile_cont(b1, 0.025), 5) + 0.0 AS bootstrap_lo, round(quantile_cont(b1, 0.975), 5) + 0.0 AS bootstrap_hi FROM fit GROUP BY model",
)
def d29(spark, sf):
    slopes, _ = N.fit_pooled_interaction(_fit_input(spark, sf, "model"), draws=60)
    return slopes.select("model", *[(F.round(c, 5) + 0.0).alias(c) for c in ("bootstrap_lo", "bootstrap_hi")])


SIZES = {"A": 8e6, "N": 35e6, "R": 150e6}


@query(
    "d29_size_trend",
    FIT_ROWS + "," + newton_sql("fr", ["model"]) + "," + sandwich_sql(["model"], "2 * count(*)")
    + """, sl AS (SELECT model, b1, 1 / var1 AS w, log10(CASE model WHEN 'A' THEN 8e6 WHEN 'N' THEN 35e6 ELSE 150e6 END::DOUBLE) AS sz, n, g FROM fit JOIN vv USING (model)),
    ct AS (SELECT *, sz - sum(w * sz) OVER () / sum(w) OVER () AS cz, sum(w * b1) OVER () / sum(w) OVER () AS pb FROM sl),
    aa AS (SELECT *, w * cz / sum(w * cz * cz) OVER () AS a FROM ct), """
    + BOOT_FITS.format(k="model, ", k2="model, ", p="PARTITION BY model", draws=60)
    + "," + newton_sql("bs", ["model", "b"]).replace("suf ", "suf2 ").replace("nb", "mb").replace("nt", "mt_").replace("fit AS", "fit2 AS")
    + """, td AS (SELECT b, sum(a * fit2.b1) AS t FROM fit2 JOIN aa USING (model) GROUP BY b)
    SELECT round(sum(w * (b1 - pb) * (b1 - pb)), 4) AS wald, sum(n)::BIGINT AS n_rows, sum(g)::BIGINT AS n_clusters, round(sum(a * b1), 5) + 0.0 AS trend_slope,
      (SELECT round(quantile_cont(t, 0.025), 5) + 0.0 FROM td) AS trend_lo, (SELECT round(quantile_cont(t, 0.975), 5) + 0.0 FROM td) AS trend_hi,
      (SELECT round(least(1, greatest(2 * least(avg((t <= 0)::INT), avg((t >= 0)::INT)), 1 / count(*)::DOUBLE)), 6) FROM td) AS trend_p FROM aa""",
)
def d29_trend(spark, sf):
    out = N.fit_pooled_interaction(_fit_input(spark, sf, "model"), draws=60, model_sizes=SIZES)[1]
    five = [(F.round(c, 5) + 0.0).alias(c) for c in ("trend_slope", "trend_lo", "trend_hi")]
    return out.select(F.round("wald", 4).alias("wald"), "n_rows", "n_clusters", *five, r6(F.col("trend_p"), "trend_p"))


@query(
    "d45_point_means",
    "WITH " + SWEEP + """ SELECT min_positives, round(avg(single_feature_auroc), 6) AS mean_single, round(avg(multivariate_auroc), 6) AS mean_multivariate,
    round(avg(held_out_auroc), 6) AS mean_held_out, count(*) AS n_rows FROM sweep GROUP BY 1""",
)
def d45(spark, sf):
    out = N.point_means(sweep(spark, sf))
    return out.select("min_positives", *[r6(F.col(c), c) for c in out.columns[1:-1]], "n_rows")


THEORY = """
t AS (SELECT model, min_positives AS n_positive, count(*) AS n_total, count(DISTINCT best_feature_idx) AS d, avg(auroc_inflation) AS measured FROM sweep GROUP BY ALL),
v AS (SELECT *, sqrt((0.25 + (n_positive - 1) * (1 / 3.0::DOUBLE - 0.25) + (n_total - n_positive - 1) * (1 / 3.0::DOUBLE - 0.25)) / (n_positive * (n_total - n_positive))) AS sigma FROM t),
a AS (SELECT *, sqrt(2 * ln(2.0::DOUBLE * d)) AS af, sqrt(2 * ln(d::DOUBLE)) AS au FROM v),
th AS (SELECT *, sigma * (af - (ln(ln(2.0::DOUBLE * d)) + ln(4 * pi())) / (2 * af) + 0.5772156649015329::DOUBLE / af) AS tf,
   sigma * (au - (ln(ln(d::DOUBLE)) + ln(4 * pi())) / (2 * au) + 0.5772156649015329::DOUBLE / au) AS tu FROM a)
"""


def _theory_rows(spark, sf):
    return sweep(spark, sf).groupBy("model", F.col("min_positives").alias("n_positive")).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_distinct("best_feature_idx").alias("d"),
        F.avg("auroc_inflation").alias("measured"),
    )


@query("b15_auroc_variance", "WITH " + SWEEP + "," + THEORY + " SELECT model, n_positive, round(sigma, 6) AS sigma FROM th")
def b15(spark, sf):
    return N.theory_check(_theory_rows(spark, sf)).select("model", "n_positive", r6(F.col("sigma"), "sigma"))


@query(
    "b16_expected_max_inflation",
    "WITH " + SWEEP + "," + THEORY + " SELECT model, n_positive, round(tf, 6) AS theory_folded, round(tu, 6) AS theory_unfolded FROM th",
)
def b16(spark, sf):
    out = N.theory_check(_theory_rows(spark, sf))
    return out.select("model", "n_positive", r6(F.col("theory_folded"), "theory_folded"), r6(F.col("theory_unfolded"), "theory_unfolded"))


@query(
    "d46_theory_check",
    "WITH " + SWEEP + "," + THEORY + """ SELECT round(avg(measured / tf), 6) AS folded_mean, round(stddev_samp(measured / tf), 6) AS folded_sd,
    round(avg(measured / tu), 6) AS unfolded_mean, round(stddev_samp(measured / tu), 6) AS unfolded_sd FROM th""",
)
def d46(spark, sf):
    out = N.theory_summary(N.theory_check(_theory_rows(spark, sf)))
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query(
    "b17_logistic_prediction",
    """SELECT p_partkey, round(1 / (1 + exp(-(-1.5::DOUBLE + 0.6::DOUBLE * ln(p_size::DOUBLE)))), 6) AS predicted,
    round(1 / (1 + exp(-(p_size / 50.0::DOUBLE + 0.6::DOUBLE * ln(2.0::DOUBLE)))) - 1 / (1 + exp(-(p_size / 50.0::DOUBLE))), 6) + 0.0 AS per_doubling FROM part""",
)
def b17(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select(
        "p_partkey",
        r6(ST.logistic_prediction(F.lit(-1.5), F.lit(0.6), size), "predicted"),
        r6(ST.effect_per_doubling(size / 50, F.lit(0.6)), "per_doubling"),
    )


def phi_sql(x: str, steps: int = 1000) -> str:
    """Normal distribution function by Simpson's rule, independent of the library's."""
    node = f"exp(-pow(({x}) * i / {steps}.0::DOUBLE, 2) / 2)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5::DOUBLE + ({x}) / {3 * steps}.0::DOUBLE * list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {node})) / sqrt(2 * pi()))"


# Closed forms of the t distribution with five and of chi-square with three degrees of freedom.
@query(
    "b28_distribution_tails",
    f"""WITH c AS (SELECT c_custkey, c_acctbal::DOUBLE / 2000 AS z, atan(c_acctbal::DOUBLE / 2000 / sqrt(5)) AS th, sqrt(abs(c_acctbal::DOUBLE / 2000)) AS r FROM customer)
    SELECT c_custkey, round({phi_sql("z")}, 8) AS norm_cdf,
      round(0.5::DOUBLE - (th + sin(th) * (cos(th) + 2.0::DOUBLE / 3 * pow(cos(th), 3))) / pi(), 8) AS t_sf,
      round(2 * (1 - {phi_sql("r")}) + r * sqrt(2 / pi()) * exp(-r * r / 2), 8) AS chi2_sf FROM c""",
)
def b28(spark, sf):
    z = (F.col("c_acctbal") / 2000).alias("z")
    return table(spark, sf, "customer").select("c_custkey", z).select(
        "c_custkey",
        F.round(tails.norm_cdf(F.col("z")), 8).alias("norm_cdf"),
        F.round(tails.t_sf(F.col("z"), F.lit(5)), 8).alias("t_sf"),
        F.round(tails.chi2_sf(F.abs("z"), F.lit(3)), 8).alias("chi2_sf"),
    )


def max_sql(d: str) -> str:
    a = f"sqrt(2 * ln(2.0::DOUBLE * {d}))"
    return f"({a} - (ln(ln(2.0::DOUBLE * {d})) + ln(4 * pi())) / (2 * {a}) + 0.5772156649015329::DOUBLE / {a})"


@query(
    "d47_power",
    "WITH " + SWEEP + f""", pc AS (SELECT model, best_feature_idx, avg(auroc_inflation) AS m FROM sweep WHERE auroc_inflation IS NOT NULL GROUP BY ALL),
    ar AS (SELECT model, avg(m) * 0.05 AS effect, stddev_samp(m) AS sd, count(*) AS n FROM pc GROUP BY 1),
    z AS (SELECT model, n, effect / (sd * sqrt(2.0::DOUBLE / n)) - 1.959963984540054::DOUBLE AS up, -effect / (sd * sqrt(2.0::DOUBLE / n)) - 1.959963984540054::DOUBLE AS down FROM ar)
    SELECT model, n, round({phi_sql("up")} + {phi_sql("down")}, 6) + 0.0 AS power, round({max_sql("(2 * n)")} / {max_sql("n")}, 6) AS ratio_doubled FROM z""",
)
def d47(spark, sf):
    ratio = N.inflation_ratio(F.col("n"), 2 * F.col("n"))
    return _arm_power(spark, sf).select("model", "n", r6(F.col("power"), "power"), r6(ratio, "ratio_doubled"))


@query(
    "d47_required_clusters",
    "WITH " + SWEEP + """, pc AS (SELECT model, best_feature_idx, avg(auroc_inflation) AS m FROM sweep WHERE auroc_inflation IS NOT NULL GROUP BY ALL),
    ar AS (SELECT model, avg(m) * 0.05 AS effect, stddev_samp(m) AS sd, count(*) AS n FROM pc GROUP BY 1)
    SELECT model, n, round(2 * pow(sd * (1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) / effect, 2), 4) AS required_clusters FROM ar""",
)
def d47_required(spark, sf):
    return _arm_power(spark, sf).select("model", "n", F.round("required_clusters", 4).alias("required_clusters"))


def _arm_power(spark, sf):
    per_cluster = sweep(spark, sf).where(F.col("auroc_inflation").isNotNull()).groupBy("model", "best_feature_idx").agg(
        F.avg("auroc_inflation").alias("m")
    )
    arms = per_cluster.groupBy("model").agg(
        (F.avg("m") * 0.05).alias("effect"), F.stddev_samp("m").alias("sd"), F.count(F.lit(1)).alias("n")
    )
    return arms.withColumns(N.power_columns(F.col("effect"), F.col("sd"), F.col("n")))


@query(
    "d48_evidence_depth",
    """WITH c AS (SELECT l_partkey % 50 AS concept_id, count(DISTINCT l_orderkey) AS n, avg((l_returnflag IN ('A', 'R'))::INT) AS share FROM lineitem GROUP BY 1)
    SELECT count(*) AS n_points, round(regr_slope(share, ln(n::DOUBLE)), 6) + 0.0 AS slope, round(regr_r2(share, ln(n::DOUBLE)), 6) + 0.0 AS r_squared,
      round(avg(share), 6) AS mean_share FROM c""",
)
def d48(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 50).alias("concept_id"), F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("evidence")
    )
    out = N.evidence_depth(rows, experimental=["A", "R"])
    return out.select("n_points", *[r6(F.col(c), c) for c in ("slope", "r_squared", "mean_share")])


@query(
    "d59_curve_clean_up",
    "WITH " + SWEEP + "," + DUPLICATED + """, p AS (SELECT model, min_positives, count(auroc_inflation) AS n_rows, avg(auroc_inflation) AS mean,
       count(DISTINCT CASE WHEN auroc_inflation IS NOT NULL THEN best_feature_idx END) AS n_clusters FROM dup GROUP BY ALL)
    SELECT model, min_positives, n_rows, round(mean, 6) AS mean, n_clusters >= 10 AS reliable FROM p WHERE min_positives <> 20""",
)
def d59(spark, sf):
    points = with_duplicate_point(sweep(spark, sf)).where(F.col("auroc_inflation").isNotNull()).groupBy("model", "min_positives").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("auroc_inflation"), 12).alias("mean"),
        F.count_distinct("best_feature_idx").alias("n_clusters"),
    )
    return N.clean_curve(points).select("model", "min_positives", "n_rows", r6(F.col("mean"), "mean"), "reliable")


@query(
    "d60_stored_effects",
    """WITH b AS (SELECT p_brand AS variant_id, avg(l_discount) - 0.05 AS m, stddev_samp(l_discount) / 10 AS s, avg(l_tax) AS r, count(*) AS n
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT variant_id, printf('%.4f', m)::DOUBLE + 0.0 AS acme, printf('%.4f', m - s)::DOUBLE + 0.0 AS acme_lo, printf('%.4f', m + s)::DOUBLE + 0.0 AS acme_hi,
      printf('%.4f', r)::DOUBLE + 0.0 AS r_squared FROM b""",
)
def d60(spark, sf):
    rows = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    stats = rows.groupBy(F.col("p_brand").alias("variant_id")).agg(
        (F.avg("l_discount") - 0.05).alias("m"), (F.stddev_samp("l_discount") / 10).alias("s"), F.avg("l_tax").alias("r")
    )
    stored = stats.select(
        "variant_id",
        F.lit(True).alias("acme_reportable"),
        F.format_string("ACME=%.4f (95%% CI [%.4f, %.4f], p=0.5), n=9", F.col("m"), F.col("m") - F.col("s"), F.col("m") + F.col("s")).alias("mediation_text"),
        F.format_string("twas: R²=%.4f, coef=1.0", F.col("r")).alias("baseline_text"),
    )
    return N.parse_stored_effects(stored).select("variant_id", *[(F.col(c) + 0.0).alias(c) for c in ("acme", "acme_lo", "acme_hi", "r_squared")])
