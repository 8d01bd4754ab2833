"""Mediation queries: locus = brand, t = order size class, m = quantity, y = price.

Samples are line items, covariate = return flag.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import stats as ST
from attestor.operators import mediation as M
from attestor.session import materialize
from attestor.workload.catalog import query, r6, table

MED = """
r AS (SELECT p_brand AS locus, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity::BIGINT AS sample_id, (l_suppkey % 3)::DOUBLE AS t,
   l_quantity + 4 * (l_suppkey % 3) AS m, l_extendedprice / 1000 + (l_suppkey % 3) AS y, l_returnflag AS superpopulation
   FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT locus, count(*) AS n, covar_pop(t, m) AS tm, covar_pop(t, y) AS ty, covar_pop(m, y) AS my, var_pop(t) AS tt, var_pop(m) AS mm, var_pop(y) AS yy FROM r GROUP BY 1),
e AS (SELECT *, tm / tt AS beta, (my * tt - tm * ty) / (tt * mm - tm * tm) AS delta, (ty * mm - tm * my) / (tt * mm - tm * tm) AS ade FROM c),
s AS (SELECT *, sqrt(n * (mm - beta * tm) / (n - 1)) AS s1, sqrt(n * (yy - ade * ty - delta * my) / (n - 1)) AS s2 FROM e)
"""


def rows(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("locus"))
    t = (F.col("l_suppkey") % 3).cast("double")
    return table(spark, sf, "lineitem").join(parts, "l_partkey").select(
        "locus",
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")).alias("sample_id"),
        t.alias("t"),
        (F.col("l_quantity") + 4 * t).alias("m"),
        (F.col("l_extendedprice") / 1000 + t).alias("y"),
        F.col("l_returnflag").alias("superpopulation"),
    )


@query(
    "d49_mediation_points",
    "WITH " + MED + """ SELECT locus, n AS n_obs, round(beta * delta, 5) + 0.0 AS acme, round(ade, 5) + 0.0 AS ade, round(beta * delta + ade, 5) + 0.0 AS total,
    round(beta * delta / (beta * delta + ade), 4) + 0.0 AS proportion, round(sqrt(mm), 5) AS mediator_sd FROM s""",
)
def d49(spark, sf):
    out = M.mediation(rows(spark, sf), keys=["locus"], n_rep=10)
    five = [(F.round(c, 5) + 0.0).alias(c) for c in ("acme", "ade", "total", "mediator_sd")]
    return out.select("locus", "n_obs", *five, (F.round("proportion", 4) + 0.0).alias("proportion"))


# with one categorical covariate, regression on its dummies is regression on values centered within it
CENTERED = """
z AS (SELECT locus, superpopulation, sample_id, t - avg(t) OVER g AS t, {m} - avg({m}) OVER g AS m, y - avg(y) OVER g AS y, y AS y_raw FROM r WINDOW g AS (PARTITION BY locus, superpopulation)),
cc AS (SELECT locus, count(*) AS n, sum(t * m) AS tm, sum(t * y) AS ty, sum(m * y) AS my, sum(t * t) AS tt, sum(m * m) AS mm, sum(y * y) AS yy, var_pop(y_raw) * count(*) AS tss FROM z GROUP BY 1),
ce AS (SELECT *, tm / tt * (my * tt - tm * ty) / (tt * mm - tm * tm) AS acme, (ty * mm - tm * my) / (tt * mm - tm * tm) AS ade FROM cc)
"""


@query(
    "d49_mediation_covariates",
    "WITH " + MED + "," + CENTERED.format(m="m") + " SELECT locus, n AS n_obs, round(acme, 5) + 0.0 AS acme, round(ade, 5) + 0.0 AS ade, round(acme + ade, 5) + 0.0 AS total FROM ce",
)
def d49_covariates(spark, sf):
    out = M.mediation(rows(spark, sf), keys=["locus"], category="superpopulation", n_rep=10)
    return out.select("locus", "n_obs", *[(F.round(c, 5) + 0.0).alias(c) for c in ("acme", "ade", "total")])


def _normal(name: str) -> str:
    u, v = (f"(('0x' || substr(md5('42:{name}:{x}:' || locus || ':' || i), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296" for x in "uv")
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * ({v}))"


INTERVALS = f""",
lv AS (SELECT locus, count(DISTINCT superpopulation) AS g, sqrt(var_pop(m)) AS mediator_sd FROM r GROUP BY 1),
cf AS (SELECT cc.locus, tm / tt AS beta, (my * tt - tm * ty) / (tt * mm - tm * tm) AS delta, (ty * mm - tm * my) / (tt * mm - tm * tm) AS ade,
         tt * mm - tm * tm AS det, n, g, mediator_sd, tt, tm, mm, ty, my, yy FROM cc JOIN lv USING (locus)),
vr AS (SELECT *, (mm - tm * tm / tt) / (n - 1 - g) / tt AS vb, (yy - ade * ty - delta * my) / (n - 2 - g) AS s2 FROM cf),
ch AS (SELECT *, sqrt(s2 * mm / det) AS l00, -s2 * tm / det / sqrt(s2 * mm / det) AS l10 FROM vr),
dz AS (SELECT locus, mediator_sd, beta, vb, delta, ade, l00, l10, sqrt(greatest(s2 * tt / det - l10 * l10, 0)) AS l11,
         {_normal('beta')} AS zb, {_normal('ade')} AS za, {_normal('delta')} AS zd FROM ch, unnest(range(0, 1000)) AS q(i)),
sim AS (SELECT locus, mediator_sd, (beta + sqrt(vb) * zb) * (delta + l10 * za + l11 * zd) AS acme, ade + l00 * za AS ade FROM dz),
iv AS (SELECT locus, any_value(mediator_sd) AS mediator_sd,
         quantile_cont(acme, 0.025) AS acme_lo, quantile_cont(acme, 0.975) AS acme_hi, 2 * least(avg((acme > 0)::INT), avg((acme < 0)::INT)) AS acme_p,
         quantile_cont(ade, 0.025) AS ade_lo, quantile_cont(ade, 0.975) AS ade_hi, 2 * least(avg((ade > 0)::INT), avg((ade < 0)::INT)) AS ade_p,
         quantile_cont(acme + ade, 0.025) AS total_lo, quantile_cont(acme + ade, 0.975) AS total_hi,
         2 * least(avg((acme + ade > 0)::INT), avg((acme + ade < 0)::INT)) AS total_p FROM sim GROUP BY locus)
"""
BOUNDS = [f"{e}_{b}" for e in ("acme", "ade", "total") for b in ("lo", "hi", "p")]


@query(
    "d49_mediation_intervals",
    "WITH " + MED + "," + CENTERED.format(m="m") + INTERVALS + "SELECT locus, " + ", ".join(f"round({b}, 5) + 0.0 AS {b}" for b in BOUNDS)
    + ", mediator_sd > 1e-8 AS acme_reportable, NOT (total_lo <= 0 AND total_hi >= 0) AS proportion_reportable FROM iv",
)
def d49_intervals(spark, sf):
    out = M.mediation(rows(spark, sf), keys=["locus"], category="superpopulation", n_rep=1000)
    return out.select("locus", *[(F.round(b, 5) + 0.0).alias(b) for b in BOUNDS], "acme_reportable", "proportion_reportable")


NOISE = "noisy AS (SELECT * REPLACE (sqrt(-2 * ln((('0x' || substr(md5('42:u:' || locus || ':' || sample_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * ((('0x' || substr(md5('42:v:' || locus || ':' || sample_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) AS m) FROM r)"


@query(
    "d50_negative_control",
    "WITH " + MED + "," + NOISE + "," + CENTERED.format(m="m").replace("FROM r WINDOW", "FROM noisy WINDOW") + " SELECT locus, round(acme, 5) + 0.0 AS acme, round(ade, 5) + 0.0 AS ade FROM ce",
)
def d50(spark, sf):
    out = M.negative_control(rows(spark, sf), keys=["locus"], category="superpopulation", n_rep=10)
    return out.select("locus", *[(F.round(c, 5) + 0.0).alias(c) for c in ("acme", "ade")])


@query(
    "d51_sensitivity_curve",
    "WITH " + MED + """, g AS (SELECT round(-0.9 + 0.05 * i, 2)::DOUBLE AS rho FROM (SELECT unnest(range(0, 37)) AS i))
    SELECT locus, rho, round(beta * (delta - rho * s2 / (s1 * sqrt(1 - rho * rho))), 5) + 0.0 AS acme_at_rho FROM s, g""",
)
def d51(spark, sf):
    curve = M.sensitivity_curve(M.mediation(rows(spark, sf), keys=["locus"], n_rep=10), keys=["locus"])
    return curve.select("locus", "rho", (F.round("acme_at_rho", 5) + 0.0).alias("acme_at_rho"))


@query(
    "d51_zero_crossing",
    "WITH " + MED + """, g AS (SELECT round(-0.9 + 0.05 * i, 2)::DOUBLE AS rho FROM (SELECT unnest(range(0, 37)) AS i)),
    cv AS (SELECT locus, rho, beta * (delta - rho * s2 / (s1 * sqrt(1 - rho * rho))) AS y FROM s, g),
    st AS (SELECT *, lead(y) OVER w AS y1, lead(rho) OVER w AS x1 FROM cv WINDOW w AS (PARTITION BY locus ORDER BY rho))
    SELECT locus, round(min_by(CASE WHEN sign(y1) <> sign(y) THEN rho + (0 - y) * (x1 - rho) / (y1 - y) END, CASE WHEN sign(y1) <> sign(y) THEN rho END), 5) + 0.0 AS rho_star FROM st GROUP BY locus""",
)
def d51_crossing(spark, sf):
    effects = M.mediation(rows(spark, sf), keys=["locus"], n_rep=10)
    out = M.zero_crossing(M.sensitivity_curve(effects, keys=["locus"]), keys=["locus"])
    return out.select("locus", (F.round("rho_star", 5) + 0.0).alias("rho_star"))


@query(
    "d52_single_predictor_baseline",
    "WITH " + MED + " SELECT locus, 'twas_style' AS method, round(ty * ty / (tt * yy), 6) + 0.0 AS r_squared, round(ty / tt, 5) + 0.0 AS coefficient, n AS n_obs FROM c",
)
def d52(spark, sf):
    out = M.baseline_regression(rows(spark, sf), keys=["locus"], predictor="t", method="twas_style")
    return out.select("locus", "method", r6(F.col("r_squared"), "r_squared"), (F.round("coefficient", 5) + 0.0).alias("coefficient"), "n_obs")


@query(
    "d53_distance_to_reference",
    """WITH v AS (SELECT vec_id AS sample_id, label AS locus, embedding::DOUBLE[] AS vec FROM embeddings),
    ref AS (SELECT locus, min_by(vec, sample_id) AS ref FROM v GROUP BY 1)
    SELECT sample_id, locus, round(list_distance(vec, ref), 6) + 0.0 AS distance FROM v JOIN ref USING (locus)""",
)
def d53(spark, sf):
    samples = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("locus"), F.col("embedding").cast("array<double>").alias("vec")
    )
    reference = samples.groupBy("locus").agg(F.min_by("vec", "sample_id").alias("vec"))
    out = M.distance_to_reference(samples, reference, keys=["locus"])
    return out.select("sample_id", "locus", r6(F.col("distance"), "distance"))




@query(
    "d54_haplotype_averaging",
    """WITH h AS (SELECT lang AS locus, doc_id // 2 AS sample_id, text FROM documents),
    u AS (SELECT DISTINCT text, n FROM (SELECT text, length(text) AS n FROM documents))
    SELECT locus, sample_id, round(avg(length(text)), 4) AS m FROM h GROUP BY 1, 2""",
)
def d54(spark, sf):
    out, _ = _haplotypes(spark, sf)
    return out.select("locus", "sample_id", F.round("m", 4).alias("m"))


@query(
    "d54_unique_sequences",
    "SELECT lang AS locus, count(DISTINCT text) AS n_unique, count(*) AS n_total FROM documents GROUP BY 1",
)
def d54_counts(spark, sf):
    return _haplotypes(spark, sf)[1]


def _haplotypes(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("locus"),
        F.floor(F.col("doc_id") / 2).cast("bigint").alias("sample_id"),
        (F.col("doc_id") % 2).alias("haplotype"),
        F.col("text").alias("sequence"),
    )

    def scorer(unique):
        return unique.select("sequence_id", F.lit(0).alias("feature_idx"), F.length("sequence").cast("double").alias("act"))

    return M.score_haplotypes(docs, scorer, keys=["locus"])


LOCI = """lr AS (SELECT p_partkey AS locus, p_brand AS gene_id, CASE WHEN p_partkey % 2 = 0 THEN 'naive' ELSE 'verified' END AS arm, p_size % 6 <> 0 AS acme_reportable,
   ((p_partkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS acme_p, p_size % 4 <> 0 AS proportion_reportable, (p_retailprice - 950) / 5000 AS proportion FROM part)"""


def locus_results(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("locus"),
        F.col("p_brand").alias("gene_id"),
        F.when(key % 2 == 0, "naive").otherwise("verified").alias("arm"),
        (F.col("p_size") % 6 != 0).alias("acme_reportable"),
        (((key * 7919) % 10007 + 1) / F.lit(10008.0)).alias("acme_p"),
        (F.col("p_size") % 4 != 0).alias("proportion_reportable"),
        ((F.col("p_retailprice") - 950) / 5000).alias("proportion"),
    )


@query(
    "d55_arm_fdr",
    "WITH " + LOCI + """, k AS (SELECT *, rank() OVER (PARTITION BY arm ORDER BY acme_p) + count(*) OVER (PARTITION BY arm, acme_p) - 1 AS r, count(*) OVER (PARTITION BY arm) AS m FROM lr WHERE acme_reportable),
    a AS (SELECT locus, least(1, min(acme_p * m / r) OVER (PARTITION BY arm ORDER BY acme_p DESC RANGE UNBOUNDED PRECEDING)) AS adj FROM k)
    SELECT lr.locus, arm, round(adj, 6) AS acme_p_bh, coalesce(adj <= 0.05, false) AS significant_after_bh FROM lr LEFT JOIN a USING (locus)""",
)
def d55(spark, sf):
    out = M.adjust_arms(locus_results(spark, sf))
    return out.select("locus", "arm", r6(F.col("acme_p_bh"), "acme_p_bh"), "significant_after_bh")


@query(
    "d56_proportion_equivalence",
    "WITH " + LOCI + """, k AS (SELECT * FROM lr WHERE acme_reportable AND proportion_reportable)
    SELECT count(*) AS n, round(avg(proportion), 6) + 0.0 AS mean, round(stddev_samp(proportion) / sqrt(count(*)), 6) AS se, count(DISTINCT gene_id) AS n_distinct_genes,
      (SELECT count(*) FROM lr WHERE acme_reportable AND NOT proportion_reportable) AS n_excluded, count(DISTINCT gene_id) < count(*) AS repeated_genes FROM k""",
)
def d56(spark, sf):
    out = M.proportion_equivalence(locus_results(spark, sf), margin=0.1)
    return out.select("n", r6(F.col("mean"), "mean"), r6(F.col("se"), "se"), "n_distinct_genes", "n_excluded", "repeated_genes")


@query(
    "b27_reportability",
    "WITH " + LOCI + " SELECT locus, abs(proportion) > 1e-8 AS acme_ok, NOT (proportion - 0.01 <= 0 AND proportion + 0.01 >= 0) AS ratio_ok FROM lr",
)
def b27(spark, sf):
    p = F.col("proportion")
    return locus_results(spark, sf).select(
        "locus", ST.acme_reportable(F.abs(p)).alias("acme_ok"), ST.proportion_reportable(p - 0.01, p + 0.01).alias("ratio_ok")
    )


ALIGN = """
loci AS (SELECT 'v' || p_partkey || '_' || p_brand AS locus, p_partkey AS variant_id, p_brand AS gene_id FROM part),
dos AS (SELECT l_partkey AS variant_id, l_suppkey AS sample_id, min(l_linenumber % 3)::DOUBLE AS t FROM lineitem GROUP BY 1, 2),
ex AS (SELECT p_brand AS gene_id, l_suppkey AS sample_id, avg(l_discount) AS y FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#7' GROUP BY 1, 2),
al AS (SELECT locus, gene_id, sample_id, t, y FROM loci JOIN dos USING (variant_id) JOIN ex USING (gene_id, sample_id))"""


def _aligned(spark, sf):
    loci = table(spark, sf, "part").select(
        F.concat(F.lit("v"), "p_partkey", F.lit("_"), "p_brand").alias("locus"),
        F.col("p_partkey").alias("variant_id"),
        F.col("p_brand").alias("gene_id"),
    )
    lines = table(spark, sf, "lineitem")
    dosage = lines.groupBy(F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("sample_id")).agg(
        F.min(F.col("l_linenumber") % 3).alias("dosage")
    )
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene_id"))
    expression = (
        lines.join(brand.where(F.col("gene_id") != "Brand#7"), "l_partkey")
        .groupBy("gene_id", F.col("l_suppkey").alias("sample_id")).agg(F.avg("l_discount").alias("value"))
    )
    return M.align_samples(loci, dosage, expression), loci, dosage


@query("c7_dosage_expression_join", "WITH " + ALIGN + " SELECT locus, sample_id, t, round(y, 6) + 0.0 AS y FROM al")
def c7(spark, sf):
    (aligned, _), _, _ = _aligned(spark, sf)
    return aligned.select("locus", "sample_id", "t", r6(F.col("y"), "y"))


@query(
    "d57_skipped_loci",
    "WITH " + ALIGN + """ SELECT locus, CASE WHEN variant_id NOT IN (SELECT variant_id FROM dos) THEN 'variant not genotyped'
      WHEN gene_id NOT IN (SELECT gene_id FROM ex) THEN 'gene not in expression table' ELSE 'no shared samples' END AS skip_reason
    FROM loci WHERE locus NOT IN (SELECT locus FROM al)""",
)
def d57_skipped(spark, sf):
    return _aligned(spark, sf)[0][1]


def _panel(spark, sf):
    return table(spark, sf, "supplier").join(
        table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey"
    ).join(table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name")), "n_regionkey").select(
        F.col("s_suppkey").alias("sample_id"), F.col("r_name").alias("superpopulation")
    )


PANEL = """panel AS (SELECT s_suppkey AS sample_id, r_name AS superpopulation FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query(
    "c8_ancestry_dummies",
    "WITH " + ALIGN + "," + PANEL + """, x AS (SELECT gene_id, sample_id, superpopulation FROM (SELECT DISTINCT gene_id, sample_id FROM al) JOIN panel USING (sample_id)),
    lv AS (SELECT DISTINCT gene_id, superpopulation AS level FROM x),
    us AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY level) > 1)
    SELECT gene_id, sample_id, level, (superpopulation = level)::INT AS value FROM x JOIN us USING (gene_id)""",
)
def c8(spark, sf):
    (aligned, _), _, _ = _aligned(spark, sf)
    rows_ = M.add_ancestry(aligned.select("gene_id", "sample_id").distinct(), _panel(spark, sf))
    return M.ancestry_dummies(rows_, keys=["gene_id"])


@query(
    "d5_population_composition",
    "WITH " + ALIGN + "," + PANEL + " SELECT gene_id, superpopulation, count(*) AS n_samples FROM (SELECT DISTINCT gene_id, sample_id FROM al) JOIN panel USING (sample_id) GROUP BY ALL",
)
def d5_population(spark, sf):
    (aligned, _), _, _ = _aligned(spark, sf)
    rows_ = M.add_ancestry(aligned.select("gene_id", "sample_id").distinct(), _panel(spark, sf))
    return M.population_counts(rows_, keys=["gene_id"])


@query("a12_sample_panel", "WITH " + PANEL + " SELECT superpopulation, count(*) AS n FROM panel GROUP BY 1")
def a12(spark, sf):
    return _panel(spark, sf).groupBy("superpopulation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c19_locus_features",
    """SELECT p_partkey AS locus, 'S' || (p_partkey % 120) AS gene_id, s_suppkey AS feature_idx, CASE WHEN s_suppkey % 2 = 0 THEN 'spurious' END AS status
    FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 120""",
)
def c19(spark, sf):
    loci = table(spark, sf, "part").select(
        F.col("p_partkey").alias("locus"), F.concat(F.lit("S"), F.col("p_partkey") % 120).alias("gene_id")
    )
    supplier = table(spark, sf, "supplier")
    naive = supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("gene_id"), F.col("s_suppkey").alias("feature_idx"))
    verdicts = supplier.where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("feature_idx"), F.lit("spurious").alias("status"), F.lit("r").alias("reason"), F.lit(0.0).alias("match_rate")
    )
    return M.attach_features(loci, naive, verdicts).select("locus", "gene_id", "feature_idx", "status")


@query(
    "d57_locus_study",
    "WITH " + MED + "," + CENTERED.format(m="m") + """ SELECT locus, 'naive' AS arm, regexp_extract(locus, '(\\d+)', 1)::INT % 7 AS feature_idx, n AS n_obs, round(acme, 5) + 0.0 AS acme,
    round(1 - (yy - ty * ty / tt) / tss, 5) + 0.0 AS twas_r_squared, 'spurious' AS status FROM ce""",
)
def d57(spark, sf):
    from attestor.plans.locus_study import run_locus_study

    base = rows(spark, sf)
    loci = materialize(base.select("locus").distinct()).select("locus", F.col("locus").alias("variant_id"), F.col("locus").alias("gene_id"))
    dosage = base.select(F.col("locus").alias("variant_id"), "sample_id", F.col("t").alias("dosage"))
    expression = base.select(F.col("locus").alias("gene_id"), "sample_id", F.col("y").alias("value"))
    # dealt out by sample alone, as the join with the panel needs it
    panel = base.select("sample_id", "superpopulation").repartition("sample_id").distinct()
    number = F.regexp_extract("locus", r"(\d+)", 1).cast("int")
    features = base.select("locus", "sample_id", (number % 7).alias("feature_idx"), "m")
    naive = loci.select("gene_id", (F.regexp_extract("gene_id", r"(\d+)", 1).cast("int") % 7).alias("feature_idx"))
    verdicts = naive.select("feature_idx").distinct().select(
        "feature_idx", F.lit("spurious").alias("status"), F.lit("no window").alias("reason"), F.lit(0.0).alias("match_rate")
    )
    out = run_locus_study(loci, dosage, expression, panel, features, naive, verdicts, n_rep=200)
    five = [(F.round(c, 5) + 0.0).alias(c) for c in ("acme", "twas_r_squared")]
    return out.select("locus", "arm", "feature_idx", "n_obs", *five, "status")
