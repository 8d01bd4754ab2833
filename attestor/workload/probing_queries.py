"""Probing queries on ``embeddings``: unit = vec_id, 64 signed features, concept = label."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from attestor.operators import auroc as A
from attestor.operators import probing as P
from attestor.operators import splits as S
from attestor.session import materialize
from attestor.workload.catalog import dense_features, query, r6, table, unit_labels, vectors
from attestor.workload.inference_queries import boot_sql

CONFIG = P.ProbeConfig(min_positives=10, min_hard_negatives=3)

DENSE = """
feats AS (SELECT vec_id AS unit_id, label, unnest(range(0, len(embedding)))::INT AS feature_idx,
                 unnest(embedding)::DOUBLE AS act FROM embeddings),
"""

PAIR_RANKS = """
concepts AS (SELECT DISTINCT label AS concept_id FROM embeddings),
rk AS (SELECT unit_id, feature_idx, label, act,
              rank() OVER (PARTITION BY feature_idx ORDER BY act)
              + (count(*) OVER (PARTITION BY feature_idx, act) - 1) / 2.0 AS r FROM feats),
tot AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
pair AS (SELECT c.concept_id, rk.feature_idx, sum(r) FILTER (rk.label = c.concept_id) AS rs,
                count(*) FILTER (rk.label = c.concept_id)::DOUBLE AS np
         FROM rk, concepts c GROUP BY ALL),
raw AS (SELECT concept_id, feature_idx, (rs - np * (np + 1) / 2) / (np * (n - np)) AS raw_auroc, np, n
        FROM pair, tot)
"""


def _n(spark, sf):
    return table(spark, sf, "embeddings").count()


@query(
    "d6_feature_auroc",
    "WITH " + DENSE + PAIR_RANKS + "SELECT concept_id, feature_idx, "
    "round(greatest(raw_auroc, 1 - raw_auroc), 6) + 0.0 AS auroc FROM raw",
)
def d6(spark, sf):
    pairs = A.whole_set_auroc(dense_features(spark, sf), unit_labels(spark, sf), _n(spark, sf))
    return pairs.select("concept_id", "feature_idx", r6(F.col("auroc"), "auroc"))


@query(
    "d7_raw_auroc",
    "WITH " + DENSE + PAIR_RANKS + "SELECT concept_id, feature_idx, np::BIGINT AS n_pos, (n - np)::BIGINT AS n_neg, "
    "round(raw_auroc, 6) + 0.0 AS raw_auroc FROM raw WHERE feature_idx = 5",
)
def d7(spark, sf):
    one = vectors(spark, sf).select("unit_id", F.lit(5).alias("feature_idx"), F.get("vec", F.lit(5)).alias("act"))
    pairs = A.whole_set_auroc(one, unit_labels(spark, sf), _n(spark, sf))
    return pairs.select(
        "concept_id",
        "feature_idx",
        F.col("n_pos_all").alias("n_pos"),
        F.col("n_neg_all").alias("n_neg"),
        r6(F.col("raw_auroc"), "raw_auroc"),
    )


@query(
    "d8_best_feature",
    "WITH " + DENSE + PAIR_RANKS + """, best AS (SELECT concept_id, feature_idx,
      round(greatest(raw_auroc, 1 - raw_auroc), 12) AS auroc FROM raw)
    SELECT concept_id, feature_idx AS best_feature_idx, round(auroc, 6) + 0.0 AS single_feature_auroc FROM best
    QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY auroc DESC, feature_idx) = 1""",
)
def d8(spark, sf):
    top = A.whole_set_best(dense_features(spark, sf), unit_labels(spark, sf), _n(spark, sf))
    return top.select("concept_id", "best_feature_idx", r6(F.col("single_feature_auroc"), "single_feature_auroc"))


# Few values per feature, of both signs; the twins fill the matrix up with zeros.
SPARSE = """
kept AS (SELECT vec_id AS unit_id, unnest(range(0, len(embedding)))::INT AS feature_idx, unnest(embedding)::DOUBLE AS act FROM embeddings),
sparse AS (SELECT * FROM kept WHERE abs(act) > 0.34),
dict AS (SELECT DISTINCT feature_idx FROM sparse),
feats AS (SELECT e.vec_id AS unit_id, e.label, d.feature_idx, coalesce(s.act, 0) AS act
          FROM embeddings e CROSS JOIN dict d LEFT JOIN sparse s ON s.unit_id = e.vec_id AND s.feature_idx = d.feature_idx),
"""


def sparse_features(spark, sf):
    return dense_features(spark, sf).where(F.abs("act") > 0.34)


@query(
    "d6_full_sparse_auroc",
    "WITH " + SPARSE + PAIR_RANKS + "SELECT concept_id, feature_idx, round(raw_auroc, 6) + 0.0 AS raw_auroc FROM raw",
)
def d6_full(spark, sf):
    out = A.full_auroc(sparse_features(spark, sf), unit_labels(spark, sf), _n(spark, sf))
    return out.select("concept_id", "feature_idx", r6(F.col("raw_auroc"), "raw_auroc"))


@query(
    "d8_sparse_best_feature",
    "WITH " + SPARSE + PAIR_RANKS + """, best AS (SELECT concept_id, feature_idx,
      round(greatest(raw_auroc, 1 - raw_auroc), 12) AS auroc FROM raw)
    SELECT concept_id, feature_idx AS best_feature_idx, round(auroc, 6) + 0.0 AS single_feature_auroc FROM best
    QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY auroc DESC, feature_idx) = 1""",
)
def d8_sparse(spark, sf):
    top = A.whole_set_best(sparse_features(spark, sf), unit_labels(spark, sf), _n(spark, sf))
    return top.select("concept_id", "best_feature_idx", r6(F.col("single_feature_auroc"), "single_feature_auroc"))


@query(
    "d9_stratified_split",
    """WITH u AS (SELECT vec_id % 3 AS concept_id, vec_id AS unit_id, (label = 3)::INT AS y, md5('42:' || vec_id) AS h FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY concept_id, y ORDER BY h, unit_id) AS rk, count(*) OVER (PARTITION BY concept_id, y) AS n FROM u),
    t AS (SELECT *, greatest(1, least(n - 1, floor(0.2::DOUBLE * n + 0.5)))::BIGINT AS test FROM r),
    q AS (SELECT *, CASE WHEN min(test) OVER (PARTITION BY concept_id) >= 2 THEN greatest(1, least(test - 1, floor(0.5::DOUBLE * test + 0.5))) ELSE 0 END::BIGINT AS held FROM t)
    SELECT concept_id, unit_id, y, CASE WHEN rk <= held THEN 'held' WHEN rk <= test THEN 'select' ELSE 'train' END AS part FROM q""",
)
def d9(spark, sf):
    rows = unit_labels(spark, sf).select(
        (F.col("unit_id") % 3).alias("concept_id"), "unit_id", (F.col("concept_id") == 3).cast("int").alias("y")
    )
    out = S.stratified_assignment(rows, keys=["concept_id"], test_fraction=0.2, held_out_fraction=0.5, seed="42")
    return out.select("concept_id", "unit_id", "y", "part")


# The exact stratified split of every concept, written densely for the SQL engine.
SPLIT = """
base AS (SELECT vec_id AS unit_id, label, md5('42:' || vec_id) AS h FROM embeddings),
pos AS ({positives}),
conc AS (SELECT DISTINCT {keys} FROM pos),
cu AS (SELECT c.*, b.unit_id, b.h, (p.unit_id IS NOT NULL) AS y
       FROM conc c CROSS JOIN base b LEFT JOIN pos p ON p.unit_id = b.unit_id AND {keymatch}),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, y ORDER BY h, unit_id::VARCHAR) AS rk,
             count(*) OVER (PARTITION BY {keys}, y) AS n FROM cu),
t AS (SELECT *, greatest(1, least(n - 1, floor(0.2::DOUBLE * n + 0.5)))::BIGINT AS test FROM r),
q AS (SELECT *, greatest(1, least(test - 1, floor(0.5::DOUBLE * test + 0.5)))::BIGINT AS held FROM t),
ok AS (SELECT {keys}, count(*) FILTER (y) AS n_positives, count(*) AS n_total FROM cu GROUP BY {keys}),
parts AS (SELECT q.*, CASE WHEN rk <= held THEN 'held' WHEN rk <= test THEN 'select' ELSE 'train' END AS part FROM q),
pf AS (SELECT p.*, f.feature_idx, f.act FROM parts p JOIN feats f USING (unit_id) WHERE part <> 'train'),
rk2 AS (SELECT *, rank() OVER (PARTITION BY {keys}, part, feature_idx ORDER BY act)
          + (count(*) OVER (PARTITION BY {keys}, part, feature_idx, act) - 1) / 2.0 AS ar FROM pf),
agg AS (SELECT {keys}, part, feature_idx, sum(ar) FILTER (y) AS rs, count(*) FILTER (y)::DOUBLE AS np,
               count(*) FILTER (NOT y)::DOUBLE AS nn FROM rk2 GROUP BY {keys}, part, feature_idx),
sc AS (SELECT {keys}, part, feature_idx, (rs - np * (np + 1) / 2) / (np * nn) AS raw FROM agg),
w AS (SELECT {skeys}, s.feature_idx, s.raw AS raw_s, h.raw AS raw_h FROM sc s JOIN sc h
      ON {selfmatch} AND s.feature_idx = h.feature_idx AND s.part = 'select' AND h.part = 'held'),
best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY {keys}
         ORDER BY round(greatest(raw_s, 1 - raw_s), 12) DESC, feature_idx) = 1),
rep AS (SELECT {bkeys}, n_positives, n_total, feature_idx AS best_feature_idx,
               greatest(raw_s, 1 - raw_s) AS single_feature_auroc, raw_s >= 0.5 AS fwd,
               CASE WHEN raw_s >= 0.5 THEN raw_h ELSE 1 - raw_h END AS held_out_auroc
        FROM best JOIN ok USING ({keys}))
"""


def split_sql(positives: str, keys: list[str]) -> str:
    return SPLIT.format(
        positives=positives,
        keys=", ".join(keys),
        skeys=", ".join(f"s.{k}" for k in keys),
        bkeys=", ".join(f"best.{k}" for k in keys),
        keymatch=" AND ".join(f"p.{k} = c.{k}" for k in keys),
        selfmatch=" AND ".join(f"s.{k} = h.{k}" for k in keys),
    )


REAL_POSITIVES = "SELECT label AS concept_id, vec_id AS unit_id FROM embeddings"
REAL = "WITH " + DENSE + split_sql(REAL_POSITIVES, ["concept_id"])

# One penalized logistic fit per concept on standardized vectors, by accelerated gradient steps
# of all concepts at once (lists are vectors), then the rank-sum score of its test rows.
MULTIVARIATE = """,
xs AS (SELECT p.concept_id, p.unit_id, p.y::INT AS y, p.part, e.embedding::DOUBLE[] AS x FROM parts p JOIN embeddings e ON e.vec_id = p.unit_id),
st AS (SELECT concept_id, list(m ORDER BY j) AS m, list(s ORDER BY j) AS s, any_value(n) AS n FROM (
         SELECT concept_id, j, avg(x[j]) AS m, stddev_pop(x[j]) AS s, count(*) AS n FROM xs, unnest(range(1, 65)) AS d(j)
         WHERE part = 'train' GROUP BY concept_id, j) GROUP BY concept_id),
zs AS MATERIALIZED (SELECT xs.concept_id, unit_id, y, part, list_transform(range(1, 65), lambda j: (x[j] - m[j]) / s[j]) AS z FROM xs JOIN st USING (concept_id)),
zt AS MATERIALIZED (SELECT concept_id, unit_id, y, z FROM zs WHERE part = 'train'),
size AS (SELECT concept_id, 1 + 0.0025::DOUBLE * count(*) * 64 AS l, 0.0025::DOUBLE * count(*) AS lb FROM zt GROUP BY concept_id),
fit AS (
  SELECT 0 AS it, concept_id, list_transform(range(64), lambda j: 0.0::DOUBLE) AS w, list_transform(range(64), lambda j: 0.0::DOUBLE) AS v,
         0.0::DOUBLE AS b, 0.0::DOUBLE AS vb FROM size
  UNION ALL
  SELECT it + 1, concept_id, nw, list_transform(range(1, 65), lambda j: nw[j] + 0.8 * (nw[j] - w[j])), nb, nb + 0.8 * (nb - b)
  FROM (
    SELECT concept_id, any_value(it) AS it, any_value(w) AS w, any_value(b) AS b,
           list(vj - (vj + 0.01 * g) / l ORDER BY j) AS nw, any_value(vb - 0.01 * se / lb) AS nb
    FROM (
      SELECT concept_id, j, any_value(it) AS it, any_value(w) AS w, any_value(b) AS b, any_value(v[j]) AS vj, any_value(vb) AS vb,
             sum(e * z[j]) AS g, sum(e) AS se
      FROM (SELECT f.*, z, 1 / (1 + exp(-(list_dot_product(z, v) + vb))) - y AS e FROM fit f JOIN zt USING (concept_id)) r, unnest(range(1, 65)) AS d(j)
      GROUP BY concept_id, j) q JOIN size USING (concept_id)
    GROUP BY concept_id)
  WHERE it < 200),
mv AS (
  SELECT concept_id, (sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
           / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE AS multivariate_auroc
  FROM (SELECT concept_id, y, rank() OVER (PARTITION BY concept_id ORDER BY sc) + (count(*) OVER (PARTITION BY concept_id, sc) - 1) / 2.0 AS ar
        FROM (SELECT concept_id, y, round(list_dot_product(z, w), 10) AS sc FROM zs JOIN (SELECT * FROM fit WHERE it = 200) USING (concept_id) WHERE part <> 'train'))
  GROUP BY concept_id)
"""
RECURSIVE = REAL.replace("WITH", "WITH RECURSIVE", 1)

REPORT_COLUMNS = """concept_id, n_positives, n_total, best_feature_idx,
 round(single_feature_auroc, 6) + 0.0 AS single_feature_auroc, round(held_out_auroc, 6) + 0.0 AS held_out_auroc,
 round(single_feature_auroc - held_out_auroc, 6) + 0.0 AS auroc_inflation"""


def _report(spark, sf, config=CONFIG):
    features, labels = dense_features(spark, sf), unit_labels(spark, sf)
    return P.probe_concepts(features, labels.select("unit_id"), labels, config)


def _report_columns(report, extra=()):
    return report.select(
        "concept_id",
        "n_positives",
        "n_total",
        "best_feature_idx",
        r6(F.col("single_feature_auroc"), "single_feature_auroc"),
        r6(F.col("held_out_auroc"), "held_out_auroc"),
        r6(F.col("auroc_inflation"), "auroc_inflation"),
        *extra,
    )


@query("d13_multivariate_auroc", RECURSIVE + MULTIVARIATE + "SELECT concept_id, round(multivariate_auroc, 6) + 0.0 AS multivariate_auroc FROM mv")
def d13(spark, sf):
    features, labels = dense_features(spark, sf), unit_labels(spark, sf)
    context = P.prepare(features, labels.select("unit_id"), CONFIG)
    split = S.split_positives(labels, context.ranked, context.pool, keys=["concept_id"], **context.fractions)
    return P.multivariate_auroc(context, split).select("concept_id", r6(F.col("multivariate_auroc"), "multivariate_auroc"))


@query(
    "d14_multivariate_report",
    RECURSIVE + MULTIVARIATE + "SELECT " + REPORT_COLUMNS + """, round(multivariate_auroc, 6) + 0.0 AS multivariate_auroc,
    NULL::VARCHAR AS multivariate_reason FROM rep JOIN mv USING (concept_id)""",
)
def d14_multivariate(spark, sf):
    report = _report(spark, sf, replace(CONFIG, multivariate=True))
    extra = [r6(F.col("multivariate_auroc"), "multivariate_auroc"), "multivariate_reason"]
    return _report_columns(report, extra)


@query("d14_probe_report", REAL + "SELECT " + REPORT_COLUMNS + " FROM rep")
def d14(spark, sf):
    return _report_columns(_report(spark, sf))


@query(
    "d10_held_out_auroc",
    REAL + "SELECT concept_id, best_feature_idx, fwd AS positive_direction, "
    "round(held_out_auroc, 6) + 0.0 AS held_out_auroc FROM rep",
)
def d10(spark, sf):
    return _report(spark, sf).select(
        "concept_id", "best_feature_idx", "positive_direction", r6(F.col("held_out_auroc"), "held_out_auroc")
    )


@query(
    "d12_auroc_inflation",
    REAL + "SELECT concept_id, round(single_feature_auroc - held_out_auroc, 6) + 0.0 AS auroc_inflation FROM rep",
)
def d12(spark, sf):
    return _report(spark, sf).select("concept_id", r6(F.col("auroc_inflation"), "auroc_inflation"))


@query(
    "d16_report_summary",
    REAL
    + """SELECT count(*) AS n_concepts, count(*) FILTER (single_feature_auroc >= 0.7) AS n_above,
    round(avg((single_feature_auroc >= 0.7)::INT), 6) + 0.0 AS fraction_above,
    round(avg(single_feature_auroc), 6) AS mean_single_feature_auroc, round(avg(held_out_auroc), 6) AS mean_held_out_auroc,
    round(avg(single_feature_auroc - held_out_auroc), 6) + 0.0 AS mean_auroc_inflation,
    round(max(single_feature_auroc), 6) AS max_single_feature_auroc, count(held_out_auroc) AS n_held_out,
    round(avg((single_feature_auroc >= 0.65)::INT), 6) + 0.0 AS fraction_above_65, round(avg((single_feature_auroc >= 0.70)::INT), 6) + 0.0 AS fraction_above_70,
    round(avg((single_feature_auroc >= 0.75)::INT), 6) + 0.0 AS fraction_above_75, round(avg((single_feature_auroc >= 0.80)::INT), 6) + 0.0 AS fraction_above_80
    FROM rep""",
)
def d16(spark, sf):
    s = P.report_summary(_report(spark, sf), threshold=0.7, draws=0).drop("n_hard_negative", "mean_hard_negative_auroc", "mean_multivariate_auroc")
    counts = ["n_concepts", "n_above", "n_held_out"]
    return s.select(*counts, *[r6(F.col(c), c) for c in s.columns if c not in counts])


@query(
    "d16_inflation_interval",
    REAL + ", inf AS (SELECT 1 AS one, best_feature_idx, single_feature_auroc - held_out_auroc AS auroc_inflation FROM rep),"
    + boot_sql("inf", ["one"], "auroc_inflation", 50)
    + " SELECT round(ci_lo, 6) + 0.0 AS ci_lo, round(ci_hi, 6) + 0.0 AS ci_hi, n_clusters FROM boot",
)
def d16_interval(spark, sf):
    s = P.report_summary(materialize(_report(spark, sf)), draws=50)
    return s.select(
        r6(F.col("inflation_ci_lo"), "ci_lo"), r6(F.col("inflation_ci_hi"), "ci_hi"), F.col("inflation_n_clusters").alias("n_clusters")
    )


@query(
    "d16_top_results",
    REAL
    + "SELECT concept_id, best_feature_idx, round(single_feature_auroc, 6) + 0.0 AS single_feature_auroc FROM rep "
    "ORDER BY rep.single_feature_auroc DESC, concept_id LIMIT 5",
)
def d16_top(spark, sf):
    return P.top_results(_report(spark, sf), 5).select(
        "concept_id", "best_feature_idx", r6(F.col("single_feature_auroc"), "single_feature_auroc")
    )


@query(
    "d4_eligible_concepts",
    """SELECT label AS concept_id, count(*) AS n_labels FROM embeddings GROUP BY label HAVING count(*) >= 45
    ORDER BY n_labels DESC, concept_id LIMIT 6""",
)
def d4(spark, sf):
    return P.eligible_concepts(unit_labels(spark, sf), min_positives=45, max_concepts=6)


@query(
    "c1_label_vector_counts",
    """SELECT label AS concept_id, count(*) AS n_pos, (SELECT count(*) FROM embeddings) - count(*) AS n_neg
    FROM embeddings GROUP BY label""",
)
def c1(spark, sf):
    labels = unit_labels(spark, sf)
    n = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = labels.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_pos"))
    return counts.withColumn("n_neg", n - F.col("n_pos"))


PERM = """
lab AS (SELECT vec_id AS unit_id, label AS concept_id FROM embeddings),
draws AS (SELECT unnest(range(0, {draws})) AS draw),
recv AS (SELECT unit_id, row_number() OVER (ORDER BY md5('42:receiver:' || unit_id), unit_id) AS slot FROM lab),
give AS (SELECT draw, unit_id, row_number() OVER (PARTITION BY draw
           ORDER BY md5('42:giver:' || draw || ':' || unit_id), draw, unit_id) AS slot FROM lab, draws),
moved AS (SELECT g.draw, r.unit_id, l.concept_id FROM give g JOIN recv r USING (slot) JOIN lab l ON l.unit_id = g.unit_id),
"""


@query(
    "d18_permute_labels",
    "WITH " + PERM.format(draws=3) + "z AS (SELECT 1) SELECT draw::INT AS draw, unit_id, concept_id FROM moved",
)
def d18(spark, sf):
    return S.permute_labels(unit_labels(spark, sf), draws=3, seed="42")


def _perm_report(draws: int) -> str:
    return (
        "WITH "
        + DENSE
        + PERM.format(draws=draws)
        + split_sql("SELECT draw, concept_id, unit_id FROM moved", ["draw", "concept_id"])
        + ", real AS (WITH "
        + split_sql(REAL_POSITIVES, ["concept_id"])
        + "SELECT * FROM rep)"
    )


def _real_and_permuted(spark, sf, draws):
    features, labels = dense_features(spark, sf), unit_labels(spark, sf)
    context = P.prepare(features, labels.select("unit_id"), CONFIG)
    return P.real_and_permuted(context, labels, draws=draws)


@query(
    "d19_decompose_single_draw",
    _perm_report(1)
    + """ SELECT r.concept_id, round(r.single_feature_auroc - r.held_out_auroc, 6) + 0.0 AS real_inflation,
    round(p.single_feature_auroc - p.held_out_auroc, 6) + 0.0 AS permuted_inflation,
    round((r.single_feature_auroc - r.held_out_auroc) - (p.single_feature_auroc - p.held_out_auroc), 6) + 0.0
      AS confounding_estimate FROM real r JOIN rep p USING (concept_id)""",
)
def d19(spark, sf):
    real, permuted = _real_and_permuted(spark, sf, 1)
    out = P.decompose(real, permuted.where(F.col("draw") == 0))
    return out.select("concept_id", *[r6(F.col(c), c) for c in out.columns[1:]])


@query(
    "d20_decompose_draws",
    _perm_report(4)
    + """, j AS (SELECT r.concept_id, r.single_feature_auroc - r.held_out_auroc AS re,
        p.single_feature_auroc - p.held_out_auroc AS pe FROM real r JOIN rep p USING (concept_id))
    SELECT concept_id, round(first(re), 6) + 0.0 AS real_inflation, round(avg(pe), 6) + 0.0 AS mean_permuted_inflation,
      round(quantile_cont(pe, 0.025), 6) + 0.0 AS permuted_lo, round(quantile_cont(pe, 0.975), 6) + 0.0 AS permuted_hi,
      round(avg(re - pe), 6) + 0.0 AS mean_confounding, round(quantile_cont(re - pe, 0.025), 6) + 0.0 AS confounding_lo,
      round(quantile_cont(re - pe, 0.975), 6) + 0.0 AS confounding_hi, count(*) AS n_seeds
    FROM j WHERE re IS NOT NULL AND pe IS NOT NULL GROUP BY concept_id""",
)
def d20(spark, sf):
    real, permuted = _real_and_permuted(spark, sf, 4)
    out = P.decompose_draws(real, permuted)
    return out.select("concept_id", *[r6(F.col(c), c) for c in out.columns[1:-1]], "n_seeds")


@query(
    "c12_real_vs_permuted_join",
    _perm_report(1)
    + """ SELECT concept_id, r.best_feature_idx AS real_feature, p.best_feature_idx AS permuted_feature
    FROM real r JOIN rep p USING (concept_id)""",
)
def c12(spark, sf):
    real, permuted = _real_and_permuted(spark, sf, 1)
    return real.select("concept_id", F.col("best_feature_idx").alias("real_feature")).join(
        permuted.select("concept_id", F.col("best_feature_idx").alias("permuted_feature")), "concept_id"
    )


SUBSAMPLE_POS = """SELECT concept_id, target, repeat, unit_id FROM (
   SELECT label AS concept_id, vec_id AS unit_id, t.target, row_number() OVER (PARTITION BY label, t.target
     ORDER BY md5('42:{r}:' || vec_id), vec_id) AS o, {r} AS repeat
   FROM embeddings, (SELECT unnest([10, 20]) AS target) t WHERE label = 3) WHERE o <= target"""


def _subsample_sql(repeats: int) -> str:
    keys = ["concept_id", "target", "repeat"]
    parts = []
    for r in range(repeats):
        body = split_sql(SUBSAMPLE_POS.format(r=r), keys).replace("md5('42:' || vec_id)", f"md5('42:{r}:' || vec_id)")
        parts.append(f"(WITH {body} SELECT * FROM rep)")
    return "WITH " + DENSE + "allrep AS (" + " UNION ALL ".join(parts) + ")"


@query(
    "d17_controlled_subsampling",
    _subsample_sql(2)
    + """ SELECT concept_id, target, count(*) AS n_repeats_successful,
    (SELECT count(*) FROM embeddings WHERE label = 3) AS n_natural_positives,
    round(avg(single_feature_auroc), 6) + 0.0 AS mean_single_feature_auroc,
    round(avg(held_out_auroc), 6) + 0.0 AS mean_held_out_auroc,
    round(avg(single_feature_auroc - held_out_auroc), 6) + 0.0 AS mean_auroc_inflation,
    round(quantile_cont(single_feature_auroc - held_out_auroc, 0.025), 6) + 0.0 AS inflation_lo,
    round(quantile_cont(single_feature_auroc - held_out_auroc, 0.975), 6) + 0.0 AS inflation_hi
    FROM allrep GROUP BY concept_id, target""",
)
def d17(spark, sf):
    labels = unit_labels(spark, sf)
    out = P.controlled_subsampling(
        dense_features(spark, sf),
        labels.select("unit_id"),
        labels.where(F.col("concept_id") == 3),
        CONFIG,
        targets=[10, 20],
        repeats=2,
    )
    rounded = [c for c in out.columns if c.startswith(("mean_", "inflation_"))]
    return out.select(
        "concept_id", "target", "n_repeats_successful", "n_natural_positives", *[r6(F.col(c), c) for c in rounded]
    )


AP = """concepts AS (SELECT DISTINCT label AS concept_id FROM embeddings),
    x AS (SELECT c.concept_id, feature_idx, act, (label = c.concept_id)::INT AS y FROM feats, concepts c),
    b AS (SELECT concept_id, feature_idx, act, sum(y) AS tp, count(*) AS n FROM x GROUP BY ALL),
    k AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY concept_id, feature_idx) AS np
          FROM b WINDOW w AS (PARTITION BY concept_id, feature_idx ORDER BY act DESC))
    SELECT concept_id, feature_idx, round(sum(tp * (ctp / cn::DOUBLE)) / first(np), 6) + 0.0 AS average_precision
    FROM k GROUP BY concept_id, feature_idx"""


@query("d21_average_precision", "WITH " + DENSE + AP)
def d21(spark, sf):
    ap = A.average_precision(dense_features(spark, sf), unit_labels(spark, sf), _n(spark, sf))
    return ap.select("concept_id", "feature_idx", r6(F.col("average_precision"), "average_precision"))


@query("d21_sparse_average_precision", "WITH " + SPARSE + AP)
def d21_sparse(spark, sf):
    ap = A.average_precision(sparse_features(spark, sf), unit_labels(spark, sf), _n(spark, sf), every=True)
    return ap.select("concept_id", "feature_idx", r6(F.col("average_precision"), "average_precision"))


@query(
    "d22_sparse_f1_mcc",
    "WITH " + SPARSE + """concepts AS (SELECT DISTINCT label AS concept_id FROM embeddings),
    x AS (SELECT c.concept_id, feature_idx, act > 0.1 AS p, label = c.concept_id AS y FROM feats, concepts c),
    m AS (SELECT concept_id, feature_idx, count(*) FILTER (p AND y)::DOUBLE AS tp, count(*) FILTER (p AND NOT y)::DOUBLE AS fp,
          count(*) FILTER (NOT p AND y)::DOUBLE AS fn, count(*) FILTER (NOT p AND NOT y)::DOUBLE AS tn FROM x GROUP BY ALL)
    SELECT concept_id, feature_idx, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1,
      CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 END AS mcc
    FROM m""",
)
def d22_sparse(spark, sf):
    out = A.threshold_metrics(sparse_features(spark, sf), unit_labels(spark, sf), _n(spark, sf), threshold=0.1, every=True)
    return out.select("concept_id", "feature_idx", r6(F.col("f1"), "f1"), r6(F.col("mcc"), "mcc"))


@query(
    "d22_f1_mcc",
    "WITH " + DENSE + """concepts AS (SELECT DISTINCT label AS concept_id FROM embeddings),
    x AS (SELECT c.concept_id, feature_idx, act > 0.1 AS p, label = c.concept_id AS y FROM feats, concepts c),
    m AS (SELECT concept_id, feature_idx, count(*) FILTER (p AND y)::DOUBLE AS tp, count(*) FILTER (p AND NOT y)::DOUBLE AS fp,
          count(*) FILTER (NOT p AND y)::DOUBLE AS fn, count(*) FILTER (NOT p AND NOT y)::DOUBLE AS tn FROM x GROUP BY ALL)
    SELECT concept_id, feature_idx, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1,
      round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc
    FROM m WHERE tp > 0""",
)
def d22(spark, sf):
    out = A.threshold_metrics(dense_features(spark, sf), unit_labels(spark, sf), _n(spark, sf), threshold=0.1)
    return out.select("concept_id", "feature_idx", r6(F.col("f1"), "f1"), r6(F.col("mcc"), "mcc"))


SELECTION = """tot AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
    rk AS (SELECT unit_id, feature_idx, rank() OVER (PARTITION BY feature_idx ORDER BY act)
             + (count(*) OVER (PARTITION BY feature_idx, act) - 1) / 2.0 AS r FROM feats),
    pr AS (SELECT draw, concept_id, feature_idx, sum(r) AS rs, count(*)::DOUBLE AS np
           FROM moved JOIN rk USING (unit_id) GROUP BY ALL),
    a AS (SELECT draw, concept_id, (rs - np * (np + 1) / 2) / (np * (n - np)) AS raw FROM pr, tot),
    d AS (SELECT draw, concept_id, max(greatest(raw, 1 - raw)) AS mx, avg(greatest(raw, 1 - raw)) AS mn FROM a GROUP BY ALL)
    SELECT concept_id, count(*) AS n_draws, round(avg(mx), 6) AS mean_of_max, round(avg(mn), 6) AS mean_of_mean,
      round(avg(mx) - avg(mn), 6) AS inflation_above_null,
      round(stddev_samp(mx), 6) AS sd_of_max, round(quantile_cont(mx, 0.025), 6) AS max_lo, round(quantile_cont(mx, 0.975), 6) AS max_hi FROM d GROUP BY concept_id"""


@query("d23_selection_inflation", "WITH " + DENSE + PERM.format(draws=3) + SELECTION)
def d23(spark, sf):
    moved = S.permute_labels(unit_labels(spark, sf), draws=3, seed="42")
    out = P.selection_inflation(dense_features(spark, sf), moved, _n(spark, sf))
    return out.select("concept_id", "n_draws", *[r6(F.col(c), c) for c in out.columns[2:]])


@query("d23_sparse_selection_inflation", "WITH " + SPARSE + PERM.format(draws=3) + SELECTION)
def d23_sparse(spark, sf):
    moved = S.permute_labels(unit_labels(spark, sf), draws=3, seed="42")
    out = P.selection_inflation(sparse_features(spark, sf), moved, _n(spark, sf))
    return out.select("concept_id", "n_draws", *[r6(F.col(c), c) for c in out.columns[2:]])


# Every (draw, concept, feature) triple with its three scores, then the levels of each score.
METRIC_SELECTION = """tot AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
    dc AS (SELECT DISTINCT draw, concept_id FROM moved),
    x AS (SELECT dc.draw, dc.concept_id, f.feature_idx, f.act, (m.unit_id IS NOT NULL)::INT AS y
          FROM dc CROSS JOIN feats f LEFT JOIN moved m ON m.draw = dc.draw AND m.concept_id = dc.concept_id AND m.unit_id = f.unit_id),
    b AS (SELECT draw, concept_id, feature_idx, act, sum(y) AS tp, count(*) AS n FROM x GROUP BY ALL),
    k AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY draw, concept_id, feature_idx) AS np
          FROM b WINDOW w AS (PARTITION BY draw, concept_id, feature_idx ORDER BY act DESC)),
    ap AS (SELECT 'average_precision' AS metric, draw, concept_id, feature_idx, sum(tp * (ctp / cn::DOUBLE)) / first(np) AS v FROM k GROUP BY ALL),
    t4 AS (SELECT draw, concept_id, feature_idx, count(*) FILTER (act > 0.1 AND y = 1)::DOUBLE AS tp, count(*) FILTER (act > 0.1 AND y = 0)::DOUBLE AS fp,
             count(*) FILTER (act <= 0.1 AND y = 1)::DOUBLE AS fn, count(*) FILTER (act <= 0.1 AND y = 0)::DOUBLE AS tn FROM x GROUP BY ALL),
    f1 AS (SELECT 'f1' AS metric, draw, concept_id, feature_idx, 2 * tp / (2 * tp + fp + fn) AS v FROM t4),
    mcc AS (SELECT 'mcc' AS metric, draw, concept_id, feature_idx,
              CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0.0::DOUBLE ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS v FROM t4),
    d AS (SELECT metric, draw, concept_id, max(v) AS mx, avg(v) AS mn FROM (SELECT * FROM ap UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM mcc) GROUP BY ALL)
    SELECT metric, concept_id, count(*) AS n_draws, round(avg(mx), 6) + 0.0 AS mean_of_max, round(avg(mn), 6) + 0.0 AS mean_of_mean,
      round(avg(mx) - avg(mn), 6) + 0.0 AS inflation_above_null, round(stddev_samp(mx), 6) + 0.0 AS sd_of_max,
      round(quantile_cont(mx, 0.025), 6) + 0.0 AS max_lo, round(quantile_cont(mx, 0.975), 6) + 0.0 AS max_hi FROM d GROUP BY metric, concept_id"""


def _metric_inflation(spark, sf, features):
    moved = materialize(S.permute_labels(unit_labels(spark, sf), draws=3, seed="42"))
    levels = [
        P.selection_inflation(features, moved, _n(spark, sf), metric=m, threshold=0.1).withColumn("metric", F.lit(m))
        for m in P.METRICS[1:]
    ]
    out = levels[0].unionByName(levels[1]).unionByName(levels[2])
    numbers = [c for c in out.columns if c not in ("metric", "concept_id", "n_draws")]
    return out.select("metric", "concept_id", "n_draws", *[r6(F.col(c), c) for c in numbers])


@query("d23_metric_inflation", "WITH " + DENSE + PERM.format(draws=3) + METRIC_SELECTION)
def d23_metrics(spark, sf):
    return _metric_inflation(spark, sf, dense_features(spark, sf))


@query("d23_sparse_metric_inflation", "WITH " + SPARSE + PERM.format(draws=3) + METRIC_SELECTION)
def d23_sparse_metrics(spark, sf):
    return _metric_inflation(spark, sf, sparse_features(spark, sf))
