"""Vector, encoding and inspection queries on ``embeddings``.

The 256-feature dictionary is a closed-form model parameter, identical in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import auroc as A
from attestor.operators import inspect as I
from attestor.operators import vectors as V
from attestor.session import fresh_path, materialize
from attestor.sources import activations as ACT
from attestor.workload.catalog import query, r6, table, unit_labels, vectors

D_SAE, K = 256, 8
B_DEC = [0.01] * 64

E = """
e AS (SELECT vec_id AS unit_id, label, embedding::DOUBLE[] AS vec FROM embeddings),
dict AS (SELECT f AS feature_idx, list_transform(range(0, 64), lambda d: sin(0.37 * (f + 1) * (d + 1))) AS w
         FROM (SELECT unnest(range(0, 256)) AS f)),
h AS (SELECT unit_id, feature_idx, list_dot_product(list_transform(vec, lambda x: x - 0.01::DOUBLE), w) AS h FROM e, dict),
enc AS (SELECT unit_id, feature_idx::INT AS feature_idx, h AS act FROM h
        QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY h DESC, feature_idx) <= 8 AND h > 0),
"""
FLAT = """x AS (SELECT unit_id, label, unnest(range(0, 64))::INT AS dim, unnest(vec) AS v FROM e),
mean AS (SELECT dim, avg(v) AS m FROM x GROUP BY dim),
nrm AS (SELECT unit_id, sqrt(sum((v - m) * (v - m))) AS n FROM x JOIN mean USING (dim) GROUP BY unit_id),
sc AS (SELECT avg(n) AS scale FROM nrm),
"""


def dictionary_table(spark):
    dims = F.sequence(F.lit(0), F.lit(63))
    f = F.col("id")
    w = F.transform(dims, lambda d: F.sin(F.lit(0.37) * (f + 1) * (d + 1)))
    return spark.range(D_SAE).select(
        f.cast("int").alias("feature_idx"), w.alias("w_enc"), F.lit(0.0).alias("b_enc"), w.alias("w_dec")
    )


def _dictionary(spark):
    return V.Dictionary(V.unit_rows(dictionary_table(spark)), B_DEC)


def encoded(spark, sf):
    return V.topk_encode(vectors(spark, sf), _dictionary(spark), K)


@query(
    "b22_topk_encode",
    "WITH " + E + "z AS (SELECT 1) SELECT unit_id, feature_idx, round(act, 6) + 0.0 AS act FROM enc",
)
def b22(spark, sf):
    return encoded(spark, sf).select("unit_id", "feature_idx", r6(F.col("act"), "act"))


@query(
    "b22_gapped_dictionary",
    "WITH " + E + "z AS (SELECT 1) SELECT unit_id, (feature_idx * 37 + 5)::INT AS feature_idx, round(act, 6) + 0.0 AS act FROM enc",
)
def b22_gapped(spark, sf):
    """The same dictionary under ids with gaps, applied in blocks of a few features."""
    spaced = V.unit_rows(dictionary_table(spark)).withColumn("feature_idx", (F.col("feature_idx") * 37 + 5).cast("int"))
    out = V.topk_encode(vectors(spark, sf), V.Dictionary(spaced, B_DEC, max_bytes=50_000), K)
    return out.select("unit_id", "feature_idx", r6(F.col("act"), "act"))


RECON = """
wn AS (SELECT feature_idx, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS wd FROM dict),
dec AS (SELECT unit_id, dim, sum(act * wv) AS s FROM (
          SELECT unit_id, act, unnest(range(0, 64))::INT AS dim, unnest(wd) AS wv FROM enc JOIN wn USING (feature_idx))
        GROUP BY unit_id, dim),
hat AS (SELECT x.unit_id, x.label, x.dim, x.v, coalesce(s, 0) + 0.01::DOUBLE AS hat FROM x LEFT JOIN dec USING (unit_id, dim)),
"""


@query(
    "b23_decode",
    "WITH " + E + FLAT + RECON + "z AS (SELECT 1) SELECT unit_id, dim, round(hat, 6) + 0.0 AS value FROM hat",
)
def b23(spark, sf):
    units = vectors(spark, sf)
    rebuilt = V.decode(encoded(spark, sf), units, _dictionary(spark))
    return rebuilt.select("unit_id", F.posexplode("vec").alias("dim", "v")).select(
        "unit_id", "dim", r6(F.col("v"), "value")
    )


@query(
    "b24_unit_decoder_rows",
    """SELECT vec_id AS unit_id, i AS dim, round(v / greatest(sqrt(list_dot_product(vec, vec)), 1e-8), 6) + 0.0 AS value
    FROM (SELECT vec_id, vec, unnest(range(0, 64))::INT AS i, unnest(vec) AS v
          FROM (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings))""",
)
def b24(spark, sf):
    rows = vectors(spark, sf).select(F.col("unit_id").alias("feature_idx"), F.col("vec").alias("w_dec"))
    return V.unit_rows(rows).select(
        F.col("feature_idx").alias("unit_id"), F.posexplode("w_dec").alias("dim", "v")
    ).select("unit_id", "dim", r6(F.col("v"), "value"))


@query(
    "d1_norm_stats",
    "WITH " + E + FLAT + """z AS (SELECT 1) SELECT dim, round(m, 6) + 0.0 AS mean, round(scale, 6) AS scale,
    (SELECT count(*) FROM e) AS n_total FROM mean, sc""",
)
def d1(spark, sf):
    stats = V.norm_stats(vectors(spark, sf))
    return stats.select(F.posexplode("mean").alias("dim", "m"), "scale", "n_total").select(
        "dim", r6(F.col("m"), "mean"), r6(F.col("scale"), "scale"), "n_total"
    )


@query(
    "b21_normalize",
    "WITH " + E + FLAT + """z AS (SELECT 1) SELECT unit_id, dim, round((v - m) / greatest(scale, 1e-8), 6) + 0.0 AS value
    FROM x JOIN mean USING (dim), sc""",
)
def b21(spark, sf):
    rows = vectors(spark, sf)
    out = V.normalize(rows, materialize(V.norm_stats(rows)))
    return out.select("unit_id", F.posexplode("vec").alias("dim", "v")).select("unit_id", "dim", r6(F.col("v"), "value"))


def _recon_sql(by: str) -> str:
    group, names = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    cond = f"USING ({by})" if by else "ON true"
    return (
        "WITH " + E + FLAT + RECON
        + f"""s AS (SELECT {names} count(DISTINCT unit_id) AS n_samples, count(*) AS n_el, sum(v) AS sx, sum(v * v) AS sxx,
            sum((v - hat) * (v - hat)) AS sse FROM hat {group}),
        el AS (SELECT unit_id, label, (SELECT count(*) FROM enc WHERE enc.unit_id = e.unit_id) AS l0 FROM e),
        l AS (SELECT {names} avg(l0) AS mean_l0 FROM el {group}),
        fr AS (SELECT {names} feature_idx, count(*) AS c FROM enc JOIN e USING (unit_id) GROUP BY {names} feature_idx),
        al AS (SELECT {names} count(*) FILTER (c / n_samples::DOUBLE >= 0.001) AS alive FROM fr JOIN s {cond} {group})
        SELECT {names} n_samples, round(sse / n_el, 6) AS mse,
          round(1 - (sse / n_el) / ((sxx / n_el - (sx / n_el) * (sx / n_el)) * (n_el / (n_el - 1)::DOUBLE)), 6) AS frac_variance_explained,
          round(mean_l0, 6) AS mean_l0, round(mean_l0 / 256, 6) AS mean_l0_frac,
          round((256 - alive) / 256.0::DOUBLE, 6) AS dead_fraction
        FROM s JOIN l {cond} JOIN al {cond}"""
    )


def _metrics(spark, sf, by=None):
    rows = vectors(spark, sf)
    features = materialize(encoded(spark, sf))
    rebuilt = V.decode(features, rows, _dictionary(spark))
    out = V.reconstruction_metrics(rows, features, rebuilt, dictionary_table(spark), by=by)
    fixed = [c for c in out.columns if c in ("label", "n_samples")]
    return out.select(*fixed, *[r6(F.col(c), c) for c in out.columns if c not in fixed])


@query("d2_reconstruction_metrics", _recon_sql(""))
def d2(spark, sf):
    return _metrics(spark, sf)


@query("d3_reconstruction_by_group", _recon_sql("label"))
def d3(spark, sf):
    return _metrics(spark, sf, ["label"])


@query(
    "b25_token_mean_pooling",
    """WITH t AS (SELECT e.label AS unit_id, e.vec_id AS pos, e.embedding::DOUBLE[] AS vec FROM embeddings e),
    m AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY pos) AS a,
                 row_number() OVER (PARTITION BY unit_id ORDER BY pos DESC) AS b FROM t),
    x AS (SELECT unit_id, unnest(range(0, 64))::INT AS dim, unnest(vec) AS v FROM m WHERE a > 1 AND b > 1)
    SELECT unit_id, dim, round(avg(v), 6) + 0.0 AS value FROM x GROUP BY unit_id, dim""",
)
def b25(spark, sf):
    tokens = vectors(spark, sf).select(
        F.col("label").alias("unit_id"), F.col("unit_id").alias("pos"), F.lit(False).alias("is_pad"), "vec"
    )
    return V.pool_tokens(tokens).select("unit_id", F.posexplode("vec").alias("dim", "v")).select(
        "unit_id", "dim", r6(F.col("v"), "value")
    )


@query(
    "d6_sparse_feature_auroc",
    "WITH " + E + """concepts AS (SELECT DISTINCT label AS concept_id FROM embeddings),
    full_ AS (SELECT e.unit_id, e.label, d.feature_idx::INT AS feature_idx, coalesce(act, 0) AS act
              FROM e CROSS JOIN dict d LEFT JOIN enc ON enc.unit_id = e.unit_id AND enc.feature_idx = d.feature_idx),
    rk AS (SELECT label, feature_idx, rank() OVER (PARTITION BY feature_idx ORDER BY act)
             + (count(*) OVER (PARTITION BY feature_idx, act) - 1) / 2.0 AS r FROM full_),
    p AS (SELECT c.concept_id, feature_idx, sum(r) FILTER (label = c.concept_id) AS rs,
            count(*) FILTER (label = c.concept_id)::DOUBLE AS np, count(*)::DOUBLE AS n FROM rk, concepts c GROUP BY ALL),
    touched AS (SELECT DISTINCT label AS concept_id, feature_idx FROM enc JOIN e USING (unit_id))
    SELECT concept_id, feature_idx, round((rs - np * (np + 1) / 2) / (np * (n - np)), 6) + 0.0 AS raw_auroc
    FROM p JOIN touched USING (concept_id, feature_idx)""",
)
def d6_sparse(spark, sf):
    features = materialize(encoded(spark, sf))
    pairs = A.whole_set_auroc(features, unit_labels(spark, sf), vectors(spark, sf).count())
    return pairs.select("concept_id", "feature_idx", r6(F.col("raw_auroc"), "raw_auroc"))


@query(
    "d24_feature_profile",
    "WITH " + E + """z AS (SELECT 1) SELECT d.feature_idx::INT AS feature_idx, round(count(act) / (SELECT count(*) FROM e)::DOUBLE, 6) AS activation_rate,
    round(coalesce(max(act), 0), 6) AS max_activation, round(coalesce(avg(act), 0), 6) AS mean_activation_when_active
    FROM dict d LEFT JOIN enc ON enc.feature_idx = d.feature_idx GROUP BY d.feature_idx""",
)
def d24(spark, sf):
    out = I.feature_profile(encoded(spark, sf), dictionary_table(spark), vectors(spark, sf).count())
    return out.select("feature_idx", *[r6(F.col(c), c) for c in out.columns[1:]])


@query(
    "f1_top_units",
    "WITH " + E + """full_ AS (SELECT e.unit_id, d.feature_idx::INT AS feature_idx, coalesce(act, 0) AS act
       FROM e CROSS JOIN (SELECT DISTINCT feature_idx FROM enc) d LEFT JOIN enc USING (unit_id, feature_idx))
    SELECT feature_idx, unit_id, round(act, 6) + 0.0 AS act, (row_number() OVER w)::INT AS rank FROM full_
    WINDOW w AS (PARTITION BY feature_idx ORDER BY act DESC, unit_id) QUALIFY row_number() OVER w <= 15""",
)
def f1(spark, sf):
    out = I.top_units(materialize(encoded(spark, sf)), vectors(spark, sf), k=15)
    return out.select("feature_idx", "unit_id", r6(F.col("act"), "act"), "rank")


@query(
    "f2_feature_column_subset",
    "WITH " + E + "z AS (SELECT 1) SELECT unit_id, feature_idx, round(act, 6) + 0.0 AS act FROM enc WHERE feature_idx IN (3, 40, 200)",
)
def f2(spark, sf):
    out = V.topk_encode(vectors(spark, sf), _dictionary(spark), K, features=[3, 40, 200])
    return out.select("unit_id", "feature_idx", r6(F.col("act"), "act"))


@query(
    "f3_active_features",
    "WITH " + E + """z AS (SELECT 1) SELECT unit_id, feature_idx, round(act, 6) + 0.0 AS act, (row_number() OVER w)::INT AS rank
    FROM enc WINDOW w AS (PARTITION BY unit_id ORDER BY act DESC, feature_idx) QUALIFY row_number() OVER w <= 5""",
)
def f3(spark, sf):
    return I.active_features(encoded(spark, sf), limit=5).select("unit_id", "feature_idx", r6(F.col("act"), "act"), "rank")


@query(
    "f9_most_positive_concept",
    """SELECT label AS concept_id, count(*) AS n_positives FROM embeddings GROUP BY label
    ORDER BY n_positives DESC, concept_id LIMIT 1""",
)
def f9(spark, sf):
    return I.most_positive_concept(unit_labels(spark, sf))


@query(
    "a17_activation_round_trip",
    """SELECT vec_id AS unit_id, (vec_id % 4)::INT AS shard_id, len(embedding)::INT AS n_dims,
    round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings""",
)
def a17(spark, sf):
    path = fresh_path(spark, "activations")
    rows = vectors(spark, sf).select(
        "unit_id", F.col("vec").cast("array<float>").alias("vec"), (F.col("unit_id") % 4).cast("int").alias("shard_id")
    )
    ACT.write_shard(rows, path)
    ACT.write_shard(rows.where(F.col("shard_id") == 2), path)  # a rewrite replaces one shard only
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return ACT.read_vectors(spark, path).select(
        "unit_id", F.col("shard_id").cast("int").alias("shard_id"), F.size("vec").alias("n_dims"), r6(total, "total")
    )


@query(
    "a18_full_scan_normalized",
    "WITH " + E + FLAT + """z AS (SELECT 1) SELECT unit_id, round(sum((v - m) / greatest(scale, 1e-8)), 6) + 0.0 AS total
    FROM x JOIN mean USING (dim), sc GROUP BY unit_id""",
)
def a18(spark, sf):
    rows = vectors(spark, sf)
    out = V.normalize(rows, materialize(V.norm_stats(rows)))
    return out.select("unit_id", r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), "total"))


@query(
    "a19_lookup_in_order",
    """SELECT (row_number() OVER (ORDER BY vec_id DESC) - 1)::INT AS pos, vec_id AS unit_id,
    round(embedding[1]::DOUBLE, 6) + 0.0 AS first_value FROM embeddings""",
)
def a19(spark, sf):
    rows = vectors(spark, sf)
    top = rows.agg(F.max("unit_id").alias("m")).scalar()
    asked = rows.select((top - F.col("unit_id")).cast("int").alias("pos"), "unit_id")
    return ACT.lookup_table(rows, asked).select("pos", "unit_id", r6(F.col("vec")[0], "first_value"))


@query(
    "a20_dataset_stats",
    "SELECT count(*) AS n_rows, max(len(embedding))::INT AS n_dims, count(DISTINCT vec_id % 4) AS n_shards FROM embeddings",
)
def a20(spark, sf):
    return ACT.dataset_stats(vectors(spark, sf).withColumn("shard_id", F.col("unit_id") % 4))


@query(
    "a28_contiguous_slices",
    """SELECT vec_id AS unit_id, floor((row_number() OVER (ORDER BY vec_id) - 1)
      / ceil((SELECT count(*) FROM embeddings) / 7.0))::INT AS slice_id FROM embeddings""",
)
def a28(spark, sf):
    from attestor.operators.splits import contiguous_slices

    return contiguous_slices(vectors(spark, sf).select("unit_id"), key="unit_id", n_slices=7)


@query(
    "f5_strided_sample",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders),
    n AS (SELECT count(*) AS n FROM orders),
    want AS (SELECT DISTINCT floor(i * (n / 1000.0::DOUBLE))::BIGINT AS r FROM n, (SELECT unnest(range(0, 1000)) AS i))
    SELECT o_orderkey FROM o JOIN want USING (r)""",
)
def f5(spark, sf):
    return I.strided_sample(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey", at_most=1000)


@query("f6_first_by_id", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def f6(spark, sf):
    return I.first_by_key(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey", n=100)
