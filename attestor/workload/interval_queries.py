"""Interval queries on ``events``: chromosome = user, interval = [second, second + length)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import intervals as IV
from attestor.operators import probing as P
from attestor.session import fresh_path
from attestor.sources import results as RES
from attestor.workload.catalog import query, r6, table

MAX_CLAIMS = 67  # about as many as features have on average at sf0.01
DAY = 86400  # seconds; the origin is 2024-01-01

EV = """
ev AS (SELECT event_id, 'u' || user_id AS chrom, floor(epoch(ts))::BIGINT - 1704067200 AS s,
              floor(epoch(ts))::BIGINT - 1704067200 + 1 + floor(value * 600)::BIGINT AS e, event_type, value FROM events),
ch AS (SELECT chrom, max(e) AS length FROM ev GROUP BY chrom),
win AS (SELECT chrom || ':' || s || '-' || (s + 86400) AS window_id, chrom, s, s + 86400 AS e FROM (
          SELECT chrom, unnest(range(0, length - 86400 + 1, 43200)) AS s FROM ch WHERE length >= 86400)),
"""


def spans(spark, sf):
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id")).alias("chrom"),
        start.alias("start"),
        (start + 1 + F.floor(F.col("value") * 600)).alias("end"),
        "event_type",
        "value",
    )


def lengths(spark, sf):
    return spans(spark, sf).groupBy("chrom").agg(F.max("end").alias("length"))


def windows(spark, sf):
    return IV.tile_chromosomes(lengths(spark, sf), size=DAY, stride=DAY // 2)


def genes(spark, sf):
    return spans(spark, sf).select(
        F.concat(F.lit("G"), F.col("event_id"), F.lit(".3")).alias("gene_id"), "chrom", "start", "end"
    )


GENE = """gene AS (SELECT 'G' || event_id || '.3' AS gene_id, chrom, s, e FROM ev),
"""


@query(
    "f12_window_tiling",
    "WITH " + EV + 'z AS (SELECT 1) SELECT window_id, chrom, s AS start, e AS "end" FROM win',
)
def f12(spark, sf):
    return windows(spark, sf)


@query(
    "f13_gene_tiling",
    "WITH " + EV + GENE + """r AS (SELECT gene_id, g.chrom, greatest(0, s - 2000) AS lo, least(length, e + 2000) - 4096 AS last
       FROM gene g JOIN ch USING (chrom)),
    t AS (SELECT gene_id, chrom, unnest(range(lo, last + 1, 2048)) AS s FROM r WHERE last >= lo)
    SELECT gene_id || ':' || chrom || ':' || s || '-' || (s + 4096) AS window_id, chrom, s AS start, s + 4096 AS "end", gene_id FROM t""",
)
def f13(spark, sf):
    return IV.tile_genes(genes(spark, sf), lengths(spark, sf), size=4096, stride=2048)


@query(
    "c2_window_element_classes",
    "WITH " + EV + """z AS (SELECT 1) SELECT window_id, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS classes
    FROM win w LEFT JOIN ev ON ev.chrom = w.chrom AND w.s < ev.e AND w.e > ev.s GROUP BY window_id""",
)
def c2(spark, sf):
    elements = spans(spark, sf).select("chrom", "start", "end", F.array("event_type").alias("classes"))
    out = IV.label_windows(windows(spark, sf), elements)
    return out.select("window_id", F.array_join("classes", ",").alias("classes"))


@query(
    "c3_window_genes",
    "WITH " + EV + GENE + """z AS (SELECT 1) SELECT window_id, gene_id FROM win w
    LEFT JOIN gene g ON g.chrom = w.chrom AND w.s < g.e AND w.e > g.s""",
)
def c3(spark, sf):
    return IV.overlapping_genes(windows(spark, sf), genes(spark, sf))


@query(
    "c4_points_in_windows",
    "WITH " + EV + """z AS (SELECT 1) SELECT event_id, window_id FROM ev
    JOIN win w ON ev.chrom = w.chrom AND w.s <= ev.s AND ev.s < w.e""",
)
def c4(spark, sf):
    points = spans(spark, sf).select("event_id", "chrom", (F.col("start") + 1).alias("pos"))
    return IV.points_in_windows(points, windows(spark, sf)).select("event_id", "window_id")


@query(
    "c5_own_gene_labels",
    "WITH " + EV + GENE + """r AS (SELECT gene_id, g.chrom, greatest(0, s - 2000) AS lo, least(length, e + 2000) - 4096 AS last
       FROM gene g JOIN ch USING (chrom)),
    t AS (SELECT gene_id, chrom, unnest(range(lo, last + 1, 4096)) AS s FROM r WHERE last >= lo)
    SELECT gene_id || ':' || chrom || ':' || s || '-' || (s + 4096) AS unit_id, gene_id AS concept_id FROM t""",
)
def c5(spark, sf):
    return IV.own_gene_labels(IV.tile_genes(genes(spark, sf), lengths(spark, sf), size=4096, stride=4096))


@query(
    "c6_gene_id_remap",
    """WITH ext AS (SELECT DISTINCT 'S' || s_suppkey || '.' || (s_nationkey % 3) AS x FROM supplier),
    g AS (SELECT 'S' || n_nationkey || '.9' AS gene_id, n_name FROM nation),
    k AS (SELECT x, split_part(x, '.', 1) AS st, count(*) OVER (PARTITION BY split_part(x, '.', 1)) > 1 AS shares_stable_id FROM ext)
    SELECT x AS external_id, gene_id, n_name, shares_stable_id FROM k JOIN g ON st = split_part(gene_id, '.', 1)""",
)
def c6(spark, sf):
    external = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey"), F.lit("."), F.col("s_nationkey") % 3).alias("gene_id")
    )
    known = table(spark, sf, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey"), F.lit(".9")).alias("gene_id"), "n_name")
    return IV.remap_gene_ids(external, known).select("external_id", "gene_id", "n_name", "shares_stable_id")


CLAIM = """
top AS (SELECT window_id, w.chrom, count(*) AS c FROM win w JOIN ev ON ev.chrom = w.chrom AND w.s <= ev.s AND ev.s < w.e GROUP BY ALL),
evid AS (SELECT chrom AS feature_idx, window_id FROM top QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY c DESC, window_id) <= 10),
claims AS (SELECT 'u' || (substr(chrom, 2)::BIGINT + substr(split_part(gene_id, '.', 1), 2)::BIGINT % 12) AS feature_idx, gene_id FROM gene),
nc AS (SELECT feature_idx, count(*) AS n_claims FROM claims GROUP BY ALL),
m AS (SELECT DISTINCT ev2.feature_idx, ev2.window_id FROM evid ev2 JOIN win w USING (window_id)
      JOIN gene g ON g.chrom = w.chrom AND w.s < g.e AND w.e > g.s
      JOIN claims c ON c.feature_idx = ev2.feature_idx AND c.gene_id = g.gene_id),
nm AS (SELECT feature_idx, count(*) AS k FROM m GROUP BY ALL),
nw AS (SELECT feature_idx, count(*) AS n FROM evid GROUP BY ALL),
v AS (SELECT feature_idx, n_claims, coalesce(k, 0) AS k, n FROM nc LEFT JOIN nm USING (feature_idx) LEFT JOIN nw USING (feature_idx))
"""


def _claims_and_evidence(spark, sf):
    from pyspark.sql import Window

    points = spans(spark, sf).select("event_id", "chrom", (F.col("start") + 1).alias("pos"))
    counted = IV.points_in_windows(points, windows(spark, sf)).groupBy("chrom", "window_id").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("chrom").orderBy(F.col("c").desc(), "window_id")
    evidence = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 10).select(
        F.col("chrom").alias("feature_idx"), "window_id"
    )
    # every gene is claimed once, by the feature of its own chromosome or of one of the next eleven
    number = F.expr("cast(substr(substring_index(gene_id, '.', 1), 2) as bigint)")
    owner = F.expr("cast(substr(chrom, 2) as bigint)") + number % 12
    claims = genes(spark, sf).select(F.concat(F.lit("u"), owner).alias("feature_idx"), "gene_id")
    return claims, evidence


@query(
    "d37_genomic_verdicts",
    "WITH " + EV + GENE + CLAIM + """SELECT feature_idx, n_claims, k AS n_windows_matched,
      CASE WHEN n_claims > 67 THEN 'spurious' WHEN k / n::DOUBLE >= 0.5 THEN 'confirmed' WHEN k > 0 THEN 'plausible' ELSE 'spurious' END AS status,
      round(CASE WHEN n_claims > 67 THEN 0 ELSE coalesce(k / n::DOUBLE, 0) END, 6) + 0.0 AS match_rate FROM v""",
)
def d37(spark, sf):
    claims, evidence = _claims_and_evidence(spark, sf)
    out = IV.genomic_verdicts(claims, evidence, genes(spark, sf), max_claims=MAX_CLAIMS)
    return out.select("feature_idx", "n_claims", "n_windows_matched", "status", r6(F.col("match_rate"), "match_rate"))


EVIDENCE = """, wg AS (SELECT e.feature_idx, e.window_id, coalesce(string_agg(DISTINCT gene_id, '|' ORDER BY gene_id), '') AS genes
      FROM evid e JOIN win w USING (window_id) LEFT JOIN gene g ON g.chrom = w.chrom AND w.s < g.e AND w.e > g.s GROUP BY ALL),
    shown AS (SELECT feature_idx, string_agg(window_id || '=' || genes, ';' ORDER BY window_id) AS evidence FROM wg GROUP BY ALL)
"""


def _shown(evidence):
    return F.array_join(F.transform(evidence, lambda w: F.concat(w["window_id"], F.lit("="), F.array_join(w["genes"], "|"))), ";").alias("evidence")


@query(
    "d37_window_evidence",
    "WITH " + EV + GENE + CLAIM + EVIDENCE + "SELECT feature_idx, coalesce(evidence, '') AS evidence FROM nc LEFT JOIN shown USING (feature_idx)",
)
def d37_evidence(spark, sf):
    claims, evidence = _claims_and_evidence(spark, sf)
    return IV.genomic_verdicts(claims, evidence, genes(spark, sf), max_claims=MAX_CLAIMS).select("feature_idx", _shown(F.col("evidence")))


@query(
    "a25_evidence_per_window",
    "WITH " + EV + GENE + CLAIM + EVIDENCE + """SELECT feature_idx, round(CASE WHEN n_claims > 67 THEN 0 ELSE coalesce(k / n::DOUBLE, 0) END, 4) + 0.0 AS match_rate,
      coalesce(evidence, '') AS evidence FROM v LEFT JOIN shown USING (feature_idx)""",
)
def a25_windows(spark, sf):
    path = fresh_path(spark, "evidence")
    claims, evidence = _claims_and_evidence(spark, sf)
    RES.write_evidence(IV.genomic_verdicts(claims, evidence, genes(spark, sf), max_claims=MAX_CLAIMS), path)
    schema = "feature_idx STRING, match_rate DOUBLE, evidence ARRAY<STRUCT<window_id: STRING, genes: ARRAY<STRING>>>"
    return spark.read.schema(schema).json(path).select("feature_idx", "match_rate", _shown(F.col("evidence")))


@query(
    "c15_evidence_in_claimed_genes",
    "WITH " + EV + GENE + CLAIM + "SELECT feature_idx, coalesce(string_agg(window_id, '|' ORDER BY window_id), '') AS matched_windows "
    "FROM (SELECT feature_idx FROM v WHERE n_claims <= 67) LEFT JOIN m USING (feature_idx) GROUP BY feature_idx",
)
def c15(spark, sf):
    claims, evidence = _claims_and_evidence(spark, sf)
    out = IV.genomic_verdicts(claims, evidence, genes(spark, sf), max_claims=MAX_CLAIMS).where(F.col("n_claims") <= MAX_CLAIMS)
    return out.select("feature_idx", F.array_join("matched_windows", "|").alias("matched_windows"))


@query(
    "d5_status_tally",
    "WITH " + EV + GENE + CLAIM + """SELECT CASE WHEN n_claims > 67 THEN 'spurious' WHEN k / n::DOUBLE >= 0.5 THEN 'confirmed'
      WHEN k > 0 THEN 'plausible' ELSE 'spurious' END AS status, count(*) AS n FROM v GROUP BY ALL""",
)
def d5_status(spark, sf):
    claims, evidence = _claims_and_evidence(spark, sf)
    out = IV.genomic_verdicts(claims, evidence, genes(spark, sf), max_claims=MAX_CLAIMS)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g1_label_set_union",
    "WITH " + EV + """z AS (SELECT 1) SELECT w.chrom, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS classes
    FROM win w JOIN ev ON ev.chrom = w.chrom AND w.s < ev.e AND w.e > ev.s GROUP BY w.chrom""",
)
def g1(spark, sf):
    elements = spans(spark, sf).select("chrom", "start", "end", F.array("event_type").alias("classes"))
    labels = IV.window_labels(windows(spark, sf), elements)
    by_user = labels.withColumn("chrom", F.split_part("unit_id", F.lit(":"), F.lit(1)))
    return by_user.groupBy("chrom").agg(F.array_join(F.array_sort(F.collect_set("concept_id")), ",").alias("classes"))


@query(
    "c13_concept_siblings",
    """SELECT DISTINCT a.n_nationkey AS concept_id, b.n_nationkey AS sibling_id FROM nation a JOIN nation b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
)
def c13(spark, sf):
    return P.siblings_of(_edges(spark, sf))


def _edges(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("child_id"), F.col("n_regionkey").alias("parent_id"))


@query(
    "c14_hard_negatives",
    """SELECT s.a AS concept_id, count(*) AS n_hard_negatives FROM (SELECT a.n_nationkey AS a, b.n_nationkey AS b
      FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) s
    JOIN customer c ON c.c_nationkey = s.b GROUP BY s.a""",
)
def c14(spark, sf):
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("concept_id"))
    hard = P.hard_negatives(labels, _edges(spark, sf), labels)
    return hard.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_hard_negatives"))


@query(
    "d11_hard_negative_auroc",
    """WITH feats AS (SELECT c_custkey AS unit_id, 0 AS feature_idx, c_acctbal AS act FROM customer
      UNION ALL SELECT c_custkey, 1, (c_custkey % 97)::DOUBLE FROM customer
      UNION ALL SELECT c_custkey, 2, (length(c_mktsegment) * 10 + c_custkey % 7)::DOUBLE FROM customer),
    base AS (SELECT c_custkey AS unit_id, c_nationkey AS nk, md5('42:' || c_custkey) AS h FROM customer),
    conc AS (SELECT DISTINCT c_nationkey AS concept_id FROM customer),
    cu AS (SELECT concept_id, unit_id, h, nk, nk = concept_id AS y FROM conc CROSS JOIN base),
    r AS (SELECT *, row_number() OVER (PARTITION BY concept_id, y ORDER BY h, unit_id::VARCHAR) AS rk, count(*) OVER (PARTITION BY concept_id, y) AS n FROM cu),
    t AS (SELECT *, greatest(1, least(n - 1, floor(0.2::DOUBLE * n + 0.5)))::BIGINT AS test FROM r),
    q AS (SELECT *, greatest(1, least(test - 1, floor(0.5::DOUBLE * test + 0.5)))::BIGINT AS held FROM t),
    p AS (SELECT *, CASE WHEN rk <= held THEN 'held' WHEN rk <= test THEN 'select' ELSE 'train' END AS part FROM q),
    pf AS (SELECT p.*, feature_idx, act FROM p JOIN feats USING (unit_id) WHERE part <> 'train'),
    k AS (SELECT *, rank() OVER (PARTITION BY concept_id, part, feature_idx ORDER BY act)
            + (count(*) OVER (PARTITION BY concept_id, part, feature_idx, act) - 1) / 2.0 AS ar FROM pf),
    a AS (SELECT concept_id, part, feature_idx, sum(ar) FILTER (y) AS rs, count(*) FILTER (y)::DOUBLE AS np, count(*) FILTER (NOT y)::DOUBLE AS nn FROM k GROUP BY ALL),
    sc AS (SELECT concept_id, feature_idx, (rs - np * (np + 1) / 2) / (np * nn) AS raw FROM a WHERE part = 'select'),
    best AS (SELECT concept_id, feature_idx, raw >= 0.5 AS fwd FROM sc
       QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY round(greatest(raw, 1 - raw), 12) DESC, feature_idx) = 1),
    hn AS (SELECT pf.*, fwd FROM pf JOIN best USING (concept_id, feature_idx)
           WHERE part = 'held' AND (y OR nk IN (SELECT b.n_nationkey FROM nation a JOIN nation b USING (n_regionkey)
                 WHERE a.n_nationkey = pf.concept_id AND b.n_nationkey <> a.n_nationkey))),
    hk AS (SELECT *, rank() OVER (PARTITION BY concept_id ORDER BY act) + (count(*) OVER (PARTITION BY concept_id, act) - 1) / 2.0 AS hr FROM hn),
    ha AS (SELECT concept_id, first(fwd) AS fwd, sum(hr) FILTER (y) AS rs, count(*) FILTER (y)::DOUBLE AS np, count(*) FILTER (NOT y) AS nn FROM hk GROUP BY concept_id),
    hr2 AS (SELECT *, (rs - np * (np + 1) / 2) / (np * nn) AS raw FROM ha)
    SELECT concept_id, feature_idx AS best_feature_idx, nn AS n_hard_negatives,
      round(CASE WHEN nn >= 10 THEN CASE WHEN hr2.fwd THEN raw ELSE 1 - raw END END, 6) + 0.0 AS hard_negative_held_out_auroc
    FROM hr2 JOIN best USING (concept_id)""",
)
def d11(spark, sf):
    customers = table(spark, sf, "customer")
    acts = F.array(
        F.col("c_acctbal"),
        (F.col("c_custkey") % 97).cast("double"),
        (F.length("c_mktsegment") * 10 + F.col("c_custkey") % 7).cast("double"),
    )
    features = customers.select(F.col("c_custkey").alias("unit_id"), F.posexplode(acts).alias("feature_idx", "act"))
    labels = customers.select(F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("concept_id"))
    out = P.probe_concepts(
        features, labels.select("unit_id"), labels, P.ProbeConfig(min_positives=5), edges=_edges(spark, sf)
    )
    return out.select(
        "concept_id",
        "best_feature_idx",
        "n_hard_negatives",
        r6(F.col("hard_negative_held_out_auroc"), "hard_negative_held_out_auroc"),
    )
