"""String and sequence expressions on string columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import inspect as I
from attestor.operators import probing as P
from attestor.workload.catalog import query, r6, table


@query(
    "b1_chrom_prefix",
    """SELECT s_suppkey, CASE WHEN starts_with(c, 'chr') THEN c ELSE 'chr' || c END AS chrom
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'chr' ELSE '' END || (s_nationkey + 1) AS c FROM supplier)""",
)
def b1(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", T.prefixed_chrom(_chrom()).alias("chrom"))


def _chrom():
    return F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit("chr")).otherwise(F.lit("")), (F.col("s_nationkey") + 1).cast("string"))


@query("b2_chrom_bare", "SELECT s_suppkey, (s_nationkey + 1)::VARCHAR AS chrom FROM supplier")
def b2(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", T.bare_chrom(_chrom()).alias("chrom"))


@query("b3_stable_id", "SELECT page_id, split_part(url, '.', 1) AS stable_id FROM pages")
def b3(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.stable_gene_id(F.col("url")).alias("stable_id"))


@query(
    "b4_sanitize_residues",
    "SELECT doc_id, md5(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g')) AS digest FROM documents",
)
def b4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.sanitize_residues(F.col("text"))).alias("digest"))


@query(
    "b5_n_fraction_gate",
    """SELECT doc_id, round(f, 6) + 0.0 AS n_fraction, f <= 0.05 AS passes FROM (
      SELECT doc_id, (length(text) - length(translate(text, 'Nn', ''))) / length(text)::DOUBLE AS f FROM documents)""",
)
def b5(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", r6(T.n_fraction(F.col("text")), "n_fraction"), T.passes_n_threshold(F.col("text"), 0.05).alias("passes")
    )


@query(
    "b6_window_id_round_trip",
    """SELECT p_partkey, replace(p_name, ' ', ':') || ':' || p_size || '-' || (p_size + 100) AS window_id,
      replace(p_name, ' ', ':') AS chrom, p_size::BIGINT AS start, (p_size + 100)::BIGINT AS "end" FROM part""",
)
def b6(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey",
        T.window_id(F.replace("p_name", F.lit(" "), F.lit(":")), F.col("p_size"), F.col("p_size") + 100).alias("window_id"),
    )
    return parts.withColumn("w", T.parse_window_id(F.col("window_id"))).where(F.col("w").isNotNull()).select(
        "p_partkey", "window_id", "w.chrom", "w.start", "w.end"
    )


@query(
    "b8_snv_validation",
    """WITH a AS (SELECT c_custkey, substr(c_mktsegment, 1, 1 + (c_custkey % 5 = 0)::INT) AS ref, substr(upper(md5(c_name)), 3, 1) AS alt FROM customer)
    SELECT c_custkey, CASE WHEN length(ref) <> 1 OR length(alt) <> 1 THEN 'not a single-nucleotide substitution'
      WHEN NOT (regexp_matches(upper(ref), '^[ACGT]$') AND regexp_matches(upper(alt), '^[ACGT]$')) THEN 'non-ACGT allele' END AS problem FROM a""",
)
def b8(spark, sf):
    ref = F.expr("substr(c_mktsegment, 1, 1 + int(c_custkey % 5 = 0))")
    alt = F.substring(F.upper(F.md5("c_name")), 3, 1)
    return table(spark, sf, "customer").select("c_custkey", T.snv_problem(ref, alt).alias("problem"))


@query(
    "b11_genotype_dosage",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN '.' ELSE (l_partkey % 2)::VARCHAR END
       || CASE WHEN l_suppkey % 3 = 0 THEN '|' ELSE '/' END || (l_suppkey % 2)::VARCHAR || ':35' AS call FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, call, CASE WHEN starts_with(call, '.') THEN NULL
      ELSE (substr(call, 1, 1) <> '0')::INT + (substr(call, 3, 1) <> '0')::INT END AS dosage FROM g""",
)
def b11(spark, sf):
    call = F.concat(
        F.when(F.col("l_partkey") % 11 == 0, F.lit(".")).otherwise((F.col("l_partkey") % 2).cast("string")),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("|")).otherwise(F.lit("/")),
        (F.col("l_suppkey") % 2).cast("string"),
        F.lit(":35"),
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", call.alias("call"))
    return rows.withColumn("dosage", T.genotype_dosage(F.col("call")).cast("int"))


@query(
    "a2_header_accession",
    """WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'sp|P' || s_suppkey || '|GENE Some name'
       WHEN s_suppkey % 3 = 1 THEN s_name || ' other' ELSE s_name || '|x y' END AS header FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'P' || s_suppkey ELSE split_part(split_part(header, ' ', 1), '|', 1) END AS accession FROM h""",
)
def a2(spark, sf):
    key = F.col("s_suppkey")
    header = (
        F.when(key % 3 == 0, F.concat(F.lit("sp|P"), key, F.lit("|GENE Some name")))
        .when(key % 3 == 1, F.concat(F.col("s_name"), F.lit(" other")))
        .otherwise(F.concat(F.col("s_name"), F.lit("|x y")))
    )
    return table(spark, sf, "supplier").select("s_suppkey", T.accession(header).alias("accession"))


@query(
    "a8_gtf_attribute",
    "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name END AS gene_id FROM part",
)
def a8(spark, sf):
    attributes = F.concat(
        F.lit('havana_gene_id "X'), F.col("p_brand"), F.lit('"; '),
        F.when(F.col("p_size") % 7 != 0, F.concat(F.lit('gene_id "'), F.col("p_name"), F.lit('"; '))).otherwise(F.lit("")),
        F.lit("level 2;"),
    )
    return table(spark, sf, "part").select("p_partkey", T.gtf_attribute(attributes, "gene_id").alias("gene_id"))


@query(
    "b29_evidence_present",
    """SELECT doc_id, coalesce(len(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)), 0) > 0 AS has_evidence
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def b29(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    listed = F.filter(
        F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()
    )
    present = F.when(F.col("quality").isNotNull(), listed)
    return docs.select("doc_id", T.has_evidence(present).alias("has_evidence"))


def text_corpus(spark, sf):
    """Labeled texts: id from the stable row key, one class label per row."""
    docs = table(spark, sf, "documents")
    code = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(32))
    return docs.select(
        F.concat(F.lit("text_"), F.col("doc_id")).alias("unit_id"),
        "text",
        code.alias("code"),
        F.concat(F.lit("class_"), code).alias("concept_id"),
    )


CORPUS = """corpus AS (SELECT 'text_' || doc_id AS unit_id, text, regexp_extract(source, '(\\d+)', 1)::INT % 32 AS code,
  'class_' || (regexp_extract(source, '(\\d+)', 1)::INT % 32) AS concept_id FROM documents)"""


@query("a15_labeled_texts", "WITH " + CORPUS + " SELECT unit_id, md5(text) AS digest, concept_id FROM corpus")
def a15(spark, sf):
    return text_corpus(spark, sf).select("unit_id", F.md5("text").alias("digest"), "concept_id")


@query("d5_class_counts", "WITH " + CORPUS + " SELECT concept_id, count(*) AS n FROM corpus GROUP BY concept_id")
def d5(spark, sf):
    return text_corpus(spark, sf).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a16_class_names",
    "WITH " + CORPUS + """ SELECT unit_id, CASE WHEN code < 10 THEN ['zero','one','two','three','four','five','six','seven','eight','nine'][code + 1]
    ELSE concept_id END AS class_name FROM corpus""",
)
def a16(spark, sf):
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    return text_corpus(spark, sf).select("unit_id", T.code_name(F.col("code"), names, F.col("concept_id")).alias("class_name"))


@query(
    "d15_text_concept_probe",
    """WITH src AS (SELECT doc_id, lang, n_chars, length(text) - length(replace(text, ' ', '')) AS spaces, length(text) - length(replace(text, 'e', '')) AS es FROM documents),
    feats AS (SELECT doc_id AS unit_id, 0 AS feature_idx, n_chars::DOUBLE AS act FROM src WHERE n_chars <> 0
      UNION ALL SELECT doc_id, 1, spaces::DOUBLE FROM src WHERE spaces <> 0 UNION ALL SELECT doc_id, 2, es::DOUBLE FROM src WHERE es <> 0
      UNION ALL SELECT doc_id, 3, es / greatest(n_chars, 1)::DOUBLE FROM src WHERE es <> 0),
    base AS (SELECT doc_id AS unit_id, lang, md5('42:' || doc_id) AS h FROM documents),
    conc AS (SELECT DISTINCT lang AS concept_id FROM documents),
    cu AS (SELECT concept_id, unit_id, h, lang = concept_id AS y FROM conc CROSS JOIN base),
    r AS (SELECT *, row_number() OVER (PARTITION BY concept_id, y ORDER BY h, unit_id::VARCHAR) AS rk, count(*) OVER (PARTITION BY concept_id, y) AS n FROM cu),
    t AS (SELECT *, greatest(1, least(n - 1, floor(0.2::DOUBLE * n + 0.5)))::BIGINT AS test FROM r),
    q AS (SELECT *, greatest(1, least(test - 1, floor(0.5::DOUBLE * test + 0.5)))::BIGINT AS held FROM t),
    p AS (SELECT *, CASE WHEN rk <= held THEN 'held' WHEN rk <= test THEN 'select' ELSE 'train' END AS part FROM q),
    pf AS (SELECT p.concept_id, p.unit_id, y, part, f.feature_idx, coalesce(act, 0) AS act FROM p CROSS JOIN (SELECT unnest([0,1,2,3]) AS feature_idx) f
           LEFT JOIN feats USING (unit_id, feature_idx) WHERE part <> 'train'),
    k AS (SELECT *, rank() OVER (PARTITION BY concept_id, part, feature_idx ORDER BY act)
            + (count(*) OVER (PARTITION BY concept_id, part, feature_idx, act) - 1) / 2.0 AS ar FROM pf),
    a AS (SELECT concept_id, part, feature_idx, sum(ar) FILTER (y) AS rs, count(*) FILTER (y)::DOUBLE AS np, count(*) FILTER (NOT y)::DOUBLE AS nn FROM k GROUP BY ALL),
    sc AS (SELECT concept_id, part, feature_idx, (rs - np * (np + 1) / 2) / (np * nn) AS raw FROM a),
    w AS (SELECT s.concept_id, s.feature_idx, s.raw AS rs, h.raw AS rh FROM sc s JOIN sc h USING (concept_id, feature_idx) WHERE s.part = 'select' AND h.part = 'held')
    SELECT concept_id, feature_idx AS best_feature_idx, round(greatest(rs, 1 - rs), 6) + 0.0 AS single_feature_auroc,
      round(CASE WHEN rs >= 0.5 THEN rh ELSE 1 - rh END, 6) + 0.0 AS held_out_auroc FROM w
    QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY round(greatest(rs, 1 - rs), 12) DESC, feature_idx) = 1""",
)
def d15(spark, sf):
    docs = table(spark, sf, "documents")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    es = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    acts = F.array(
        F.col("n_chars").cast("double"), spaces.cast("double"), es.cast("double"),
        es / F.greatest(F.col("n_chars"), F.lit(1)),
    )
    features = docs.select(F.col("doc_id").alias("unit_id"), F.posexplode(acts).alias("feature_idx", "act"))
    labels = docs.select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("concept_id"))
    out = P.probe_concepts(features, labels.select("unit_id"), labels, P.ProbeConfig(min_positives=10))
    return out.select(
        "concept_id",
        "best_feature_idx",
        r6(F.col("single_feature_auroc"), "single_feature_auroc"),
        r6(F.col("held_out_auroc"), "held_out_auroc"),
    )


@query(
    "c16_evidence_resolution",
    """SELECT d.doc_id // 10 AS feature_idx, count(*) FILTER (l.doc_id IS NOT NULL) AS n_found, count(*) FILTER (l.doc_id IS NULL) AS n_missing,
    coalesce(string_agg(CASE WHEN l.doc_id IS NULL THEN d.doc_id::VARCHAR END, ',' ORDER BY d.doc_id), '') AS missing
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def c16(spark, sf):
    from attestor.operators.registry import resolve_evidence

    # ten evidence ids per feature, as in a top-k list
    claims = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("feature_idx")).agg(
        F.array_sort(F.collect_list("doc_id")).alias("evidence")
    )
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id"))
    out = resolve_evidence(claims, known)
    return out.select(
        "feature_idx",
        F.size("found").cast("bigint").alias("n_found"),
        F.size("missing").cast("bigint").alias("n_missing"),
        F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"),
    )


@query(
    "g2_set_difference",
    "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
)
def g2(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("g3_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def g3(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_semi")


@query(
    "g4_distinct_sequences",
    "SELECT count(DISTINCT text) AS n_unique, count(*) AS n_total FROM documents",
)
def g4(spark, sf):
    # the digest stands for the text, so whole texts are not shuffled
    by_text = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return by_text.agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_total"))
