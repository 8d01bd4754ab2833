"""Readers applied to text files that Spark writes from the given tables first."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators import genome as GN
from attestor.operators import intervals as IV
from attestor.operators import probing as P
from attestor.session import fresh_path, materialize
from attestor.sources import genomics as G
from attestor.sources import proteins as PR
from attestor.sources import results as RES
from attestor.workload.catalog import query, r6, table



def as_text(df: DataFrame, line: Column, extension: str) -> str:
    """Write one line per row to a new folder of text files and return its path."""
    path = fresh_path(df.sparkSession, f"text-{extension}")
    df.select(line.alias("value")).write.text(path)
    return path


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


DNA_SQL = "translate(md5(text) || md5(text || 'x') || md5(text || 'y'), '0123456789abcdef', 'ACGTACGTACGTACGN')"


def dna() -> Column:
    seed = F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("x"))), F.md5(F.concat("text", F.lit("y"))))
    return F.translate(seed, "0123456789abcdef", "ACGTACGTACGTACGN")


# ---------------------------------------------------------------- proteins


FASTA = """fa AS (SELECT 'P' || doc_id AS unit_id, regexp_replace(upper(md5(text) || substr(md5(text || 'x'), 1, doc_id % 40)), '[^ACDEFGHIKLMNPQRSTVWY]', 'X', 'g') AS sequence FROM documents)"""


def _fasta(spark, sf):
    seq = F.concat(F.md5("text"), F.expr("substr(md5(concat(text, 'x')), 1, int(doc_id % 40))"))
    docs = table(spark, sf, "documents").withColumn("s", seq)
    # wrapped lines: the body is cut after 20 characters
    return as_text(
        docs, _cat(">sp|P", F.col("doc_id"), "|GENE a > b\n", F.substring("s", 1, 20), "\n", F.expr("substr(s, 21)")), "fasta"
    )


@query("a1_fasta_scan", "WITH " + FASTA + " SELECT unit_id, sequence FROM fa WHERE length(sequence) <= 60")
def a1(spark, sf):
    return PR.read_fasta(spark, _fasta(spark, sf), max_length=60)


GAF = """gaf AS (SELECT 'P' || l_suppkey AS unit_id, CASE WHEN l_linenumber = 3 THEN 'NOT|enables' ELSE '' END AS qualifier, 'GO:' || (l_partkey % 200) AS concept_id,
  ['EXP', 'IDA', 'IEA', 'TAS'][l_quantity::BIGINT % 4 + 1] AS evidence, ['P', 'F', 'C'][l_linenumber % 3 + 1] AS aspect FROM lineitem)"""


def _gaf(spark, sf):
    evidence = F.element_at(F.array(*[F.lit(e) for e in ("EXP", "IDA", "IEA", "TAS")]), (F.col("l_quantity").cast("bigint") % 4 + 1).cast("int"))
    aspect = F.element_at(F.array(*[F.lit(a) for a in "PFC"]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    qualifier = F.when(F.col("l_linenumber") == 3, F.lit("NOT|enables")).otherwise(F.lit(""))
    line = F.concat_ws(
        "\t", F.lit("UniProtKB"), _cat("P", F.col("l_suppkey")), F.lit("SYM"), qualifier, _cat("GO:", F.col("l_partkey") % 200),
        F.lit("REF"), evidence, F.lit(""), aspect, F.lit("desc"),
    )
    return as_text(table(spark, sf, "lineitem"), line, "gaf")


@query("a3_annotation_scan", "WITH " + GAF + " SELECT DISTINCT unit_id, concept_id FROM gaf WHERE qualifier = '' AND evidence IN ('EXP', 'IDA') AND aspect IN ('F', 'C')")
def a3(spark, sf):
    return PR.read_annotations(spark, _gaf(spark, sf), evidence=["EXP", "IDA"], aspects=["F", "C"])


@query("a4_annotation_id_filter", "WITH " + GAF + " SELECT DISTINCT unit_id, concept_id FROM gaf WHERE qualifier = '' AND unit_id IN (SELECT 'P' || s_suppkey FROM supplier WHERE s_nationkey < 8)")
def a4(spark, sf):
    units = table(spark, sf, "supplier").where(F.col("s_nationkey") < 8).select(F.concat(F.lit("P"), "s_suppkey").alias("unit_id"))
    return PR.read_annotations(spark, _gaf(spark, sf), units=units)


def _obo(spark, sf):
    nations = table(spark, sf, "nation").select(
        _cat("[Term]\nid: GO:1", F.col("n_nationkey"), "\nname: ", F.col("n_name"), "\nalt_id: GO:9", F.col("n_nationkey"),
             "\nis_a: GO:7", F.col("n_regionkey"), " ! region\n").alias("line")
    )
    regions = table(spark, sf, "region").select(_cat("[Term]\nid: GO:7", F.col("r_regionkey"), "\nname: ", F.col("r_name"), "\n").alias("line"))
    return as_text(nations.unionByName(regions).coalesce(1), F.col("line"), "obo")


@query(
    "a5_ontology_names",
    "SELECT 'GO:1' || n_nationkey AS concept_id, n_name AS name FROM nation UNION ALL SELECT 'GO:9' || n_nationkey, n_name FROM nation UNION ALL SELECT 'GO:7' || r_regionkey, r_name FROM region",
)
def a5(spark, sf):
    return PR.read_concept_names(spark, _obo(spark, sf))


@query(
    "a6_ontology_edges",
    "SELECT a.id AS concept_id, 'GO:1' || b.n_nationkey AS sibling_id FROM (SELECT 'GO:1' || n_nationkey AS id, n_regionkey FROM nation UNION ALL SELECT 'GO:9' || n_nationkey, n_regionkey FROM nation) a JOIN nation b USING (n_regionkey) WHERE a.id <> 'GO:1' || b.n_nationkey",
)
def a6(spark, sf):
    edges, aliases = PR.read_concept_edges(spark, _obo(spark, sf))
    return P.siblings_of(edges, aliases)


# ---------------------------------------------------------------- genes, elements, genome


SPAN = """sp AS (SELECT event_id, 'u' || user_id AS chrom, floor(epoch(ts))::BIGINT - 1704067200 AS s, floor(epoch(ts))::BIGINT - 1704067200 + 1 + floor(value * 600)::BIGINT AS e, event_type FROM events)"""


def _spans(spark, sf):
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("u"), "user_id").alias("chrom"), start.alias("s"), (start + 1 + F.floor(F.col("value") * 600)).alias("e"), "event_type"
    )


@query(
    "a7_gene_scan",
    "WITH " + SPAN + """ SELECT 'G' || event_id || '.2' AS gene_id, chrom, s AS start, e AS "end", '+' AS strand FROM sp WHERE event_type = 'view'""",
)
def a7(spark, sf):
    kind = F.when(F.col("event_type") == "view", F.lit("gene")).otherwise(F.lit("transcript"))
    attributes = _cat('other_gene_id "X"; gene_id "G', F.col("event_id"), '.2"; level 2;')
    line = F.concat_ws("\t", "chrom", F.lit("S"), kind, (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    return G.read_genes(spark, as_text(_spans(spark, sf), line, "gtf"))


@query(
    "a9_element_scan",
    "WITH " + SPAN + """ SELECT chrom, s AS start, e AS "end", 'E' || event_id AS accession, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN event_type ELSE event_type || '|CTCF-bound' END AS classes FROM sp""",
)
def a9(spark, sf):
    classes = F.when(F.col("event_id") % 4 == 0, F.lit("")).when(F.col("event_id") % 4 == 1, F.col("event_type")).otherwise(
        _cat(F.col("event_type"), ",CTCF-bound,", F.col("event_type"))
    )
    line = F.concat_ws(
        "\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), _cat("E", F.col("event_id")), F.lit("0"), F.lit("."),
        F.col("s").cast("string"), F.col("e").cast("string"), F.lit("0"), classes, F.lit("x"),
    )
    out = G.read_elements(spark, as_text(_spans(spark, sf), line, "bed"))
    return out.select("chrom", "start", "end", "accession", F.array_join("classes", "|").alias("classes"))


def _genome(spark, sf):
    docs = table(spark, sf, "documents").withColumn("d", dna())
    path = as_text(docs, _cat(">c", F.col("doc_id"), " from text\n", F.substring("d", 1, 60), "\n", F.expr("substr(d, 61)")), "fa")
    return materialize(G.read_genome(spark, path, chunk=32))


GENOME = f"gn AS (SELECT 'c' || doc_id AS chrom, {DNA_SQL} AS seq FROM documents)"


@query("a30_genome_chunks", "WITH " + GENOME + ", k AS (SELECT chrom, seq, unnest([0, 32, 64]) AS chunk_start FROM gn) SELECT chrom, chunk_start::BIGINT AS chunk_start, substr(seq, chunk_start + 1, 32) AS seq FROM k")
def a30(spark, sf):
    return _genome(spark, sf)


@query(
    "b7_window_sequences",
    "WITH " + GENOME + ", t AS (SELECT chrom, seq, unnest(range(0, 57, 8)) AS s FROM gn) SELECT chrom || ':' || s || '-' || (s + 40) AS window_id, substr(seq, s + 1, 40) AS sequence FROM t",
)
def b7(spark, sf):
    genome = _genome(spark, sf)
    tiles = IV.tile_chromosomes(G.chrom_lengths(genome), size=40, stride=8)
    return GN.window_sequences(tiles, genome, chunk=32).select("window_id", "sequence")


@query(
    "f12_n_gated_tiles",
    "WITH " + GENOME + """, t AS (SELECT chrom, seq, unnest(range(0, 57, 8)) AS s FROM gn), w AS (SELECT chrom || ':' || s || '-' || (s + 40) AS window_id, substr(seq, s + 1, 40) AS q FROM t)
    SELECT window_id FROM w WHERE (length(q) - length(replace(q, 'N', ''))) / 40.0::DOUBLE <= 0.05::DOUBLE""",
)
def f12_gate(spark, sf):
    genome = _genome(spark, sf)
    tiles = IV.tile_chromosomes(G.chrom_lengths(genome), size=40, stride=8)
    return GN.gate_windows(tiles, genome, max_n=0.05, chunk=32).select("window_id")


ALLELES = """lc AS (SELECT 'v' || doc_id AS locus, 'c' || doc_id AS chrom, (doc_id % 100 + 1)::BIGINT AS pos, ['A', 'C', 'G', 'T'][doc_id % 4 + 1] AS ref,
   ['C', 'G', 'T', 'A', 'AT'][doc_id % 5 + 1] AS alt FROM documents),
  aw AS (SELECT lc.*, seq, pos - 1 - 10 AS ws FROM lc JOIN gn USING (chrom)),
  ap AS (SELECT *, CASE WHEN length(alt) <> 1 THEN 'not a single-nucleotide substitution' WHEN ws < 0 THEN 'too close to the chromosome start'
     WHEN ws + 20 > 96 THEN 'too close to the chromosome end' WHEN substr(seq, pos, 1) <> ref THEN 'reference base is ' || substr(seq, pos, 1) || ', call says ' || ref END AS problem FROM aw)"""


def _loci(spark, sf):
    key = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    return table(spark, sf, "documents").select(
        _cat("v", key).alias("locus"), _cat("c", key).alias("chrom"), (key % 100 + 1).alias("pos"),
        pick(["A", "C", "G", "T"], 4).alias("ref"), pick(["C", "G", "T", "A", "AT"], 5).alias("alt"),
    )


@query(
    "b9_allele_windows",
    "WITH " + GENOME + "," + ALLELES + """ SELECT locus, problem, CASE WHEN problem IS NULL THEN ws END AS window_start, CASE WHEN problem IS NULL THEN substr(seq, ws + 1, 20) END AS ref_seq,
    CASE WHEN problem IS NULL THEN substr(seq, ws + 1, 10) || alt || substr(seq, ws + 12, 9) END AS alt_seq FROM ap""",
)
def b9(spark, sf):
    genome = _genome(spark, sf)
    out = GN.allele_windows(_loci(spark, sf), genome, G.chrom_lengths(genome), size=20, chunk=32)
    return out.select("locus", "problem", "window_start", "ref_seq", "alt_seq")


@query(
    "b12_haplotype_sequences",
    "WITH " + GENOME + """, ed AS (SELECT doc_id, seq, doc_id % 90 AS o, substr(seq, doc_id % 90 + 1, 1) AS ref, chrom FROM gn JOIN documents ON chrom = 'c' || doc_id)
    SELECT chrom AS locus, sample_id, haplotype, CASE WHEN haplotype = (doc_id + sample_id) % 2 AND ref <> 'N' AND sample_id < 2 THEN substr(seq, 1, o) || 'T' || substr(seq, o + 2) ELSE seq END AS sequence
    FROM ed, (SELECT unnest([0, 1, 2]) AS sample_id) s, (SELECT unnest([0, 1]) AS haplotype) h""",
)
def b12(spark, sf):
    docs = table(spark, sf, "documents").withColumn("seq", dna())
    name = _cat("c", F.col("doc_id")).alias("locus")
    windows = docs.select(name, F.lit(0).cast("bigint").alias("window_start"), F.col("seq").alias("ref_seq"))
    samples = docs.select(name, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sample_id"))
    base = F.substring("seq", (F.col("doc_id") % 90 + 1).cast("int"), F.lit(1))
    # an N in the reference is called as A, which mismatches and stays as it is
    calls = docs.select(
        name, (F.col("doc_id") % 90 + 1).alias("pos"), F.when(base == "N", F.lit("A")).otherwise(base).alias("ref"), F.lit("T").alias("alt"),
        "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("sample_id"),
    ).select(
        "locus", "pos", "ref", "alt", "sample_id",
        ((F.col("doc_id") + F.col("sample_id")) % 2).cast("tinyint").alias("haplotype"), F.lit(1).cast("tinyint").alias("allele"),
    )
    return GN.haplotype_sequences(windows, samples, calls).withColumn("haplotype", F.col("haplotype").cast("int"))


# ---------------------------------------------------------------- chains and calls


@query(
    "a29_chain_blocks",
    "SELECT 'n' || n_nationkey AS src_chrom, unnest([1000, 1150]) AS src_start, unnest([1100, 1250]) AS src_end, 'n' || n_nationkey AS dst_chrom, unnest([500, 620]) AS dst_start FROM nation",
)
def a29(spark, sf):
    out = G.read_chain(spark, _chain(spark, sf))
    return out.select("src_chrom", "src_start", "src_end", "dst_chrom", "dst_start")


def _chain(spark, sf):
    n = _cat("n", F.col("n_nationkey"))
    line = _cat("chain 1 ", n, " 5000 + 1000 1250 ", n, " 9000 + 500 720 1\n100 50 20\n100\n")
    return as_text(table(spark, sf, "nation").coalesce(1), line, "chain")


@query(
    "b10_lift_positions",
    """WITH p AS (SELECT c_custkey, 'n' || c_nationkey AS chrom, 950 + c_custkey % 400 AS pos FROM customer)
    SELECT c_custkey, CASE WHEN pos BETWEEN 1001 AND 1100 THEN pos - 500 WHEN pos BETWEEN 1151 AND 1250 THEN pos - 530 END AS lifted_pos FROM p""",
)
def b10(spark, sf):
    asked = table(spark, sf, "customer").select(
        "c_custkey", _cat("n", F.col("c_nationkey")).alias("chrom"), (F.lit(950) + F.col("c_custkey") % 400).alias("pos")
    )
    return IV.lift_positions(asked, materialize(G.read_chain(spark, _chain(spark, sf)))).select("c_custkey", "lifted_pos")


VCF_SQL = """vc AS (SELECT p_partkey, (p_partkey % 5 + 1)::VARCHAR AS chrom, (p_partkey * 10)::BIGINT AS pos, CASE WHEN p_partkey % 9 = 0 THEN 'AC' ELSE 'A' END AS ref,
   CASE WHEN p_partkey % 7 = 0 THEN 'G,T' ELSE 'G' END AS alt FROM part),
  gt AS (SELECT vc.*, s AS sample_no, CASE WHEN (p_partkey + s) % 11 = 0 THEN NULL ELSE (p_partkey + s) % 2 END AS a, (p_partkey + s * 3) % 2 AS b FROM vc, (SELECT unnest([1, 2, 3, 4]) AS s))"""


def _vcf(spark, sf):
    key = F.col("p_partkey")
    calls = [
        _cat(F.when((key + s) % 11 == 0, F.lit(".")).otherwise(((key + s) % 2).cast("string")), "|", (key + s * 3) % 2, ":9") for s in (1, 2, 3, 4)
    ]
    line = F.concat_ws(
        "\t", (key % 5 + 1).cast("string"), (key * 10).cast("string"), F.lit("."), F.when(key % 9 == 0, F.lit("AC")).otherwise(F.lit("A")),
        F.when(key % 7 == 0, F.lit("G,T")).otherwise(F.lit("G")), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:DP"), *calls,
    )
    rows = table(spark, sf, "part").select(line.alias("line"))
    header = table(spark, sf, "region").agg(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\tS4").alias("line"))
    return as_text(header.unionByName(rows), F.col("line"), "vcf")


@query(
    "a10_variant_dosage",
    "WITH " + VCF_SQL + """ SELECT 'chr' || chrom || ':' || pos || ':' || ref || ':' || alt AS variant_id, 'S' || sample_no AS sample_id, (a + b)::INT AS dosage FROM gt
    WHERE alt = 'G' AND a IS NOT NULL AND p_partkey % 3 <> 0""",
)
def a10(spark, sf):
    wanted = table(spark, sf, "part").where(F.col("p_partkey") % 3 != 0).select(
        (F.col("p_partkey") % 5 + 1).cast("string").alias("chrom"), (F.col("p_partkey") * 10).alias("pos")
    )
    return G.read_dosage(spark, _vcf(spark, sf), wanted).select("variant_id", "sample_id", F.col("dosage").cast("int").alias("dosage"))


@query(
    "a11_window_calls",
    "WITH " + VCF_SQL + """, w AS (SELECT 'L' || s_suppkey AS locus, 'chr' || (s_suppkey % 6 + 1) AS chrom, s_suppkey * 150 AS s, s_suppkey * 150 + 400 AS e FROM supplier),
    l AS (SELECT 'chr' || chrom AS chrom, pos, sample_no, 0 AS haplotype, a AS allele FROM gt WHERE length(ref) = 1 AND alt = 'G' AND a IS NOT NULL
          UNION ALL SELECT 'chr' || chrom, pos, sample_no, 1, b FROM gt WHERE length(ref) = 1 AND alt = 'G' AND a IS NOT NULL)
    SELECT locus, pos, 'S' || sample_no AS sample_id, haplotype::INT AS haplotype, allele::INT AS allele FROM w LEFT JOIN l ON l.chrom = w.chrom AND pos - 1 >= s AND pos - 1 < e""",
)
def a11(spark, sf):
    key = F.col("s_suppkey")
    windows = table(spark, sf, "supplier").select(
        _cat("L", key).alias("locus"), _cat("chr", key % 6 + 1).alias("chrom"), (key * 150).alias("start"), (key * 150 + 400).alias("end")
    )
    out = G.read_window_calls(spark, _vcf(spark, sf), windows)
    return out.select("locus", "pos", "sample_id", F.col("haplotype").cast("int").alias("haplotype"), F.col("allele").cast("int").alias("allele"))


@query(
    "a13_expression_matrix",
    "SELECT 'G' || p_size AS gene_id, p_type AS sample_id, round(avg(p_retailprice), 4) AS value FROM part GROUP BY 1, 2",
)
def a13(spark, sf):
    parts = table(spark, sf, "part")
    types = sorted(r[0] for r in parts.select("p_type").distinct().collect())
    wide = parts.groupBy(_cat("G", F.col("p_size")).alias("TargetID")).pivot("p_type", types).agg(F.round(F.avg("p_retailprice"), 4))
    path = fresh_path(spark, "matrix")
    wide.write.option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)
    return G.read_expression(spark, path).where(F.col("value").isNotNull())


@query(
    "a14_candidate_loci",
    "SELECT 'rs' || p_partkey AS variant_id, 'chr' || (p_partkey % 22 + 1) AS chrom, (p_partkey * 100)::BIGINT AS pos, 'ENSG' || p_size || '.1' AS gene_id FROM part",
)
def a14(spark, sf):
    key = F.col("p_partkey")
    line = F.concat_ws(
        "\t", _cat("rs", key), F.lit("-"), _cat("ENSG", F.col("p_size"), ".1"), F.lit("p"), (key % 22 + 1).cast("string"), F.lit("1"),
        (key * 100).cast("string"), *[F.lit("0")] * 5,
    )
    return G.read_candidates(spark, as_text(table(spark, sf, "part"), line, "tsv"))


@query(
    "a21_sweep_loader",
    """SELECT [10, 20, 50, 100, 150, 200, 300][(l_linenumber - 1) % 7 + 1] AS min_positives, count(*) AS n, round(avg(0.5::DOUBLE + l_quantity / 100), 6) AS mean FROM lineitem GROUP BY 1""",
)
def a21(spark, sf):
    from attestor.workload.sweep_tables import sweep

    root = fresh_path(spark, "sweep")
    rows = sweep(spark, sf).select(
        "min_positives", F.col("concept_id").cast("string").alias("go_id"), "single_feature_auroc", F.col("best_feature_idx").cast("int").alias("best_feature_idx")
    )
    for point in sorted(r[0] for r in rows.select("min_positives").distinct().collect()):
        rows.where(F.col("min_positives") == point).drop("min_positives").write.json(f"{root}/mp{point}")
    out = RES.read_sweep(spark, root, multi_line=False)
    return out.groupBy("min_positives").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("single_feature_auroc"), "mean"))
