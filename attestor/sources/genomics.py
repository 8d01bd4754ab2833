"""Genes, regulatory elements, genome, chains and variant calls from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import genotype_dosage, gtf_attribute, prefixed_chrom, stable_gene_id
from attestor.operators.intervals import points_in_windows
from attestor.operators.ordering import running_totals
from attestor.session import materialize
from attestor.sources.proteins import file_order

CHUNK = 65536


def read_genes(spark: SparkSession, path: str, *, gene_ids: DataFrame | None = None) -> DataFrame:
    """Gene rows of an annotation file, 0-based half-open; optional filter on stable ids."""
    c = F.split("value", "\t")
    rows = (
        spark.read.text(path)
        .where(~F.col("value").startswith("#"))
        .select(c.alias("c"))
        .where((F.size("c") >= 9) & (F.col("c")[2] == "gene"))
        .select(
            gtf_attribute(F.col("c")[8], "gene_id").alias("gene_id"),
            F.col("c")[0].alias("chrom"),
            (F.col("c")[3].cast("bigint") - 1).alias("start"),
            F.col("c")[4].cast("bigint").alias("end"),
            F.col("c")[6].alias("strand"),
        )
        .where(F.col("gene_id").isNotNull())
    )
    if gene_ids is None:
        return rows
    wanted = gene_ids.select(stable_gene_id(F.col("gene_id")).alias("_stable")).distinct()
    keyed = rows.withColumn("_stable", stable_gene_id(F.col("gene_id")))
    return keyed.join(wanted, "_stable", "left_semi").drop("_stable")


def read_elements(spark: SparkSession, path: str, *, chroms: list[str] | None = None) -> DataFrame:
    """Regulatory elements of a BED 9+6 file with their class set."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)")).select(c.alias("c")).where(F.size("c") >= 4)
    listed = F.split(F.coalesce(F.get(F.col("c"), F.lit(9)), F.lit("")), ",")
    rows = rows.select(
        F.col("c")[0].alias("chrom"),
        F.col("c")[1].cast("bigint").alias("start"),
        F.col("c")[2].cast("bigint").alias("end"),
        F.col("c")[3].alias("accession"),
        F.array_distinct(F.filter(listed, lambda x: x != "")).alias("classes"),
    )
    return rows.where(F.col("chrom").isin(chroms)) if chroms else rows


# ---------------------------------------------------------------- genome


def read_genome(spark: SparkSession, path: str, *, chunk: int = CHUNK) -> DataFrame:
    """``genome(chrom, chunk_start, seq)``: fixed chunks of every sequence in a FASTA file.

    Line offsets are running totals over blocks of lines, so a chromosome is never one row
    or one task. Write the result once, partitioned by chromosome.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("line"), *file_order()
    ).where(F.length("line") > 0)
    lines = materialize(lines.withColumn("_bucket", F.struct("_block", F.floor(F.col("_row") / 65536).alias("part"))))
    head = F.col("line").startswith(">")
    placed = running_totals(
        lines,
        by=["_file"],
        bucket="_bucket",
        order=["_block", "_row"],
        totals={
            "_heads": head.cast("bigint"),
            "_bases": F.when(head, F.lit(0)).otherwise(F.length("line")).cast("bigint"),
        },
    )
    placed = materialize(placed.drop("_bucket"))
    names = placed.where(head).select(
        "_file",
        (F.col("_heads") + 1).alias("_heads"),
        F.split_part(F.regexp_replace("line", "^>", ""), F.lit(" "), F.lit(1)).alias("chrom"),
        F.col("_bases").alias("_start"),
    )
    body = placed.where(~head).join(names, ["_file", "_heads"])
    offset = F.col("_bases") - F.col("_start")
    body = body.select("chrom", "line", offset.alias("offset"))
    first, last = F.floor(F.col("offset") / chunk), F.floor((F.col("offset") + F.length("line") - 1) / chunk)
    pieces = body.withColumn("_c", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("offset"), F.col("_c") * chunk)
    high = F.least(F.col("offset") + F.length("line"), (F.col("_c") + 1) * chunk)
    pieces = pieces.select(
        "chrom",
        (F.col("_c") * chunk).alias("chunk_start"),
        low.alias("at"),
        F.substring(F.col("line"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("text"),
    )
    return pieces.groupBy("chrom", "chunk_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "").alias("seq")
    )


def load_genome(spark: SparkSession, path: str) -> DataFrame:
    """Chunk table written earlier; a missing path names the step that creates it."""
    try:
        return spark.read.schema("chunk_start BIGINT, seq STRING, chrom STRING").parquet(path)
    except Exception as error:
        raise FileNotFoundError(
            f"no genome table at {path}: build it once with read_genome(...).write.partitionBy('chrom').parquet(path)"
        ) from error


def write_genome(genome: DataFrame, path: str) -> None:
    genome.repartition("chrom", F.floor(F.col("chunk_start") / (CHUNK * 256))).write.partitionBy("chrom").mode("overwrite").parquet(path)


def chrom_lengths(genome: DataFrame) -> DataFrame:
    return genome.groupBy("chrom").agg(F.max(F.col("chunk_start") + F.length("seq")).alias("length"))


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Aligned blocks of a build-to-build chain file.

    A record is one chain; block starts are running sums of sizes and gaps along it.
    """
    raw = spark.read.option("lineSep", "\nchain ").text(path).select(
        F.regexp_replace("value", r"^(#[^\n]*\n)*\s*(chain )?", "").alias("text"), *file_order()
    )
    lines = raw.where(F.length("text") > 0).withColumn("_h", F.split(F.split_part("text", F.lit("\n"), F.lit(1)), r"\s+"))
    lines = lines.where(F.size("_h") >= 11).select(
        F.concat_ws(":", "_file", "_block", "_row").alias("chain"), "_h",
        F.posexplode(F.split("text", "\n")).alias("no", "line"),
    )
    cells = F.split(F.trim("line"), r"\s+")
    blocks = lines.where((F.col("no") > 0) & F.col("line").rlike(r"^\s*\d+")).select(
        "chain",
        "no",
        F.col("_h")[1].alias("src_chrom"),
        F.col("_h")[4].cast("bigint").alias("_s0"),
        F.col("_h")[6].alias("dst_chrom"),
        F.col("_h")[7].cast("bigint").alias("dst_size"),
        F.col("_h")[8].alias("strand"),
        F.col("_h")[9].cast("bigint").alias("_d0"),
        cells[0].cast("bigint").alias("size"),
        F.coalesce(F.get(cells, F.lit(1)).try_cast("bigint"), F.lit(0)).alias("ds"),
        F.coalesce(F.get(cells, F.lit(2)).try_cast("bigint"), F.lit(0)).alias("dd"),
        F.floor(F.col("no") / 4096).alias("_b"),
    )
    placed = running_totals(
        materialize(blocks),
        by=["chain"],
        bucket="_b",
        order=["no"],
        totals={"_src": F.col("size") + F.col("ds"), "_dst": F.col("size") + F.col("dd")},
    )
    src, dst = F.col("_s0") + F.col("_src"), F.col("_d0") + F.col("_dst")
    return placed.select(
        "src_chrom", src.alias("src_start"), (src + F.col("size")).alias("src_end"),
        "dst_chrom", dst.alias("dst_start"), "dst_size", "strand",
    )


# ---------------------------------------------------------------- variant calls


def _vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row with the sample names, read from the heads of the files.

    The first line of a file that is no comment is its header or, in a later part of a
    table written in parts, already data; so only the head of each file is read. All
    headers must be equal.
    """
    headers = set()
    for name in spark.read.text(path).inputFiles():
        first = spark.read.text(name).where((F.col("value") != "") & ~F.col("value").startswith("##")).first()
        if first is not None and first[0].startswith("#CHROM"):
            headers.add(first[0])
    if len(headers) != 1:
        raise ValueError(f"{path}: expected one header with sample names shared by all files")
    return spark.createDataFrame([(headers.pop().split("\t")[9:],)], "samples array<string>")


def _vcf_records(spark: SparkSession, path: str) -> DataFrame:
    """Data lines with their position and alleles; the calls stay unsplit in ``_line``."""
    lines = spark.read.text(path)
    data = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    c = F.split("value", "\t", 6)
    return data.select(
        prefixed_chrom(c[0]).alias("chrom"), c[1].cast("bigint").alias("pos"), c[3].alias("ref"), c[4].alias("alt"),
        F.col("value").alias("_line"),
    )


def _explode_calls(records: DataFrame, samples: DataFrame, keep: list[str]) -> DataFrame:
    calls = records.withColumn("_samples", samples.scalar()).withColumn("_c", F.split("_line", "\t"))
    calls = calls.withColumn("_calls", F.slice("_c", F.lit(10), F.size("_c")))
    return calls.select(*keep, F.explode(F.arrays_zip("_samples", "_calls")).alias("_z")).select(
        *keep, F.col("_z._samples").alias("sample_id"), F.col("_z._calls").alias("call")
    )


def read_dosage(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Dosage of requested (chrom, pos) variants; one alternate allele only, indels kept.

    Positions are matched before any sample column is split; missing calls are absent.
    """
    records, samples = _vcf_records(spark, path), _vcf_samples(spark, path)
    wanted = positions.select(prefixed_chrom(F.col("chrom").cast("string")).alias("chrom"), F.col("pos").cast("bigint").alias("pos")).distinct()
    single = F.expr("instr(alt, ',') = 0 AND alt <> '.'")
    chosen = records.where(single).join(wanted, ["chrom", "pos"], "left_semi")
    named = chosen.withColumn("variant_id", F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt"))
    calls = _explode_calls(named, samples, ["variant_id", "chrom", "pos", "ref", "alt"])
    return calls.withColumn("dosage", genotype_dosage(F.col("call"))).where(F.col("dosage").isNotNull()).drop("call")


def read_window_calls(spark: SparkSession, path: str, windows: DataFrame) -> DataFrame:
    """Haplotype alleles of substitutions inside ``windows(locus, chrom, start, end)``.

    One pass for all windows. Windows without a variant keep a row with NULL ``pos``.
    Only positions and alleles go through the interval join; the lines with the calls are
    then picked by the stored hits, whose measured size decides how.
    """
    records, samples = _vcf_records(spark, path), _vcf_samples(spark, path)
    snv = records.where((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("alt") != "."))
    spans = windows.select("locus", prefixed_chrom(F.col("chrom")).alias("chrom"), "start", "end")
    sites = ["chrom", "pos", "ref", "alt"]
    hits = materialize(points_in_windows(snv.select(*sites).distinct(), spans).select("locus", *sites))
    calls = _explode_calls(snv.join(hits, sites), samples, ["locus", "pos", "ref", "alt"])
    alleles = F.split(F.split_part("call", F.lit(":"), F.lit(1)), r"[/|]")
    called = calls.withColumn("_a", alleles).where(
        (F.size("_a") == 2) & ~F.exists("_a", lambda a: ~a.rlike(r"^\d+$"))
    )
    long = called.select(
        "locus", "pos", "ref", "alt", "sample_id", F.posexplode("_a").alias("haplotype", "_allele")
    ).select(
        "locus", "pos", "ref", "alt", "sample_id",
        F.col("haplotype").cast("tinyint").alias("haplotype"),
        F.col("_allele").cast("tinyint").alias("allele"),
    )
    return windows.select("locus").distinct().join(long, "locus", "left")


# ---------------------------------------------------------------- sample tables


# Column order of the published best-association files (no header).
ASSOCIATION_COLUMNS = [
    "snp_id", "id", "gene_id", "probe_id", "chr_snp", "chr_gene", "snp_pos", "tss_pos", "distance", "rvalue", "pvalue", "log10pvalue",
]


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, population, superpopulation) of a sample panel."""
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return raw.select(
        F.col("sample").alias("sample_id"), F.col("pop").alias("population"), F.col("super_pop").alias("superpopulation")
    )


def read_expression(
    spark: SparkSession,
    path: str,
    *,
    gene_column: str = "TargetID",
    other_columns: tuple[str, ...] = ("Gene_Symbol", "Chr", "Coord"),
) -> DataFrame:
    """Long (gene_id, sample_id, value) from a wide matrix; NULL where not numeric."""
    wide = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    if gene_column not in wide.columns:
        raise ValueError(f"{path} has no column {gene_column}")
    samples = [c for c in wide.columns if c != gene_column and c not in other_columns]
    renamed = wide.withColumnRenamed(gene_column, "gene_id").select("gene_id", *samples)
    long = renamed.unpivot(["gene_id"], samples, "sample_id", "value")
    return long.withColumn("value", F.col("value").try_cast("double"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate loci (variant_id, chrom, pos, gene_id) of a headerless association file."""
    schema = ", ".join(f"{c} STRING" for c in ASSOCIATION_COLUMNS)
    raw = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)
    return raw.select(
        F.col("snp_id").alias("variant_id"),
        prefixed_chrom(F.col("chr_snp")).alias("chrom"),
        F.col("snp_pos").cast("bigint").alias("pos"),
        "gene_id",
    )


