"""Sequence access on the chunked genome: windows, allele windows, haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import passes_n_threshold, snv_problem


def window_sequences(windows: DataFrame, genome: DataFrame, *, chunk: int = 65536) -> DataFrame:
    """``windows`` plus upper-case ``sequence``: an equi-join on the chunks each one spans.

    Text outside the chromosome is cut off, as in slicing.
    """
    first = F.floor(F.greatest(F.col("start"), F.lit(0)) / chunk)
    last = F.floor((F.col("end") - 1) / chunk)
    asked = windows.select("window_id", "chrom", "start", "end", F.explode(F.sequence(first, last)).alias("_c"))
    pieces = asked.join(genome.withColumn("_c", F.floor(F.col("chunk_start") / chunk)), ["chrom", "_c"])
    low = F.greatest(F.col("start"), F.col("chunk_start"))
    high = F.least(F.col("end"), F.col("chunk_start") + F.length("seq"))
    cut = F.substring(F.col("seq"), (low - F.col("chunk_start") + 1).cast("int"), (high - low).cast("int"))
    cut_pieces = pieces.where(high > low).select("window_id", "chunk_start", cut.alias("text"))
    joined = cut_pieces.groupBy("window_id").agg(
        F.upper(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_start", "text"))), lambda s: s["text"]), "")
        ).alias("sequence")
    )
    return windows.join(joined, "window_id", "left").withColumn("sequence", F.coalesce("sequence", F.lit("")))


def gate_windows(windows: DataFrame, genome: DataFrame, *, max_n: float = 0.1, chunk: int = 65536) -> DataFrame:
    """Drop windows with too many unassembled bases."""
    return window_sequences(windows, genome, chunk=chunk).where(passes_n_threshold(F.col("sequence"), max_n)).drop("sequence")


def allele_windows(loci: DataFrame, genome: DataFrame, lengths: DataFrame, *, size: int, chunk: int = 65536) -> DataFrame:
    """Reference and alternate sequence of exact length around each substitution.

    ``loci`` has (locus, chrom, pos, ref, alt). Unusable loci keep a row with ``problem``
    and NULL sequences.
    """
    start = F.col("pos") - 1 - (size // 2)
    spans = loci.join(lengths, "chrom", "left").withColumns({"window_start": start, "_end": start + size})
    problem = (
        F.when(snv_problem(F.col("ref"), F.col("alt")).isNotNull(), snv_problem(F.col("ref"), F.col("alt")))
        .when(F.col("length").isNull(), F.lit("chromosome not in genome"))
        .when(F.col("window_start") < 0, F.lit("too close to the chromosome start"))
        .when(F.col("_end") > F.col("length"), F.lit("too close to the chromosome end"))
    )
    spans = spans.withColumn("problem", problem)
    usable = spans.where(F.col("problem").isNull()).select(
        F.col("locus").alias("window_id"), "chrom", F.col("window_start").alias("start"), F.col("_end").alias("end")
    )
    read = window_sequences(usable, genome, chunk=chunk).select(F.col("window_id").alias("locus"), "sequence")
    at = size // 2 + 1
    joined = spans.join(read, "locus", "left")
    base = F.substring("sequence", at, 1)
    mismatch = F.col("sequence").isNotNull() & (base != F.upper("ref"))
    reason = F.coalesce(
        F.col("problem"),
        F.when(mismatch, F.concat(F.lit("reference base is "), base, F.lit(", call says "), F.col("ref"))),
    )
    fine = reason.isNull()
    return joined.select(
        *loci.columns,
        F.when(fine, F.col("sequence")).alias("ref_seq"),
        F.when(fine, F.overlay("sequence", F.upper("alt"), F.lit(at), F.lit(1))).alias("alt_seq"),
        F.when(fine, F.col("window_start")).alias("window_start"),
        reason.alias("problem"),
    )


def symmetric_allele_windows(loci: DataFrame, genome: DataFrame, lengths: DataFrame, *, context: int) -> DataFrame:
    """``context`` bases on each side of the variant."""
    return allele_windows(loci, genome, lengths, size=2 * context + 1)


def haplotype_sequences(windows: DataFrame, samples: DataFrame, calls: DataFrame) -> DataFrame:
    """Personal sequences (locus, sample_id, haplotype, sequence) of every sample of a locus.

    ``windows`` has (locus, window_start, ref_seq); ``samples`` (locus, sample_id);
    ``calls`` the long alleles. Out-of-range positions, mismatching reference bases and
    missing calls leave the reference base. A group holds at most one substitution per
    base of the window.
    """
    offset: Column = F.col("pos") - 1 - F.col("window_start")
    placed = calls.where(F.col("allele") == 1).join(windows, "locus").withColumn("_o", offset)
    inside = (F.col("_o") >= 0) & (F.col("_o") < F.length("ref_seq"))
    # the position argument of substring is 1-based
    matching = F.upper(F.substring(F.col("ref_seq"), (F.col("_o") + 1).cast("int"), F.lit(1))) == F.upper("ref")
    edits = placed.where(inside & matching).groupBy("locus", "sample_id", "haplotype").agg(
        F.array_sort(F.collect_set(F.struct(F.col("_o").alias("o"), F.upper("alt").alias("alt")))).alias("_edits")
    )
    both = samples.select("locus", "sample_id").distinct().withColumn(
        "haplotype", F.explode(F.array(F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")))
    )
    full = both.join(windows, "locus").join(edits, ["locus", "sample_id", "haplotype"], "left")
    sequence = F.when(
        F.col("_edits").isNotNull(),
        F.aggregate(
            "_edits",
            F.upper("ref_seq"),
            lambda text, edit: F.overlay(text, edit["alt"], (edit["o"] + 1).cast("int"), F.lit(1)),
        ),
    ).otherwise(F.upper("ref_seq"))
    return full.select("locus", "sample_id", "haplotype", sequence.alias("sequence"))
