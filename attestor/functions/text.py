"""String columns: identifiers, sequences, window ids, genotype calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard residue and base alphabets.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
BASES = "ACGT"


def prefixed_chrom(chrom: Column) -> Column:
    """'22' -> 'chr22'; idempotent."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def bare_chrom(chrom: Column) -> Column:
    """'chr22' -> '22'; idempotent."""
    return F.regexp_replace(chrom, "^chr", "")


def stable_gene_id(gene_id: Column) -> Column:
    """Identifier without its release suffix."""
    return F.substring_index(gene_id, ".", 1)


def sanitize_residues(sequence: Column) -> Column:
    """Upper case; anything outside the 20 standard residues becomes X."""
    return F.regexp_replace(F.upper(sequence), f"[^{AMINO_ACIDS}]", "X")


def n_fraction(sequence: Column) -> Column:
    """Share of N bases; an empty sequence counts as all N."""
    size = F.length(sequence)
    missing = size - F.length(F.translate(sequence, "Nn", ""))
    return F.when(size > 0, missing / size).otherwise(F.lit(1.0))


def passes_n_threshold(sequence: Column, limit: float) -> Column:
    return n_fraction(sequence) <= F.lit(float(limit))


def window_id(chrom: Column, start: Column, end: Column, owner: Column | None = None) -> Column:
    parts = [] if owner is None else [owner, F.lit(":")]
    return F.concat(*parts, chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


WINDOW_PATTERN = r"^(.*):(\d+)-(\d+)$"


def parse_window_id(window: Column) -> Column:
    """STRUCT<chrom,start,end>; NULL when the text after the last colon is no range."""
    ok = window.rlike(WINDOW_PATTERN)
    return F.when(
        ok,
        F.struct(
            F.regexp_extract(window, WINDOW_PATTERN, 1).alias("chrom"),
            F.regexp_extract(window, WINDOW_PATTERN, 2).try_cast("bigint").alias("start"),
            F.regexp_extract(window, WINDOW_PATTERN, 3).try_cast("bigint").alias("end"),
        ),
    )


def snv_problem(ref: Column, alt: Column) -> Column:
    """Why an allele pair is not a plain substitution; NULL when it is one."""
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    known = F.upper(ref).rlike(f"^[{BASES}]$") & F.upper(alt).rlike(f"^[{BASES}]$")
    return F.when(~single, F.lit("not a single-nucleotide substitution")).when(~known, F.lit("non-ACGT allele"))


def genotype_dosage(call: Column) -> Column:
    """Alternate-allele count of a diploid call; NULL when any allele is missing."""
    gt = F.split_part(call, F.lit(":"), F.lit(1))
    alleles = F.split(gt, r"[/|]")
    missing = F.exists(alleles, lambda a: (a == ".") | (a == ""))
    return F.when(~missing, F.size(F.filter(alleles, lambda a: a != "0")).cast("tinyint"))


def accession(header: Column) -> Column:
    """Accession of a sequence header without its leading '>'."""
    strict = F.regexp_extract(header, r"^[a-z]+\|([A-Z0-9]+)\|", 1)
    first = F.split_part(F.split_part(F.trim(header), F.lit(" "), F.lit(1)), F.lit("|"), F.lit(1))
    return F.when(strict != "", strict).otherwise(first)


def gtf_attribute(attributes: Column, key: str) -> Column:
    """Value of an exactly matching key; NULL when absent."""
    value = F.regexp_extract(attributes, rf'(?:^|;)\s*{key} "([^"]*)"', 1)
    return F.when(value != "", value)


def has_evidence(labels: Column) -> Column:
    """False is what 'unverifiable' means: nothing documented to check against."""
    return F.coalesce(F.size(labels) > 0, F.lit(False))


def code_name(code: Column, names: list[str], fallback: Column) -> Column:
    """Name at a zero-based class code; ``fallback`` outside the list."""
    listed = F.array(*[F.lit(n) for n in names])
    inside = (code >= 0) & (code < len(names))
    return F.when(inside, F.element_at(listed, F.when(inside, code + 1).otherwise(F.lit(1)).cast("int"))).otherwise(
        fallback
    )
