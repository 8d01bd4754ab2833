"""Protein sequences, annotations and the concept ontology from text files.

Compressed files are read by one task per file; write the result once as Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.text import accession, sanitize_residues


def file_order(*, row: str = "_row") -> list[Column]:
    """Columns that order the rows of one text scan as they stand in their files."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias(row),
    ]


def read_fasta(
    spark: SparkSession, path: str, *, max_length: int | None = None, max_records: int | None = None
) -> DataFrame:
    """(unit_id, sequence): records re-joined, residues sanitized.

    Records are split at a newline followed by '>', so a '>' inside a header is safe.
    ``max_length`` drops longer sequences; ``max_records`` keeps the first ones in file order.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", *file_order())
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), "\r$", "")
    # nothing after the header line means no sequence
    body = F.when(F.locate("\n", text) > 0, F.substring(text, F.locate("\n", text) + 1, F.length(text))).otherwise(F.lit(""))
    rows = raw.select(
        accession(head).alias("unit_id"),
        sanitize_residues(F.regexp_replace(body, r"\s", "")).alias("sequence"),
        "_file", "_block", "_row",
    ).where(F.length("sequence") > 0)
    if max_length is not None:
        rows = rows.where(F.length("sequence") <= max_length)
    if max_records is not None:
        rows = rows.orderBy("_file", "_block", "_row").limit(max_records)
    return rows.select("unit_id", "sequence")


def read_annotations(
    spark: SparkSession,
    path: str,
    *,
    units: DataFrame | None = None,
    evidence: list[str] | None = None,
    aspects: list[str] | None = None,
    keep_evidence: bool = False,
) -> DataFrame:
    """Distinct (unit_id, concept_id) of an annotation file; 'NOT' rows are dropped.

    ``keep_evidence`` keeps one row per annotation with its evidence code instead.
    """
    part = F.split("value", "\t")
    rows = (
        spark.read.text(path)
        .where(~F.col("value").startswith("!"))
        .select(part.alias("c"))
        .where(F.size("c") >= 9)
        .select(
            F.col("c")[1].alias("unit_id"),
            F.col("c")[3].alias("qualifier"),
            F.col("c")[4].alias("concept_id"),
            F.col("c")[6].alias("evidence"),
            F.col("c")[8].alias("aspect"),
        )
        .where(~F.upper("qualifier").contains("NOT"))
    )
    if evidence is not None:
        rows = rows.where(F.col("evidence").isin(evidence))
    if aspects is not None:
        rows = rows.where(F.col("aspect").isin(aspects))
    if units is not None:
        rows = rows.join(units.select("unit_id").distinct(), "unit_id", "left_semi")
    if keep_evidence:
        return rows.select("unit_id", "concept_id", "evidence", "aspect")
    return rows.select("unit_id", "concept_id").distinct()


def _terms(spark: SparkSession, path: str) -> DataFrame:
    stanza = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\[", "")
    rows = spark.read.option("lineSep", "\n[").text(path).select(stanza.alias("s"), *file_order())
    rows = rows.where(F.col("s").startswith("Term]"))
    return rows.select(
        F.regexp_extract("s", r"(?m)^id: (GO:\S+)", 1).alias("concept_id"),
        F.regexp_extract("s", r"(?m)^name: (.*?)\s*$", 1).alias("name"),
        F.regexp_extract_all("s", F.lit(r"(?m)^alt_id: (GO:\S+)"), 1).alias("alts"),
        F.regexp_extract_all("s", F.lit(r"(?m)^is_a: (GO:\S+)"), 1).alias("parents"),
        "_file", "_block", "_row",
    ).where(F.col("concept_id") != "")


def read_concept_names(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, name) with alternative ids; a canonical entry wins over an alias."""
    terms = _terms(spark, path).where(F.col("name") != "")
    own = terms.select("concept_id", "name", F.lit(0).alias("_p"), "_file", "_block", "_row")
    alias = terms.select(F.explode("alts").alias("concept_id"), "name", F.lit(1).alias("_p"), "_file", "_block", "_row")
    return own.unionByName(alias).groupBy("concept_id").agg(F.min_by("name", F.struct("_p", "_file", "_block", "_row")).alias("name"))


def read_concept_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, aliases): direct is_a edges of canonical ids, and alternative ids."""
    terms = _terms(spark, path)
    edges = terms.select(F.col("concept_id").alias("child_id"), F.explode("parents").alias("parent_id")).distinct()
    aliases = terms.select(F.explode("alts").alias("alt_id"), "concept_id").distinct()
    return edges, aliases


def resolve_names(concepts: DataFrame, names: DataFrame | None) -> DataFrame:
    """(concept_id, name); the id stands in for an unknown name."""
    if names is None:
        return concepts.select("concept_id", F.col("concept_id").alias("name"))
    joined = concepts.select("concept_id").join(names, "concept_id", "left")
    return joined.select("concept_id", F.coalesce("name", "concept_id").alias("name"))
