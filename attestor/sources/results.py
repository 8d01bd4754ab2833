"""Sweep results, registries, sheets: readers and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBE_RESULT = T.StructType(
    [
        T.StructField("concept_id", T.StringType()),
        T.StructField("concept_name", T.StringType()),
        T.StructField("n_positives", T.LongType()),
        T.StructField("n_total", T.LongType()),
        T.StructField("single_feature_auroc", T.DoubleType()),
        T.StructField("best_feature_idx", T.IntegerType()),
        T.StructField("multivariate_auroc", T.DoubleType()),
        T.StructField("held_out_auroc", T.DoubleType()),
        T.StructField("hard_negative_held_out_auroc", T.DoubleType()),
        T.StructField("n_hard_negatives", T.LongType()),
        T.StructField("auroc_inflation", T.DoubleType()),
    ]
)
# Field names of stored result files.
STORED_NAMES = {"go_id": "concept_id", "go_name": "concept_name"}

REGISTRY = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("feature_idx", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("claimed", T.ArrayType(T.StringType())),
        T.StructField("claimed_concept", T.StringType()),
        T.StructField("real_identity", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)
GENOMIC_REGISTRY = T.StructType(
    [
        T.StructField("feature_idx", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("claimed_gene_ids", T.ArrayType(T.StringType())),
        T.StructField("n_claims", T.IntegerType()),
        T.StructField("match_rate", T.DoubleType()),
        T.StructField("matched_windows", T.ArrayType(T.StringType())),
    ]
)
SHEET = "feature_idx INT, status STRING, confidence STRING, justification STRING"


def read_sweep(spark: SparkSession, root: str, *, model: str | None = None, multi_line: bool = True) -> DataFrame:
    """Every ``mp<N>`` directory of stored results; unparsable files yield no rows.

    ``multi_line=False`` reads one JSON object per line, which splits across tasks.
    """
    inverse = {v: k for k, v in STORED_NAMES.items()}
    stored = T.StructType([T.StructField(inverse.get(f.name, f.name), f.dataType) for f in PROBE_RESULT])
    stored = stored.add("_corrupt", T.StringType())
    rows = (
        spark.read.schema(stored)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json")
        .json(f"{root.rstrip('/')}/mp*")
    )
    point = F.regexp_extract(F.input_file_name(), r"/mp(\d+)/", 1)
    renamed = rows.withColumn("min_positives", point.try_cast("int")).withColumnsRenamed(STORED_NAMES)
    good = renamed.where(F.col("_corrupt").isNull() & F.col("min_positives").isNotNull() & F.col("concept_id").isNotNull())
    out = good.select("min_positives", *[f.name for f in PROBE_RESULT])
    return out.withColumn("model", F.lit(model)) if model is not None else out


def write_report(report: DataFrame, path: str, *, partition_by: tuple[str, ...] = ("model", "min_positives")) -> None:
    """Result rows partitioned by run; a rerun replaces its own partition only."""
    report.write.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).json(path)


def read_genomic_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GENOMIC_REGISTRY).json(path)


def import_registry_yaml(spark: SparkSession, path: str, *, model: str | None = None, genomic: bool = False) -> DataFrame:
    """One hand-curated YAML registry (a few hundred entries) as a table."""
    import yaml

    with open(path) as handle:
        entries = (yaml.safe_load(handle) or {}).get("features") or {}
    if genomic:
        rows = [
            (int(i), e["status"], e.get("reason", ""), e.get("claimed_gene_ids", []), int(e.get("n_claims", 0)),
             float(e.get("match_rate", 0.0)), e.get("matched_windows", []))
            for i, e in entries.items()
        ]
        return spark.createDataFrame(rows, GENOMIC_REGISTRY)
    rows = [
        (model, int(i), e.get("status"), e.get("claimed_go", []), e.get("claimed_concept", ""),
         e.get("real_identity", ""), [str(a) for a in e.get("evidence_accessions", [])])
        for i, e in entries.items()
    ]
    return spark.createDataFrame(rows, REGISTRY)


def write_evidence(verdicts: DataFrame, path: str) -> None:
    """Verdicts with the match rate rounded to four places, one JSON row per feature."""
    verdicts.withColumn("match_rate", F.round("match_rate", 4)).write.mode("overwrite").json(path)


def write_sheet(sheet: DataFrame, path: str) -> None:
    """Annotation sheet as CSV with a header; quotes are doubled so any text survives."""
    sheet.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Completed sheet; columns are found by name."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(
        F.col("feature_idx").try_cast("int").alias("feature_idx"), *[F.col(c) for c in ("status", "confidence", "justification")]
    )
