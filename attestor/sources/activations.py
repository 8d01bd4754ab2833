"""Activation dataset: partitioned Parquet instead of shard files and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shard(vectors: DataFrame, path: str) -> None:
    """Write ``(unit_id, sequence, vec, shard_id)``; a rewritten shard replaces itself only.

    Rows of a shard are spread over several files by a hash of the unit id, so one huge
    shard does not end up in one task.
    """
    (
        vectors.repartition("shard_id", F.pmod(F.xxhash64("unit_id"), F.lit(16)))
        .write.partitionBy("shard_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dataset_stats(vectors: DataFrame) -> DataFrame:
    """Row count, dimension, shard count."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("vec")).alias("n_dims"),
        F.count_distinct("shard_id").alias("n_shards"),
    )


def lookup(vectors: DataFrame, ids: list) -> DataFrame:
    """Vectors of the requested ids, in request order; an unknown id is an error."""
    spark = vectors.sparkSession
    id_type = vectors.schema["unit_id"].dataType.simpleString()
    asked = spark.createDataFrame(list(enumerate(ids)), f"pos int, unit_id {id_type}")
    return _ordered_lookup(vectors, asked)


def _ordered_lookup(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    found = asked.join(vectors.select("unit_id", "vec"), "unit_id", "left")
    checked = F.when(
        F.col("vec").isNull(),
        F.raise_error(F.concat(F.lit("unknown unit id: "), F.col("unit_id").cast("string"))).cast("array<double>"),
    ).otherwise(F.col("vec"))
    return found.select("pos", "unit_id", checked.alias("vec")).orderBy("pos")


def lookup_table(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """As :func:`lookup` for a request table ``(pos, unit_id)``."""
    return _ordered_lookup(vectors, asked)
