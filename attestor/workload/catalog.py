"""Registry of the queries run over the given tables and their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column, name: str | None = None) -> Column:
    """Six decimals, without a negative zero, so both engines print the same number."""
    rounded = F.round(value, 6) + F.lit(0.0)
    return rounded.alias(name) if name else rounded


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("unit_id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding dimension as one signed feature."""
    return vectors(spark, sf_dir).select("unit_id", F.posexplode("vec").alias("feature_idx", "act"))


def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("unit_id"), F.col("label").alias("concept_id")
    )
