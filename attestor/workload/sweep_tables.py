"""Sweep, registry and judgment tables derived from the star schema.

A line item is read as one probe result: model = return flag, sweep point = line number,
concept = part, best feature = supplier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.session import tasks_for
from attestor.workload.catalog import table

POINTS = [10, 20, 50, 100, 150, 200, 300]

SWEEP = """
sweep AS (SELECT l_returnflag AS model, [10, 20, 50, 100, 150, 200, 300][(l_linenumber - 1) % 7 + 1] AS min_positives,
  l_partkey AS concept_id, l_suppkey AS best_feature_idx, 0.5::DOUBLE + l_quantity / 100 AS single_feature_auroc,
  CASE WHEN l_tax < 0.075 THEN (l_discount + 0.02::DOUBLE) / l_linenumber END AS auroc_inflation,
  0.5::DOUBLE + l_quantity / 100 - (l_discount + 0.02::DOUBLE) / l_linenumber AS held_out_auroc,
  CASE WHEN l_tax > 0.015 THEN 0.5::DOUBLE + l_quantity / 100 - l_tax END AS hard_negative_held_out_auroc,
  0.4::DOUBLE + l_quantity / 110 AS multivariate_auroc FROM lineitem)"""

REGISTRY = """
registry AS (SELECT s_suppkey AS feature_idx, ['confirmed', 'plausible', 'spurious', 'unverifiable', 'pending'][s_nationkey % 5 + 1] AS status,
  'claim of ' || s_name AS claimed_concept FROM supplier)"""


def sweep(spark, sf):
    rows = table(spark, sf, "lineitem")
    inflation = (F.col("l_discount") + 0.02) / F.col("l_linenumber")
    single = F.lit(0.5) + F.col("l_quantity") / 100
    point = F.element_at(F.array(*[F.lit(p) for p in POINTS]), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    return rows.select(
        F.col("l_returnflag").alias("model"),
        point.alias("min_positives"),
        F.col("l_partkey").alias("concept_id"),
        F.col("l_suppkey").alias("best_feature_idx"),
        single.alias("single_feature_auroc"),
        F.when(F.col("l_tax") < 0.075, inflation).alias("auroc_inflation"),
        (single - inflation).alias("held_out_auroc"),
        F.when(F.col("l_tax") > 0.015, single - F.col("l_tax")).alias("hard_negative_held_out_auroc"),
        (F.lit(0.4) + F.col("l_quantity") / 110).alias("multivariate_auroc"),
    )


def registry(spark, sf):
    names = F.array(*[F.lit(s) for s in ("confirmed", "plausible", "spurious", "unverifiable", "pending")])
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("feature_idx"),
        F.element_at(names, (F.col("s_nationkey") % 5 + 1).cast("int")).alias("status"),
        F.concat(F.lit("claim of "), F.col("s_name")).alias("claimed_concept"),
    )


# a feature claims the parts it supplied
CLAIMED = """claimed AS (SELECT DISTINCT l_suppkey AS feature_idx, l_partkey AS concept_id FROM lineitem)"""


def claimed_registry(spark, sf):
    """One row per claim; the list column holds that claim alone."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feature_idx"), F.col("l_partkey").alias("concept_id"))
    claims = lines.repartition(tasks_for(lines), "feature_idx", "concept_id").distinct()
    return registry(spark, sf).join(claims.select("feature_idx", F.array("concept_id").alias("claimed")), "feature_idx")


def with_duplicate_point(rows):
    """Replace sweep point 20 by a copy of point 10, as when a cap binds at both."""
    copy = rows.where(F.col("min_positives") == 10).withColumn("min_positives", F.lit(20))
    return rows.where(F.col("min_positives") != 20).unionByName(copy)


DUPLICATED = """dup AS (SELECT * FROM sweep WHERE min_positives <> 20
  UNION ALL SELECT * REPLACE (20 AS min_positives) FROM sweep WHERE min_positives = 10)"""
