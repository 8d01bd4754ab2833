"""Locus case study: all loci at once, arms as a column, skips as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import mediation as M
from attestor.session import materialize


def confirmed_feature(registry: DataFrame) -> DataFrame:
    """Lowest confirmed feature of a genomic registry, used for every locus (may be empty)."""
    return registry.where(F.col("status") == "confirmed").orderBy("feature_idx").limit(1).select("feature_idx")


def arm_features(loci: DataFrame, naive: DataFrame, registry: DataFrame) -> DataFrame:
    """(locus, arm, feature_idx): the gene's naive feature, plus the confirmed one if any."""
    named = loci.join(naive.select("gene_id", "feature_idx"), "gene_id").select(
        "locus", F.lit("naive").alias("arm"), "feature_idx"
    )
    verified = confirmed_feature(registry).select("feature_idx").scalar()
    both = loci.select("locus", F.lit("verified").alias("arm")).withColumn("feature_idx", verified)
    return named.unionByName(both.where(F.col("feature_idx").isNotNull()))


def run_locus_study(
    loci: DataFrame,
    dosage: DataFrame,
    expression: DataFrame,
    panel: DataFrame,
    sample_features: DataFrame,
    naive: DataFrame,
    registry: DataFrame,
    *,
    sample_distance: DataFrame | None = None,
    n_rep: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """One row per (locus, arm) with effects, sensitivity, control, baselines and FDR.

    ``sample_features`` has (locus, sample_id, feature_idx, m), silent features absent.
    Loci that cannot be analysed come back with ``skip_reason`` and NULL results. The tables of
    loci and arms are stored first: their size is then known, and where they are small no
    sample is shuffled to meet them.
    """
    loci = materialize(loci.select("locus", "variant_id", "gene_id"))
    arms = materialize(arm_features(loci, naive, registry))
    rows, skipped = M.align_samples(loci, dosage, expression)
    rows = materialize(M.add_ancestry(rows.select("locus", "sample_id", "t", "y"), panel))
    unnamed = loci.join(naive.select("gene_id"), "gene_id", "left_anti").select(
        "locus", F.lit("no naive feature for gene").alias("skip_reason")
    )
    with_arm = rows.join(arms, "locus").join(sample_features, ["locus", "sample_id", "feature_idx"], "left")
    with_arm = with_arm.withColumn("m", F.coalesce("m", F.lit(0.0)))
    keys = ["locus", "arm"]
    effects = materialize(M.mediation(with_arm, keys=keys, category="superpopulation", n_rep=n_rep, seed=seed))
    star = M.zero_crossing(M.sensitivity_curve(effects, keys=keys), keys=keys)
    control = M.negative_control(rows, keys=["locus"], category="superpopulation", n_rep=n_rep, seed=seed).select(
        "locus", F.col("acme_p").alias("control_acme_p")
    )
    twas = M.baseline_regression(
        rows, keys=["locus"], predictor="t", method="twas_style", category="superpopulation"
    ).select("locus", F.col("r_squared").alias("twas_r_squared"), F.col("p_value").alias("twas_p"))
    reported = M.adjust_arms(effects)
    out = (
        reported.join(star, keys, "left").join(control, "locus", "left").join(twas, "locus", "left")
        .join(arms, keys, "left")
        .join(registry.select("feature_idx", "status", "reason", "match_rate"), "feature_idx", "left")
    )
    if sample_distance is not None:
        far = rows.join(sample_distance.select("locus", "sample_id", "distance"), ["locus", "sample_id"])
        raw = M.baseline_regression(
            far, keys=["locus"], predictor="distance", method="raw_embedding", category="superpopulation"
        ).select("locus", F.col("r_squared").alias("embedding_r_squared"), F.col("p_value").alias("embedding_p"))
        out = out.join(raw, "locus", "left")
    missing = skipped.unionByName(unnamed).groupBy("locus").agg(F.min("skip_reason").alias("skip_reason"))
    analysed = loci.select("locus", "variant_id", "gene_id").join(missing, "locus", "left")
    return analysed.join(out, "locus", "left")
