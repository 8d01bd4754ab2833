"""Consensus and agreement between raters, and judge consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.stats import CONFIDENCES, STATUSES, confidence_rank, status_ordinal


def consensus(rated: DataFrame) -> DataFrame:
    """Resolve two labels: equal wins, else higher confidence, else excluded with a reason."""
    a, b = confidence_rank(F.col("confidence_a")), confidence_rank(F.col("confidence_b"))
    same = F.col("status_a") == F.col("status_b")
    label = F.when(same, F.col("status_a")).when(a > b, F.col("status_a")).when(b > a, F.col("status_b"))
    reason = (
        F.when(same, F.lit("agreement"))
        .when(a > b, F.concat(F.lit("A is more confident: "), "confidence_a", F.lit(" > "), "confidence_b"))
        .when(b > a, F.concat(F.lit("B is more confident: "), "confidence_b", F.lit(" > "), "confidence_a"))
        .otherwise(F.concat(F.lit("tied at "), "confidence_a", F.lit(": "), "status_a", F.lit(" vs "), "status_b"))
    )
    return rated.withColumns({"resolved_label": label, "reason": reason})


def agreement(rated: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Percent agreement, on-scale agreement, linear-weighted kappa, resolution counts.

    Everything comes from the contingency table of the two labels, so the rows are
    aggregated once. Linear weights use the index among the categories that occur.
    """
    keys = keys or []
    resolved = consensus(rated)
    cells = resolved.groupBy(*keys, "status_a", "status_b").agg(
        F.count(F.lit(1)).alias("n"), F.count("resolved_label").alias("n_resolved")
    )
    same = F.col("status_a") == F.col("status_b")
    cells = cells.withColumns({"oa": status_ordinal(F.col("status_a")), "ob": status_ordinal(F.col("status_b"))})
    on_scale = F.col("oa").isNotNull() & F.col("ob").isNotNull()
    totals = cells.groupBy(*keys).agg(
        F.sum("n").alias("n_items"),
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("_same"),
        F.sum(F.when(on_scale, F.col("n")).otherwise(0)).alias("_on"),
        F.sum(F.when(on_scale & same, F.col("n")).otherwise(0)).alias("_on_same"),
        F.sum("n_resolved").alias("n_resolved"),
        # marginals of the three ordinal categories and the joint cells, in one row per group
        *[F.sum(F.when(on_scale & (F.col("oa") == i), F.col("n")).otherwise(0)).alias(f"_a{i}") for i in range(3)],
        *[F.sum(F.when(on_scale & (F.col("ob") == i), F.col("n")).otherwise(0)).alias(f"_b{i}") for i in range(3)],
        *[
            F.sum(F.when((F.col("oa") == i) & (F.col("ob") == j), F.col("n")).otherwise(0)).alias(f"_c{i}{j}")
            for i in range(3)
            for j in range(3)
            if i != j
        ],
    )
    seen = [(F.col(f"_a{i}") + F.col(f"_b{i}") > 0).cast("int") for i in range(3)]
    index = [F.lit(0), seen[0], seen[0] + seen[1]]
    observed: Column = F.lit(0.0)
    expected: Column = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            weight = F.abs(index[i] - index[j])
            observed = observed + weight * F.col(f"_c{i}{j}")
            expected = expected + weight * F.col(f"_a{i}") * F.col(f"_b{j}") / F.nullif(F.col("_on"), F.lit(0))
    kappa = F.when(seen[0] + seen[1] + seen[2] >= 2, 1 - F.try_divide(observed, expected))
    return totals.select(
        *keys,
        "n_items",
        (F.col("_same") / F.col("n_items")).alias("percent_agreement"),
        (F.col("n_items") - F.col("_on")).alias("n_unverifiable_by_either"),
        F.try_divide(F.col("_on_same"), F.col("_on")).alias("percent_agreement_on_scale"),
        kappa.alias("weighted_kappa"),
        "n_resolved",
        (F.col("n_items") - F.col("n_resolved")).alias("n_excluded"),
    )


def split_completed(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of a completed annotation sheet, with the problem named."""
    clean = sheet.withColumns(
        {
            "status": F.lower(F.trim("status")),
            "confidence": F.lower(F.trim("confidence")),
            "justification": F.trim("justification"),
        }
    )
    problem = (
        F.when(F.col("status").isNull() | ~F.col("status").isin(STATUSES), "unknown status")
        .when(F.col("confidence").isNull() | ~F.col("confidence").isin(CONFIDENCES), "unknown confidence")
        .when(F.coalesce("justification", F.lit("")) == "", "empty justification")
    )
    marked = clean.withColumn("problem", problem)
    return marked.where(F.col("problem").isNull()).drop("problem"), marked.where(F.col("problem").isNotNull())


def require_completed(sheet: DataFrame) -> DataFrame:
    """Strict form: any bad row is an error that names the features."""
    valid, bad = split_completed(sheet)
    listed = bad.limit(5).collect()
    if listed:
        raise ValueError(f"invalid rows: {[(r['feature_idx'], r['problem']) for r in listed]}")
    return valid


def pair_annotators(a: DataFrame, b: DataFrame, answer_key: DataFrame) -> DataFrame:
    """Both raters next to the key; an item missing from either rater is an error."""
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            "feature_idx",
            F.col("status").alias(f"status_{suffix}"),
            F.col("confidence").alias(f"confidence_{suffix}"),
        )

    joined = answer_key.join(side(a, "a"), "feature_idx", "left").join(side(b, "b"), "feature_idx", "left")
    for suffix in ("a", "b"):
        name = f"status_{suffix}"
        message = F.concat(F.lit(f"annotator {suffix.upper()} lacks feature "), F.col("feature_idx").cast("string"))
        joined = joined.withColumn(
            name, F.when(F.col(name).isNull(), F.raise_error(message).cast("string")).otherwise(F.col(name))
        )
    return joined


def trap_results(paired: DataFrame) -> DataFrame:
    """Items with a known answer: did each rater get them right?"""
    return paired.where("is_trap").select(
        "feature_idx",
        F.col("status").alias("true_status"),
        (F.col("status_a") == F.col("status")).alias("a_correct"),
        (F.col("status_b") == F.col("status")).alias("b_correct"),
    )


def agreement_report(a: DataFrame, b: DataFrame, answer_key: DataFrame, verifier: DataFrame | None = None) -> DataFrame:
    """A vs B, prior labels vs consensus, and verifier vs consensus, one row each."""
    paired = pair_annotators(a, b, answer_key)
    resolved = consensus(paired).where(F.col("resolved_label").isNotNull())
    sure = F.lit("high")

    def against(label: Column, rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            F.lit(name).alias("comparison"),
            label.alias("status_a"),
            sure.alias("confidence_a"),
            F.col("resolved_label").alias("status_b"),
            sure.alias("confidence_b"),
        )

    stacked = paired.select(
        F.lit("a_vs_b").alias("comparison"), "status_a", "confidence_a", "status_b", "confidence_b"
    ).unionByName(against(F.col("status"), resolved, "prior_vs_consensus"))
    if verifier is not None:
        judged = resolved.join(
            verifier.select("feature_idx", F.col("modal_status").alias("_modal")), "feature_idx", "left"
        )
        message = F.concat(F.lit("no verifier judgment for feature "), F.col("feature_idx").cast("string"))
        modal = F.when(F.col("_modal").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("_modal"))
        stacked = stacked.unionByName(against(modal, judged, "verifier_vs_consensus"))
    return agreement(stacked, keys=["comparison"])


def judge_consistency(judgments: DataFrame) -> DataFrame:
    """Modal status and the share of repeats that match it, per feature; name breaks ties."""
    counts = judgments.groupBy("feature_idx", "status").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("feature_idx").orderBy(F.col("n").desc(), "status")  # at most four statuses
    total = Window.partitionBy("feature_idx")
    return (
        counts.withColumns({"_r": F.row_number().over(order), "n_repeats": F.sum("n").over(total)})
        .where(F.col("_r") == 1)
        .select(
            "feature_idx",
            F.col("status").alias("modal_status"),
            (F.col("n") / F.col("n_repeats")).alias("consistency"),
            "n_repeats",
        )
    )


def calibration(consistency: DataFrame, registry: DataFrame) -> DataFrame:
    """Accuracy of the modal status against known statuses, and mean consistency."""
    known = consistency.join(registry.select("feature_idx", F.col("status").alias("_known")), "feature_idx", "left")
    right = F.col("modal_status") == F.col("_known")
    return known.agg(
        F.count("_known").alias("n_scored"),
        F.sum(F.coalesce(right.cast("bigint"), F.lit(0))).alias("n_correct"),
        F.avg(right.cast("double")).alias("accuracy"),
        F.avg("consistency").alias("mean_consistency"),
    )
