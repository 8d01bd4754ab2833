"""Looking at single features: profiles, top units, claims, candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.ordering import hash_rank, stable_rank
from attestor.session import materialize


def feature_profile(features: DataFrame, dictionary: DataFrame, n_units: int) -> DataFrame:
    """Activation rate, maximum and mean-when-active of every dictionary feature."""
    fired = features.where(F.col("act") > 0).groupBy("feature_idx").agg(
        F.count(F.lit(1)).alias("n_active"), F.max("act").alias("_max"), F.avg("act").alias("_mean")
    )
    return dictionary.select("feature_idx").join(fired, "feature_idx", "left").select(
        "feature_idx",
        (F.coalesce("n_active", F.lit(0)) / F.lit(n_units)).alias("activation_rate"),
        F.coalesce("_max", F.lit(0.0)).alias("max_activation"),
        F.coalesce("_mean", F.lit(0.0)).alias("mean_activation_when_active"),
    )


def top_units(features: DataFrame, units: DataFrame, *, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """The k strongest units of each feature, padded with silent units when fewer fire.

    The row_number filter becomes a per-partition group limit before the shuffle, so a
    hot feature moves at most k rows per task. Padding takes the lowest unit ids that do
    not fire; only the first k + (active) ids can be needed, so only those are read.
    """
    rows = features if wanted is None else features.join(wanted.select("feature_idx").distinct(), "feature_idx", "left_semi")
    rows = rows.where(F.col("act") > 0)
    order = Window.partitionBy("feature_idx").orderBy(F.col("act").desc(), F.col("unit_id").asc())
    best = materialize(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    asked = (rows if wanted is None else wanted).select("feature_idx").distinct()
    have = asked.join(best.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("_have")), "feature_idx", "left")
    short = have.select("feature_idx", F.coalesce("_have", F.lit(0)).alias("_have")).where(F.col("_have") < k)
    # a short feature fires for fewer than k units, so among the 2k lowest ids at least k are silent
    low = units.select("unit_id").distinct().orderBy("unit_id").limit(2 * k)
    ids = low.agg(F.array_sort(F.collect_list("unit_id")).alias("ids")).scalar()
    silent = short.join(
        best.groupBy("feature_idx").agg(F.collect_list("unit_id").alias("_active")), "feature_idx", "left"
    )
    free = F.array_except(ids, F.coalesce("_active", F.array().cast(_array_type(units))))
    pads = silent.select(
        "feature_idx", "_have", F.posexplode(F.slice(free, F.lit(1), F.lit(k) - F.col("_have")).alias("pad"))
    ).select(
        F.col("col").alias("unit_id"),
        "feature_idx",
        F.lit(0.0).alias("act"),
        (F.col("_have") + F.col("pos") + 1).cast("int").alias("rank"),
    )
    return best.select("unit_id", "feature_idx", "act", "rank").unionByName(pads)


def _array_type(units: DataFrame) -> str:
    return f"array<{units.schema['unit_id'].dataType.simpleString()}>"


def annotations_by_feature(report: DataFrame) -> DataFrame:
    """All claims of a feature as readable strings, best score first."""
    label = F.format_string(
        "%s %s (auroc=%.3f)", F.col("concept_id").cast("string"), F.col("concept_name"), F.col("single_feature_auroc")
    )
    return report.groupBy(F.col("best_feature_idx").alias("feature_idx")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("single_feature_auroc")).alias("a"), label.alias("text")))),
            lambda s: s["text"],
        ).alias("annotations")
    )


def active_features(
    features: DataFrame, *, limit: int = 20, registry: DataFrame | None = None, annotations: DataFrame | None = None
) -> DataFrame:
    """Strongest active features of each unit with the registry's verdict.

    A confirmed verdict is shown in preference to the unverified label.
    """
    order = Window.partitionBy("unit_id").orderBy(F.col("act").desc(), F.col("feature_idx"))
    top = features.where(F.col("act") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    if registry is not None:
        top = top.join(registry.select("feature_idx", "status", "real_identity"), "feature_idx", "left")
    if annotations is not None:
        top = top.join(annotations, "feature_idx", "left")
    return top


def candidate_evidence(features: DataFrame, units: DataFrame, report: DataFrame, *, k: int) -> DataFrame:
    """Top units for every claimed feature, with all concepts that claim it."""
    # distinct first: a collecting aggregation would sort all rows of the report
    told = report.select(F.col("best_feature_idx").alias("feature_idx"), "concept_id").distinct()
    claims = materialize(told.groupBy("feature_idx").agg(F.array_sort(F.collect_set("concept_id")).alias("claimed")))
    return top_units(features, units, k=k, wanted=claims).join(claims, "feature_idx")


def fresh_candidates(
    sweep: DataFrame, registry: DataFrame, *, per_point: int, min_auroc: float
) -> DataFrame:
    """New features per sweep point, in lexicographic point order; later points skip taken ones."""
    points = sorted(f"mp{r[0]}" for r in sweep.select("min_positives").distinct().collect())
    taken = registry.select("feature_idx")
    out = None
    for point in points:
        value = int(point[2:])
        rows = sweep.where((F.col("min_positives") == value) & (F.col("single_feature_auroc") >= min_auroc))
        rows = rows.join(taken, rows["best_feature_idx"] == taken["feature_idx"], "left_anti")
        best = rows.groupBy("best_feature_idx").agg(
            F.max_by("concept_id", F.struct(F.col("single_feature_auroc"), F.col("concept_id"))).alias("concept_id"),
            F.max("single_feature_auroc").alias("single_feature_auroc"),
        )
        fresh = best.orderBy(F.col("single_feature_auroc").desc(), F.col("best_feature_idx")).limit(per_point).select(
            F.lit(value).alias("min_positives"),
            F.col("best_feature_idx").alias("feature_idx"),
            "concept_id",
            "single_feature_auroc",
        )
        fresh = materialize(fresh)  # at most per_point rows; keeps the next point's plan short
        out = fresh if out is None else out.unionByName(fresh)
        taken = taken.unionByName(fresh.select("feature_idx"))
    return out


def strided_sample(df: DataFrame, *, key: str, at_most: int) -> DataFrame:
    """Evenly strided subsample: rows floor(i * N / m), i = 0..m-1; everything when N <= m."""
    ranked = stable_rank(df, by=[], key=key, rank="_row")
    total = df.count()
    if total <= at_most:
        return df
    row = F.col("_row") - 1
    # row r is taken when some i has floor(i * N / m) = r
    i = F.ceil(row * F.lit(float(at_most)) / F.lit(float(total))).cast("bigint")
    near = [i - 1, i, i + 1]
    hit = F.lit(False)
    for candidate in near:
        target = F.floor(candidate * F.lit(total / at_most)).cast("bigint")
        hit = hit | ((target == row) & (candidate >= 0) & (candidate < at_most))
    return ranked.where(hit).drop("_row")


def first_by_key(df: DataFrame, *, key: str, n: int) -> DataFrame:
    """Deterministic cap by sorted id; a top-n, not a full sort."""
    return df.orderBy(key).limit(n)


def most_positive_concept(labels: DataFrame) -> DataFrame:
    """Concept with most labels, lowest id on ties."""
    counts = labels.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_positives"))
    return counts.orderBy(F.col("n_positives").desc(), F.col("concept_id")).limit(1)


def hash_sample(df: DataFrame, *, by: list[str], key: str, n: Column | int, seed) -> DataFrame:
    """The first n rows of each group in hash order."""
    limit = n if isinstance(n, Column) else F.lit(n)
    return hash_rank(df, by=by, seed=seed, parts=[key], rank="_o").where(F.col("_o") <= limit).drop("_o")
