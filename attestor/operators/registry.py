"""Registries of verified claims and the sweep rows that are joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.stats import status_target
from attestor.operators.ordering import hash_rank
from attestor.session import tasks_for


def sweep_rows(sweep: DataFrame, registry: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Sweep rows whose concept the registry claims for that feature, with numeric target.

    ``keys=['model']`` gives the pooled form: the model is part of the join key. Rows
    without a status on the scale are excluded, never counted as zero. Both sides are dealt by
    the join key into tasks counted by the rows of ``sweep``, which is read twice.
    """
    keys = keys or []
    on = [*keys, "best_feature_idx", "concept_id"]
    tasks = tasks_for(sweep)
    # one row per claim, so the claim is part of the join key and no list travels with the rows
    claims = registry.select(
        *keys, F.col("feature_idx").alias("best_feature_idx"), "status", F.explode("claimed").alias("concept_id")
    ).repartition(tasks, *on).distinct()
    joined = sweep.select(*on, "min_positives").repartition(tasks, *on).join(claims, on)
    out = joined.withColumn("target", status_target(F.col("status"))).where(F.col("target").isNotNull())
    return out.select(*keys, "min_positives", "concept_id", F.col("best_feature_idx").alias("feature_idx"), "target")


def append_new(registry: DataFrame, incoming: DataFrame, *, key: str = "feature_idx") -> DataFrame:
    """Existing entries always win; only unknown keys are added."""
    return registry.unionByName(incoming.join(registry.select(key), key, "left_anti"))


def require_matched(left: DataFrame, right: DataFrame, on: list[str], what: str) -> DataFrame:
    """Inner join that fails when a left row has no partner."""
    marked = left.join(right.withColumn("_matched", F.lit(True)), on, "left")
    message = F.concat(F.lit(f"{what} without a match: "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))
    ok = F.when(F.col("_matched").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("_matched"))
    return marked.withColumn("_matched", ok).where(F.col("_matched")).drop("_matched")


def resolve_evidence(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Split each claim's evidence ids into found and missing ones."""
    ids = claims.select("feature_idx", F.explode_outer("evidence").alias("unit_id"))
    marked = ids.join(known.select("unit_id").distinct().withColumn("_known", F.lit(True)), "unit_id", "left")
    have = F.col("_known").isNotNull()
    return marked.groupBy("feature_idx").agg(
        F.array_sort(F.collect_list(F.when(have, F.col("unit_id")))).alias("found"),
        F.array_sort(F.collect_list(F.when(~have, F.col("unit_id")))).alias("missing"),
    )


def compare_arms(points: DataFrame, first: str, second: str) -> DataFrame:
    """Two arms at equal sweep points: interval overlap and which is higher."""
    a = points.where(F.col("arm") == first).select(
        "min_positives", F.col("mean").alias("a_mean"), F.col("ci_lo").alias("a_lo"), F.col("ci_hi").alias("a_hi")
    )
    b = points.where(F.col("arm") == second).select(
        "min_positives", F.col("mean").alias("b_mean"), F.col("ci_lo").alias("b_lo"), F.col("ci_hi").alias("b_hi")
    )
    apart = (F.col("a_hi") < F.col("b_lo")) | (F.col("b_hi") < F.col("a_lo"))
    return a.join(b, "min_positives").withColumns(
        {"ci_overlap": ~apart, "b_higher": F.col("b_mean") > F.col("a_mean")}
    )


def field_differences(baseline: DataFrame, rerun: DataFrame, *, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields whose stored text differs between two runs, including rows on one side only."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        text = [F.col(f).cast("string").alias(f) for f in fields]
        return df.select(*keys, *text).unpivot(keys, fields, "field", name).withColumn(f"has_{name}", F.lit(True))

    joined = tall(baseline, "baseline").join(tall(rerun, "rerun"), [*keys, "field"], "full_outer")
    same = F.col("baseline").eqNullSafe(F.col("rerun")) & F.col("has_baseline").isNotNull() & F.col("has_rerun").isNotNull()
    problem = F.when(F.col("has_rerun").isNull(), "missing from rerun").when(
        F.col("has_baseline").isNull(), "missing from baseline"
    ).otherwise("differs")
    return joined.where(~same).select(*keys, "field", "baseline", "rerun", problem.alias("problem"))


def verification_targets(registry: DataFrame, *, mode: str, feature_ids: DataFrame | None = None) -> DataFrame:
    """Entries to (re)judge: 'calibrate' needs a status, 'verify' needs its absence."""
    has_status = F.col("status").isNotNull() & (F.col("status") != "")
    if mode == "calibrate":
        chosen = registry.where(has_status)
    elif mode == "verify":
        chosen = registry.where(~has_status)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if feature_ids is None:
        return chosen
    unknown = feature_ids.join(registry.select("feature_idx"), "feature_idx", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown feature ids: {[r[0] for r in unknown]}")
    return chosen.join(feature_ids.select("feature_idx").distinct(), "feature_idx", "left_semi")


def annotator_packets(
    registry: DataFrame, *, shared_per_status: int, expansion_per_annotator: int, seed
) -> DataFrame:
    """(feature_idx, status, packet, is_trap): shared overlap set plus disjoint A/B sets.

    The shared set takes all 'unverifiable' entries and the first n of every other status
    in hash order; traps are the smallest confirmed and smallest spurious shared ids.
    """
    by_status = hash_rank(
        registry.select("feature_idx", "status"), by=["status"], seed=seed, parts=["feature_idx"], rank="_o"
    )
    on_scale = F.col("status").isin("confirmed", "plausible", "spurious")
    shared = by_status.where(
        (F.col("status") == "unverifiable") | (on_scale & (F.col("_o") <= shared_per_status))
    ).drop("_o")
    rest = registry.select("feature_idx", "status").join(shared.select("feature_idx"), "feature_idx", "left_anti")
    rest = hash_rank(rest, by=[], seed=f"{seed}:rest", parts=["feature_idx"], rank="_o")
    expansion = rest.where(F.col("_o") <= 2 * expansion_per_annotator).select(
        "feature_idx",
        "status",
        F.when(F.col("_o") <= expansion_per_annotator, "expansion_a").otherwise("expansion_b").alias("packet"),
        F.lit(False).alias("is_trap"),
    )
    first = shared.where(F.col("status").isin("confirmed", "spurious")).groupBy("status").agg(
        F.min("feature_idx").alias("feature_idx")
    )
    marked = shared.join(first.select("feature_idx").withColumn("_trap", F.lit(True)), "feature_idx", "left")
    return marked.select(
        "feature_idx", "status", F.lit("shared").alias("packet"), F.coalesce("_trap", F.lit(False)).alias("is_trap")
    ).unionByName(expansion)


def merge_packets(packets: DataFrame, answer_key: DataFrame, *, seed) -> DataFrame:
    """All packets as one set both annotators rate, in hash order; traps are preserved."""
    repeated = packets.groupBy("feature_idx").count().where(F.col("count") > 1).limit(5).collect()
    if repeated:
        raise ValueError(f"feature in several packets: {[r[0] for r in repeated]}")
    absent = packets.join(answer_key.select("feature_idx"), "feature_idx", "left_anti").limit(5).collect()
    if absent:
        raise ValueError(f"answer key lacks: {[r[0] for r in absent]}")
    ordered = hash_rank(packets.select("feature_idx"), by=[], seed=f"{seed}:merge", parts=["feature_idx"], rank="position")
    return ordered.join(answer_key, "feature_idx").withColumn("packet", F.lit("shared"))


def blind_sheet(features: DataFrame) -> DataFrame:
    """What an annotator sees: the claim and empty response columns."""
    empty: Column = F.lit("")
    return features.select(
        "feature_idx",
        F.array_join("claimed", "; ").alias("claimed"),
        F.coalesce("claimed_concept", empty).alias("claimed_concept"),
        F.array_join("evidence", "; ").alias("evidence"),
        empty.alias("status"),
        empty.alias("confidence"),
        empty.alias("justification"),
    )


def fingerprint_points(rows: DataFrame, *, model: str = "model", point: str = "min_positives") -> DataFrame:
    """(model, point, duplicate_of): earlier point of the same model with an identical row set.

    The set is summarized by order-free sums of two 64-bit hashes of its distinct rows, so
    no row set is gathered in one place.
    """
    cells = [F.col("best_feature_idx").cast("string"), F.col("concept_id").cast("string"), F.col("auroc_inflation").cast("string")]
    distinct = rows.where(F.col("auroc_inflation").isNotNull()).select(model, point, F.concat_ws("|", *cells).alias("_row")).distinct()
    marks = distinct.groupBy(model, point).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.xxhash64("_row").cast("decimal(38,0)")).alias("_a"),
        F.sum(F.xxhash64(F.lit("salt"), "_row").cast("decimal(38,0)")).alias("_b"),
    )
    same = Window.partitionBy(model, "_n", "_a", "_b")
    first = F.min(point).over(same)
    return marks.select(model, point, F.when(first < F.col(point), first).alias("duplicate_of"))
