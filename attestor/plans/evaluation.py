"""End-to-end runs: encode, probe, permuted control, sweep, confirmatory fit."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import inference as N
from attestor.operators import probing as P
from attestor.operators import vectors as V
from attestor.operators.registry import sweep_rows
from attestor.session import materialize

# Default sweep points and the experimental evidence codes of a probe run.
SWEEP_POINTS = [10, 20, 50, 100, 150, 200, 300]
EXPERIMENTAL_EVIDENCE = ["EXP", "IDA", "IPI", "IMP", "IGI", "IEP"]


def encode_units(
    vectors: DataFrame, dictionary: V.Dictionary, k: int, *, normalize: bool, stats: DataFrame | None = None
) -> DataFrame:
    """Sparse features of all units, written once for every later stage.

    ``normalize`` has no default: evaluation encodes raw vectors, inspection normalized.
    """
    if normalize:
        stats = materialize(V.norm_stats(vectors)) if stats is None else stats
        vectors = V.normalize(vectors, stats)
    return materialize(V.topk_encode(vectors, dictionary, k))


def evaluate(
    features: DataFrame,
    units: DataFrame,
    labels: DataFrame,
    config: P.ProbeConfig,
    *,
    names: DataFrame | None = None,
    edges: DataFrame | None = None,
    n_permutations: int = 0,
) -> dict[str, DataFrame]:
    """Report, summary, and the permuted-label decomposition when asked for."""
    context = P.prepare(features, units, config)
    real = null = None
    if n_permutations > 0:
        real, null = P.real_and_permuted(context, labels, draws=n_permutations)
    report = materialize(
        P.probe_concepts(features, units, labels, names=names, edges=edges, context=context, probed=real)
    )
    out = {"report": report, "summary": P.report_summary(report)}
    if null is not None:
        out["decomposition"] = P.decompose_draws(report, null)
    return out


def sweep(
    features: DataFrame, units: DataFrame, labels: DataFrame, config: P.ProbeConfig, *, points: list[int] | None = None
) -> DataFrame:
    """Probe results of every sweep point.

    A concept's own probe does not depend on the point, only its eligibility does, so the
    probe runs once at the smallest point and each point filters and re-applies its cap.
    """
    points = sorted(points or SWEEP_POINTS)
    distinct = labels.select("unit_id", "concept_id").distinct()
    base = materialize(
        P.probe_concepts(features, units, distinct, replace(config, min_positives=points[0]))
    )
    ceiling = F.col("n_total")
    parts = []
    for point in points:
        eligible = P.eligible_concepts(distinct, min_positives=point, max_concepts=config.max_concepts)
        kept = base.join(eligible.select("concept_id"), "concept_id", "left_semi")
        kept = kept.where((F.col("n_positives") >= point) & (F.col("n_positives") < ceiling - point))
        parts.append(kept.withColumn("min_positives", F.lit(point)))
    return reduce(DataFrame.unionByName, parts)


def confirmatory_fit(sweeps: DataFrame, registry: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Pooled verified-rate fit over models: join to the registry, then fit."""
    rows = sweep_rows(sweeps, registry, keys=["model"])
    return N.fit_pooled_interaction(
        rows.select("model", F.col("min_positives").alias("x"), F.col("target").alias("y"), F.col("feature_idx").alias("cluster")),
        **options,
    )


def inflation_curves(sweeps: DataFrame, **options) -> dict[str, DataFrame]:
    """Points with intervals, per-model and pooled log-log fits, random-effects slope."""
    points = materialize(N.curve_points(sweeps, **options))
    per_model, pooled = N.log_log_fits(points)
    return {"points": points, "fits": per_model, "pooled": pooled, "random_effects": N.pool_route(per_model)}
