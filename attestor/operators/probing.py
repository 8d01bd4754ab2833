"""Concept probing: best feature per concept and how inflated its score is."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.auroc import (
    explicit_auroc,
    feature_auroc,
    precision_levels,
    reflect,
    score_levels,
    split_pool_counts,
    threshold_levels,
    untouched_best,
)
from attestor.operators.inference import bootstrap_mean
from attestor.operators.linear_probe import FIT_ROWS, linear_models, model_auroc
from attestor.operators.splits import (
    Pool,
    make_pool,
    make_pools,
    permute_labels,
    rank_units,
    split_members,
    split_positives,
    subsample_positives,
)
from attestor.session import materialize

ARMS = ["select", "held"]
SUMMARY_THRESHOLDS = (0.65, 0.70, 0.75, 0.80)


@dataclass(frozen=True)
class ProbeConfig:
    """Knobs of a probe run, with the defaults of a standard evaluation."""

    min_positives: int = 50
    max_concepts: int | None = None  # every eligible concept
    train_fraction: float = 0.8
    held_out_fraction: float = 0.5
    min_hard_negatives: int = 10
    seed: str = "42"
    multivariate: bool = False  # also fit and score a linear model of all features per concept
    regularization: float = 0.01
    max_iter: int = 500
    fit_rows: int = FIT_ROWS

    @property
    def test_fraction(self) -> float:
        return round(1.0 - self.train_fraction, 12)


def eligible_concepts(labels: DataFrame, *, min_positives: int, max_concepts: int | None = None) -> DataFrame:
    """Concepts with enough labels; counts cover all labels. A cap keeps the most frequent."""
    counts = labels.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_labels")).where(F.col("n_labels") >= min_positives)
    if max_concepts is None:
        return counts
    return counts.orderBy(F.col("n_labels").desc(), F.col("concept_id").asc()).limit(max_concepts)


@dataclass(frozen=True)
class ProbeContext:
    """What every probe over the same units shares: unit order, pool and pool tie blocks."""

    features: DataFrame
    ranked: DataFrame
    pool: Pool
    pooled: DataFrame
    config: ProbeConfig
    order_keys: tuple[str, ...] = ()  # ('repeat',) when every repeat has its own unit order

    @property
    def fractions(self) -> dict[str, float]:
        return {"test_fraction": self.config.test_fraction, "held_out_fraction": self.config.held_out_fraction}


def prepare(features: DataFrame, units: DataFrame, config: ProbeConfig, *, repeats: int | None = None) -> ProbeContext:
    """Rank the units and count the pool's tie blocks: the only full pass over features.

    Real labels, every permutation draw and every sweep point reuse the result. With
    ``repeats`` each repeat has its own order and pool, all counted in the same pass.
    """
    ranked = rank_units(units, config.seed, repeats=repeats)
    pools = make_pools(
        ranked,
        seed=config.seed,
        test_fraction=config.test_fraction,
        held_out_fraction=config.held_out_fraction,
        repeats=repeats,
    )
    order_keys = () if repeats is None else ("repeat",)
    # all pools have the same cuts, so any of them describes the split by rank
    return ProbeContext(features, ranked, pools[0], split_pool_counts(features, pools, list(order_keys)), config, order_keys)


def probe_positives(
    context: ProbeContext,
    positives: DataFrame,
    *,
    keys: list[str] | None = None,
    min_positives: int | None = None,
    split: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Select on one part of the test split, evaluate the choice on the other.

    All concepts in ``keys`` and both arms share one ranking; the held-out score is read
    from the same pair row the selection was made on.
    """
    keys = keys or ["concept_id"]
    pool, pooled, test = context.pool, context.pooled, context.config.test_fraction
    floor = context.config.min_positives if min_positives is None else min_positives
    parts, cuts = split or split_positives(
        positives, context.ranked, pool, keys=keys, order_keys=list(context.order_keys), **context.fractions
    )
    cuts = cuts.where((F.col("n_pos") >= floor) & (F.col("n_pos") < pool.n_units - floor))
    best = _select_and_hold(context, pool, pooled, parts, cuts.where(F.col("held_neg") > 0), keys)
    if math.floor(test * floor + 0.5) < 2:
        # concepts too small for a held-out part select on the whole test part
        whole = pooled.select(
            *context.order_keys, "feature_idx", "score", (F.col("pool_select") + F.col("pool_held")).alias("pool_select"),
            F.lit(0).cast("bigint").alias("pool_held"),
        )
        undivided = replace(pool, held_cut=0, held_key="")
        small = _select_and_hold(context, undivided, whole, parts, cuts.where(F.col("held_neg") == 0), keys)
        best = best.unionByName(small)
    return best


def _select_and_hold(
    context: ProbeContext, pool: Pool, pooled: DataFrame, parts: DataFrame, cuts: DataFrame, keys: list[str]
) -> DataFrame:
    parts = parts.join(cuts.select(*keys), keys, "left_semi")
    order_keys = list(context.order_keys)
    members = split_members(parts, cuts, context.ranked, pool, keys, order_keys)
    sizes = cuts.select(
        *keys,
        F.col("n_pos").alias("n_positives"),
        F.lit(pool.n_units).cast("bigint").alias("n_total"),
        F.col("select_pos").alias("n_pos_select"),
        F.col("select_neg").alias("n_neg_select"),
        F.col("held_pos").alias("n_pos_held"),
        F.col("held_neg").alias("n_neg_held"),
    )
    pairs = materialize(
        feature_auroc(context.features, pooled, members, sizes, keys=keys, arms=ARMS, pool_keys=order_keys)
    )
    others = untouched_best(
        pairs, pooled, sizes, keys=keys, arms=ARMS, select_arm="select", pool_keys=order_keys
    )
    return best_feature(pairs.unionByName(others), keys)


def best_feature(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """First feature with the highest reflected selection score, and its held-out score.

    The direction is fixed by the selection arm and never reconsidered on held-out data.
    """
    score = reflect(F.col("raw_select"))
    forward = F.coalesce(F.col("raw_select") >= 0.5, F.lit(True))
    held = F.when(forward, F.col("raw_held")).otherwise(1 - F.col("raw_held"))
    candidate = F.struct(
        F.round(score, 12).alias("rank_score"),
        (-F.col("feature_idx")).alias("rank_idx"),
        F.col("feature_idx").alias("best_feature_idx"),
        score.alias("single_feature_auroc"),
        forward.alias("positive_direction"),
        held.alias("held_out_auroc"),
    )
    chosen = pairs.groupBy(*keys, "n_positives", "n_total").agg(F.max(candidate).alias("_best"))
    return chosen.select(
        *keys,
        "n_positives",
        "n_total",
        "_best.best_feature_idx",
        "_best.single_feature_auroc",
        "_best.positive_direction",
        "_best.held_out_auroc",
        auroc_inflation(F.col("_best.single_feature_auroc"), F.col("_best.held_out_auroc")).alias("auroc_inflation"),
    )


def auroc_inflation(selected: Column, held_out: Column) -> Column:
    """Selected minus held-out; NULL when there is no held-out score."""
    return selected - held_out


def hard_negative_auroc(
    context: ProbeContext,
    positives: DataFrame,
    split: tuple[DataFrame, DataFrame],
    best: DataFrame,
    edges: DataFrame,
    labels: DataFrame,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Held-out score of the chosen feature against units that carry a sibling concept.

    ``edges`` has (child_id, parent_id). Only held-out units count, so labels are cut to
    them before they meet the ontology, and that is cut to the probed concepts; the score is NULL below
    ``min_hard_negatives`` but the count is always reported.
    """
    keys = ["concept_id"]
    features, config = context.features, context.config
    parts, cuts = split
    widest = cuts.agg(F.max("held_cut").alias("c")).scalar()
    held_units = context.ranked.where(F.col("unit_rank") <= widest)
    held_labels = labels.select("unit_id", "concept_id").join(held_units, "unit_id")
    carriers = hard_negatives(held_labels, edges, positives, concepts=best, aliases=aliases)
    held_carriers = (
        carriers.join(held_units, "unit_id")
        .join(cuts.select("concept_id", "held_cut"), keys)
        .where(F.col("unit_rank") <= F.col("held_cut"))
    )
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = (
        parts.where(F.col("part") == "held")
        .select("concept_id", "unit_id", one.alias("pos"), none.alias("neg"))
        .unionByName(held_carriers.select("concept_id", "unit_id", none.alias("pos"), one.alias("neg")))
    )
    chosen = best.select("concept_id", F.col("best_feature_idx").alias("feature_idx"), "positive_direction")
    wanted = features.join(chosen.select("feature_idx").distinct(), "feature_idx", "left_semi")
    scored = rows.join(chosen, keys).join(wanted, ["unit_id", "feature_idx"], "left")
    scored = scored.select("concept_id", "pos", "neg", F.coalesce("act", F.lit(0.0)).alias("score"))
    measured = best.select("concept_id", "positive_direction").join(explicit_auroc(scored, keys), keys, "left")
    raw = F.col("raw_auroc")
    n_hard = F.coalesce(F.col("n_neg"), none)
    enough = (n_hard >= config.min_hard_negatives) & (F.col("n_pos") > 0)
    return measured.select(
        "concept_id",
        F.when(enough, F.when(F.col("positive_direction"), raw).otherwise(1 - raw)).alias(
            "hard_negative_held_out_auroc"
        ),
        n_hard.alias("n_hard_negatives"),
    )


def parents_of(edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(concept_id, parent_id). Aliases (alt_id, concept_id) inherit their concept's parents."""
    own = edges.select(F.col("child_id").alias("concept_id"), "parent_id")
    if aliases is not None:
        named = aliases.select("alt_id", F.col("concept_id").alias("child_id"))
        own = own.unionByName(edges.join(named, "child_id").select(F.col("alt_id").alias("concept_id"), "parent_id"))
    return own.distinct()


def siblings_of(edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(concept_id, sibling_id): concepts sharing at least one direct parent.

    ``aliases`` (alt_id, concept_id) inherit their concept's parents but are nobody's child.
    The pairs of a parent are many by definition; :func:`hard_negatives` does without them.
    """
    child = edges.select(F.col("child_id").alias("sibling_id"), "parent_id").distinct()
    shared = parents_of(edges, aliases).join(child, "parent_id").where(F.col("concept_id") != F.col("sibling_id"))
    return shared.select("concept_id", "sibling_id").distinct()


def hard_negatives(
    labels: DataFrame, edges: DataFrame, positives: DataFrame, *, concepts: DataFrame | None = None, aliases: DataFrame | None = None
) -> DataFrame:
    """(concept_id, unit_id) of units with a sibling's label that are not positives.

    The ontology is cut to the parents of ``concepts`` (default: those with positives)
    before labels are touched. A unit is then one row per parent with its first and last
    label under it, which tells whether it has a label other than the concept's own; pairs
    of siblings are never written.
    """
    wanted = (positives if concepts is None else concepts).select("concept_id").distinct()
    parents = materialize(parents_of(edges, aliases).join(wanted, "concept_id", "left_semi"))
    child = edges.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").select(
        F.col("child_id").alias("concept_id"), "parent_id"
    ).distinct()
    under = labels.select("unit_id", "concept_id").join(child, "concept_id").groupBy("parent_id", "unit_id").agg(
        F.min("concept_id").alias("_lo"), F.max("concept_id").alias("_hi")
    )
    other = (F.col("_lo") != F.col("concept_id")) | (F.col("_hi") != F.col("concept_id"))
    carriers = under.join(parents, "parent_id").where(other).select("concept_id", "unit_id").distinct()
    return carriers.join(positives.select("concept_id", "unit_id"), ["concept_id", "unit_id"], "left_anti")


def probe_concepts(
    features: DataFrame,
    units: DataFrame,
    labels: DataFrame,
    config: ProbeConfig | None = None,
    *,
    names: DataFrame | None = None,
    edges: DataFrame | None = None,
    aliases: DataFrame | None = None,
    context: ProbeContext | None = None,
    probed: DataFrame | None = None,
) -> DataFrame:
    """Full report: eligible concepts, best feature, held-out and hard-negative scores.

    The label source is an argument: proteins, windows and texts use the same call.
    ``probed`` is a probe of the same labels that was run before, see
    :func:`real_and_permuted`.
    """
    context = context or prepare(features, units, config or ProbeConfig())
    config = context.config
    labels = labels.select("unit_id", "concept_id").distinct()
    wanted = eligible_concepts(labels, min_positives=config.min_positives, max_concepts=config.max_concepts)
    positives = labels.join(wanted.select("concept_id"), "concept_id", "left_semi")
    split = split_positives(positives, context.ranked, context.pool, keys=["concept_id"], **context.fractions)
    report = probe_positives(context, positives, split=split) if probed is None else probed
    if edges is not None:
        report = materialize(report)
        hard = hard_negative_auroc(context, positives, split, report, edges, labels, aliases)
        report = report.join(hard, "concept_id", "left")
    else:
        report = report.withColumns(
            {
                "hard_negative_held_out_auroc": F.lit(None).cast("double"),
                "n_hard_negatives": F.lit(None).cast("bigint"),
            }
        )
    if config.multivariate:
        fitted = multivariate_auroc(context, split).select("concept_id", "multivariate_auroc", F.col("reason").alias("multivariate_reason"))
        report = report.join(fitted, "concept_id", "left")
    else:
        report = report.withColumns(
            {"multivariate_auroc": F.lit(None).cast("double"), "multivariate_reason": F.lit("not asked for")}
        )
    if names is not None:
        report = report.join(names.select("concept_id", F.col("name").alias("_name")), "concept_id", "left")
        return report.withColumn("concept_name", F.coalesce("_name", "concept_id")).drop("_name")
    return report.withColumn("concept_name", F.col("concept_id").cast("string"))


def report_summary(report: DataFrame, *, threshold: float = 0.7, draws: int = 2000, seed: str = "42") -> DataFrame:
    """One row: concept counts, shares above scores, means and counts of every score, and the
    interval of the mean inflation from resampling best features (``draws=0`` leaves it out)."""
    auroc, hard = F.col("single_feature_auroc"), F.col("hard_negative_held_out_auroc")
    out = report.agg(
        F.count(F.lit(1)).alias("n_concepts"),
        F.sum((auroc >= threshold).cast("bigint")).alias("n_above"),
        F.avg((auroc >= threshold).cast("double")).alias("fraction_above"),
        F.avg(auroc).alias("mean_single_feature_auroc"),
        F.avg("held_out_auroc").alias("mean_held_out_auroc"),
        F.avg("auroc_inflation").alias("mean_auroc_inflation"),
        F.max(auroc).alias("max_single_feature_auroc"),
        F.count("auroc_inflation").alias("n_held_out"),
        F.count(hard).alias("n_hard_negative"),
        F.avg(hard).alias("mean_hard_negative_auroc"),
        F.avg("multivariate_auroc").alias("mean_multivariate_auroc"),
        *[F.avg((auroc >= t).cast("double")).alias(f"fraction_above_{round(100 * t)}") for t in SUMMARY_THRESHOLDS],
    )
    if not draws:
        return out
    boot = materialize(
        bootstrap_mean(
            report.withColumn("_all", F.lit(0)), keys=["_all"], value="auroc_inflation", cluster="best_feature_idx", draws=draws, seed=seed
        )
    )
    return out.select("*", *[boot.select(c).scalar().alias(f"inflation_{c}") for c in ("ci_lo", "ci_hi", "n_clusters")])


def top_results(report: DataFrame, n: int) -> DataFrame:
    return report.orderBy(F.col("single_feature_auroc").desc(), F.col("concept_id").asc()).limit(n)


def _permuted(context: ProbeContext, labels: DataFrame, draws: int) -> DataFrame:
    """(draw, concept_id, unit_id) of eligible concepts under permuted labels."""
    config = context.config
    inside = labels.select("unit_id", "concept_id").distinct().join(context.ranked.select("unit_id"), "unit_id", "left_semi")
    wanted = eligible_concepts(inside, min_positives=config.min_positives, max_concepts=config.max_concepts)
    moved = permute_labels(inside, draws=draws, seed=config.seed)
    return moved.join(wanted.select("concept_id"), "concept_id", "left_semi")


def permuted_probe(context: ProbeContext, labels: DataFrame, *, draws: int) -> DataFrame:
    """Probe every permutation draw in one job; the draw is a key, the ranking is shared."""
    return probe_positives(context, _permuted(context, labels, draws), keys=["draw", "concept_id"])


def real_and_permuted(context: ProbeContext, labels: DataFrame, *, draws: int) -> tuple[DataFrame, DataFrame]:
    """(real, permuted) probes from one run in which the real labels are draw -1."""
    config = context.config
    distinct = labels.select("unit_id", "concept_id").distinct()
    wanted = eligible_concepts(distinct, min_positives=config.min_positives, max_concepts=config.max_concepts)
    real = distinct.join(wanted.select("concept_id"), "concept_id", "left_semi")
    columns = ["draw", "concept_id", "unit_id"]
    positives = real.withColumn("draw", F.lit(-1)).select(*columns).unionByName(_permuted(context, labels, draws).select(*columns))
    probed = materialize(probe_positives(context, materialize(positives), keys=["draw", "concept_id"]))
    return probed.where("draw = -1").drop("draw"), probed.where("draw >= 0")


def decompose(real: DataFrame, permuted: DataFrame) -> DataFrame:
    """Inflation under real labels minus inflation under permuted labels, one draw."""
    null = permuted.select("concept_id", F.col("auroc_inflation").alias("permuted_inflation"))
    return real.select("concept_id", F.col("auroc_inflation").alias("real_inflation")).join(null, "concept_id").withColumn(
        "confounding_estimate", F.col("real_inflation") - F.col("permuted_inflation")
    )


def decompose_draws(real: DataFrame, permuted: DataFrame, *, confidence: float = 0.95) -> DataFrame:
    """Decomposition over all draws: mean and percentile interval per concept."""
    tail = (1.0 - confidence) / 2
    joined = (
        permuted.select("draw", "concept_id", F.col("auroc_inflation").alias("_null"))
        .join(real.select("concept_id", F.col("auroc_inflation").alias("_real")), "concept_id")
        .withColumn("_rest", F.col("_real") - F.col("_null"))
        .where(F.col("_null").isNotNull() & F.col("_rest").isNotNull())
    )
    return joined.groupBy("concept_id").agg(
        F.first("_real").alias("real_inflation"),
        F.avg("_null").alias("mean_permuted_inflation"),
        F.percentile("_null", tail).alias("permuted_lo"),
        F.percentile("_null", 1 - tail).alias("permuted_hi"),
        F.avg("_rest").alias("mean_confounding"),
        F.percentile("_rest", tail).alias("confounding_lo"),
        F.percentile("_rest", 1 - tail).alias("confounding_hi"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def controlled_subsampling(
    features: DataFrame,
    units: DataFrame,
    positives: DataFrame,
    config: ProbeConfig,
    *,
    targets: list[int],
    repeats: int,
    confidence: float = 0.95,
) -> DataFrame:
    """Shrink a concept's positives to each target size, ``repeats`` times, and re-probe.

    Each repeat has its own split: the unit order is reseeded per repeat, so repeats do
    not share a held-out part.
    """
    smallest = positives.groupBy("concept_id").count().agg(F.min("count")).first()[0]
    if targets and (smallest or 0) < max(targets):
        raise ValueError(f"a concept has only {smallest} positives, cannot subsample {max(targets)}")
    drawn = subsample_positives(positives, targets=targets, repeats=repeats, seed=config.seed)
    probed = materialize(
        probe_positives(
            prepare(features, units, config, repeats=repeats),
            drawn,
            keys=["concept_id", "target", "repeat"],
            min_positives=min(targets),  # every draw has exactly its target's positives
        )
    )
    tail = (1.0 - confidence) / 2
    natural = positives.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_natural_positives"))
    summary = probed.groupBy("concept_id", "target").agg(
        F.count(F.lit(1)).alias("n_repeats_successful"),
        F.avg("single_feature_auroc").alias("mean_single_feature_auroc"),
        F.avg("held_out_auroc").alias("mean_held_out_auroc"),
        F.avg("auroc_inflation").alias("mean_auroc_inflation"),
        F.when(F.count("auroc_inflation") >= 2, F.percentile("auroc_inflation", tail)).alias("inflation_lo"),
        F.when(F.count("auroc_inflation") >= 2, F.percentile("auroc_inflation", 1 - tail)).alias("inflation_hi"),
    )
    return summary.join(natural, "concept_id")


METRICS = ("auroc", "average_precision", "f1", "mcc")


def selection_inflation(
    features: DataFrame, positives: DataFrame, n_units: int, *, metric: str = "auroc", threshold: float = 0.0
) -> DataFrame:
    """Mean over draws of the best feature's score minus the mean feature's score, both over
    all stored features, with spread and percentile interval of the best score.

    ``positives`` has (draw, concept_id, unit_id), usually permuted labels; the measured
    mean is the null level of the score. ``metric`` is one of ``METRICS``; ``threshold`` is
    that of ``f1`` and ``mcc``. Features that a concept never touches count with their exact
    scores; no concept x feature grid is built.
    """
    keys = ["draw", "concept_id"]
    if metric == "auroc":
        per_draw = score_levels(features, positives, n_units, keys).withColumnsRenamed({"max_auroc": "max_value", "mean_auroc": "mean_value"})
    elif metric == "average_precision":
        per_draw = precision_levels(features, positives, n_units, keys)
    elif metric in METRICS:
        per_draw = threshold_levels(features, positives, n_units, keys, metric=metric, threshold=threshold)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return per_draw.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.avg("max_value").alias("mean_of_max"),
        F.avg("mean_value").alias("mean_of_mean"),
        (F.avg("max_value") - F.avg("mean_value")).alias("inflation_above_null"),
        F.stddev_samp("max_value").alias("sd_of_max"),
        F.percentile("max_value", 0.025).alias("max_lo"),
        F.percentile("max_value", 0.975).alias("max_hi"),
    )


def multivariate_auroc(
    context: ProbeContext, split: tuple[DataFrame, DataFrame], *, min_positives: int | None = None
) -> DataFrame:
    """``concept_id, multivariate_auroc, n_fit, converged, reason`` of every splittable concept.

    A penalized logistic fit over all features, standardized on the train part, is scored on
    the test part of the same split as the single features. The score is NULL, with a reason,
    where no fit exists.
    """
    config = context.config
    floor = config.min_positives if min_positives is None else min_positives
    parts, cuts = split
    cuts = cuts.where((F.col("n_pos") >= floor) & (F.col("n_pos") < context.pool.n_units - floor))
    kept = (parts.join(cuts.select("concept_id"), "concept_id", "left_semi"), cuts)
    models = materialize(
        linear_models(
            context.features,
            context.ranked,
            kept,
            context.pool.n_units,
            strength=config.regularization,
            max_iter=config.max_iter,
            fit_rows=config.fit_rows,
        )
    )
    scores = model_auroc(context.features, context.ranked, kept, models)
    return models.select("concept_id", "n_fit", "converged", "reason").join(scores, "concept_id", "left")
