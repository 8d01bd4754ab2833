"""Rank-sum AUROC, average precision and threshold metrics of every feature.

Kernel. For a concept c and a feature f the Mann-Whitney count is the sum, over c's
positives, of the negatives scored lower plus half of the negatives tied. Negatives are
the shared pool plus c's few corrections (see ``splits``), so

    below(c, f, s) = pool_below(f, s) + correction_below(c, f, s)

``pool_below`` is ranked once per feature for all concepts, all permutation draws and
both arms. Units without a stored value score 0 and are one tie block that is only
counted. Work is proportional to stored values of the pool plus stored values of the
positives, never to units x features x concepts. All windows run over distinct scores
inside value buckets, so one hot feature or concept spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.ordering import running_totals, score_bucket, stable_rank
from attestor.session import materialize


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def nonzero(features: DataFrame) -> DataFrame:
    """Stored values that matter; a stored 0 is the same as an absent value."""
    return features.where(F.col("act") != 0)


def pool_counts(
    features: DataFrame, arms: dict[str, Column] | None = None, *, pool_keys: list[str] | None = None
) -> DataFrame:
    """Tie blocks ``(feature_idx, score, pool_<arm>)`` of the pool, combined map-side.

    ``arms`` are booleans over the feature row; without them every row is in ``all``.
    """
    arms = arms or {"all": F.lit(True)}
    flags = [cond.cast("bigint").alias(f"pool_{arm}") for arm, cond in arms.items()]
    keys = [*(pool_keys or []), "feature_idx"]
    rows = nonzero(features).select(*keys, F.col("act").alias("score"), *flags)
    return materialize(rows.groupBy(*keys, "score").agg(*[F.sum(f"pool_{a}").alias(f"pool_{a}") for a in arms]))


def split_pool_counts(features: DataFrame, pools: list, pool_keys: list[str] | None = None) -> DataFrame:
    """Pool tie blocks of the selection and held-out arms, of one pool or several.

    Membership is a digest test on the id: once per row for the filter and once more for
    the rows that pass; the second arm is the complement of the first. With several pools
    (``pool_keys`` has one name) a row is copied to the pools it belongs to.
    """
    unit = F.col("unit_id")
    if not pool_keys:
        (pool,) = pools
        held = features.where(pool.in_test(unit)).select("feature_idx", "act", pool.in_held(unit).alias("_held"))
    else:
        (name,) = pool_keys
        options = F.array(
            *[
                F.struct(F.lit(i).alias("no"), p.in_test(unit).alias("test"), p.in_held(unit).alias("held"))
                for i, p in enumerate(pools)
            ]
        )
        held = features.select("feature_idx", "act", F.explode(F.filter(options, lambda o: o["test"])).alias("_o"))
        held = held.select(F.col("_o.no").alias(name), "feature_idx", "act", F.col("_o.held").alias("_held"))
    return pool_counts(held, {"select": ~F.col("_held"), "held": F.col("_held")}, pool_keys=pool_keys)


def member_blocks(features: DataFrame, members: DataFrame, keys: list[str], arms: list[str]) -> DataFrame:
    """Tie blocks of the concepts' own rows: positives and corrections per score."""
    columns = [f"{side}_{a}" for a in arms for side in ("pos", "neg")]
    rows = members.join(nonzero(features), "unit_id")
    return rows.groupBy(*keys, "feature_idx", F.col("act").alias("score")).agg(
        *[F.sum(c).alias(c) for c in columns]
    )


def ranked_blocks(
    pool: DataFrame, blocks: DataFrame, keys: list[str], arms: list[str], pool_keys: list[str] | None = None
) -> DataFrame:
    """Member blocks with the negatives strictly below and tied, per arm."""
    base_keys = [*(pool_keys or []), "feature_idx"]
    scope = [*keys, "feature_idx"]
    own = running_totals(
        blocks.withColumn("_b", score_bucket(F.col("score"))),
        by=scope,
        bucket="_b",
        order=["score"],
        totals={f"_own_{a}": F.col(f"neg_{a}") for a in arms},
    ).drop("_b")
    # scores that occur only among members get an empty pool block, so the lookup is an equi-join
    probes = blocks.select(*base_keys, "score", *[_zero().alias(f"pool_{a}") for a in arms])
    merged = pool.unionByName(probes).groupBy(*base_keys, "score").agg(
        *[F.sum(f"pool_{a}").alias(f"pool_{a}") for a in arms]
    )
    base = running_totals(
        merged.withColumn("_b", score_bucket(F.col("score"))),
        by=base_keys,
        bucket="_b",
        order=["score"],
        totals={f"_base_{a}": F.col(f"pool_{a}") for a in arms},
    ).drop("_b")
    return own.join(base, [*base_keys, "score"])


def pool_profile(pool: DataFrame, arms: list[str], pool_keys: list[str] | None = None) -> DataFrame:
    """Per feature: pool units with a value, and with a negative value, per arm."""
    return pool.groupBy(*(pool_keys or []), "feature_idx").agg(
        *[F.sum(f"pool_{a}").alias(f"_nz_{a}") for a in arms],
        *[F.sum(F.when(F.col("score") < 0, F.col(f"pool_{a}")).otherwise(_zero())).alias(f"_low_{a}") for a in arms],
    )


def feature_auroc(
    features: DataFrame,
    pool: DataFrame,
    members: DataFrame,
    sizes: DataFrame,
    *,
    keys: list[str],
    arms: list[str],
    pool_keys: list[str] | None = None,
) -> DataFrame:
    """Unreflected AUROC ``raw_<arm>`` of every (concept, feature) pair with a stored value.

    ``sizes`` has ``n_pos_<arm>`` and ``n_neg_<arm>`` per concept. NULL when a class is
    empty. ``pool_keys`` (a subset of ``keys``) names the columns that tell several pools
    apart. Pairs that do not appear have no stored value among the concept's members;
    :func:`untouched_best` covers them.
    """
    scope = [*keys, "feature_idx"]
    blocks = materialize(member_blocks(features, members, keys, arms))
    ranked = ranked_blocks(pool, blocks, keys, arms, pool_keys)
    base_keys = [*(pool_keys or []), "feature_idx"]
    up, down = F.col("score") > 0, F.col("score") < 0
    sums: list[Column] = []
    for a in arms:
        pos, neg = F.col(f"pos_{a}"), F.col(f"neg_{a}")
        below = F.col(f"_base_{a}") + F.col(f"_own_{a}") + (F.col(f"pool_{a}") + neg) * 0.5
        sums += [
            F.sum(pos * below).alias(f"_u_{a}"),
            F.sum(pos).alias(f"_p_{a}"),
            F.sum(F.when(up, pos).otherwise(_zero())).alias(f"_pup_{a}"),
            F.sum(neg).alias(f"_d_{a}"),
            F.sum(F.when(down, neg).otherwise(_zero())).alias(f"_dlow_{a}"),
        ]
    pairs = ranked.groupBy(*scope).agg(*sums)
    pairs = pairs.join(pool_profile(pool, arms, pool_keys), base_keys, "left").join(sizes, keys)
    out: list[Column] = []
    for a in arms:
        n_pos, n_neg = F.col(f"n_pos_{a}"), F.col(f"n_neg_{a}")
        nz = F.coalesce(F.col(f"_nz_{a}"), _zero()) + F.col(f"_d_{a}")
        low = F.coalesce(F.col(f"_low_{a}"), _zero()) + F.col(f"_dlow_{a}")
        silent = n_neg - nz
        u = F.col(f"_u_{a}") + F.col(f"_pup_{a}") * silent + (n_pos - F.col(f"_p_{a}")) * (low + silent * 0.5)
        out.append(F.try_divide(u.cast("double"), (n_pos * n_neg).cast("double")).alias(f"raw_{a}"))
    size_columns = [c for c in sizes.columns if c not in keys]
    return pairs.select(*scope, *size_columns, *out)


def untouched_best(
    pairs: DataFrame,
    pool: DataFrame,
    sizes: DataFrame,
    *,
    keys: list[str],
    arms: list[str],
    select_arm: str,
    pool_keys: list[str] | None = None,
) -> DataFrame:
    """Best feature among those with no stored value for a concept's members.

    For such a feature every positive is in the zero block, so its reflected AUROC is
    0.5 + |low - high| / (2 n_neg) and the best one is the first feature, by that count,
    missing from the concept's list. The gap is found by comparing list positions with
    global positions; no concept x feature grid is built.
    """
    pool_keys = pool_keys or []
    tilt = F.abs(2 * F.col(f"_low_{select_arm}") - F.col(f"_nz_{select_arm}"))
    profile = materialize(pool_profile(pool, arms, pool_keys).withColumn("_against", -tilt))
    listed = running_totals(
        profile.withColumn("_b", score_bucket(F.col("_against"))),
        by=pool_keys,
        bucket="_b",
        order=["_against", "feature_idx"],
        totals={"_place": F.lit(1).cast("bigint")},
    )
    listed = materialize(listed.withColumn("_place", F.col("_place") + 1).drop("_b", "_against"))
    touched = pairs.select(*keys, "feature_idx").join(listed.select(*pool_keys, "feature_idx", "_place"), [*pool_keys, "feature_idx"])
    seen = stable_rank(materialize(touched), by=keys, key="_place", rank="_at", bucket=F.floor(F.col("_place") / 65536))
    gap = seen.groupBy(*keys).agg((F.sum((F.col("_at") == F.col("_place")).cast("int")) + 1).alias("_place"))
    free = sizes.join(gap, keys, "left").withColumn("_place", F.coalesce(F.col("_place"), F.lit(1)).cast("bigint"))
    picked = free.join(listed, [*pool_keys, "_place"])
    out = []
    for a in arms:
        n_neg = F.col(f"n_neg_{a}")
        raw = (F.col(f"_low_{a}") + (n_neg - F.col(f"_nz_{a}")) * 0.5) / F.nullif(n_neg, F.lit(0))
        out.append(F.when(F.col(f"n_pos_{a}") > 0, raw).alias(f"raw_{a}"))
    size_columns = [c for c in sizes.columns if c not in keys]
    return picked.select(*keys, "feature_idx", *size_columns, *out)


def reflect(raw: Column) -> Column:
    """Either direction counts: max(a, 1-a); 0.5 when a class was empty."""
    return F.coalesce(F.greatest(raw, 1 - raw), F.lit(0.5))


def _whole_set(features: DataFrame, positives: DataFrame, n_units: int, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, pool, sizes) of a run over all units without a split."""
    counts = positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos_all"))
    sizes = counts.withColumn("n_neg_all", F.lit(n_units).cast("bigint") - F.col("n_pos_all"))
    members = positives.select(
        *keys, "unit_id", F.lit(1).cast("bigint").alias("pos_all"), F.lit(-1).cast("bigint").alias("neg_all")
    )
    pool = pool_counts(features)
    return feature_auroc(features, pool, members, sizes, keys=keys, arms=["all"]), pool, sizes


def whole_set_auroc(features: DataFrame, positives: DataFrame, n_units: int, keys: list[str] | None = None) -> DataFrame:
    """AUROC of every stored (concept, feature) pair over all units, no split.

    A feature without a stored value among a concept's positives has no row here;
    :func:`full_auroc` writes all pairs, :func:`whole_set_best` and :func:`score_levels`
    take them into account without doing so.
    """
    pairs, _, _ = _whole_set(features, positives, n_units, keys or ["concept_id"])
    return pairs.withColumnRenamed("raw_all", "raw_auroc").withColumn("auroc", reflect(F.col("raw_auroc")))


def every_pair(profile: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every feature of ``profile`` with every concept of ``sizes``, whose list goes to each task."""
    listed = sizes.agg(F.collect_list(F.struct(*sizes.columns)).alias("c")).scalar()
    return profile.withColumn("_c", F.explode(listed)).select(*profile.columns, *[F.col(f"_c.{c}").alias(c) for c in sizes.columns])


def _untouched_raw(n_neg: Column, nz: Column, low: Column) -> Column:
    """AUROC of a feature that is silent on all positives."""
    return (low + (n_neg - nz) * 0.5) / F.nullif(n_neg, F.lit(0))


def full_auroc(features: DataFrame, positives: DataFrame, n_units: int, keys: list[str] | None = None) -> DataFrame:
    """AUROC of every concept with every feature that is ever stored: the explicit long form.

    The result has concepts x features rows by definition; ask for it only to store it.
    """
    keys = keys or ["concept_id"]
    pairs, pool, sizes = _whole_set(features, positives, n_units, keys)
    grid = every_pair(pool_profile(pool, ["all"]), materialize(sizes))
    joined = grid.join(pairs.select(*keys, "feature_idx", "raw_all"), [*keys, "feature_idx"], "left")
    silent = F.when(F.col("n_pos_all") > 0, _untouched_raw(F.col("n_neg_all"), F.col("_nz_all"), F.col("_low_all")))
    raw = F.coalesce("raw_all", silent)
    return joined.select(*keys, "feature_idx", raw.alias("raw_auroc"), reflect(raw).alias("auroc"))


def whole_set_best(features: DataFrame, positives: DataFrame, n_units: int, keys: list[str] | None = None) -> DataFrame:
    """First feature with the highest reflected AUROC per concept, among all stored features."""
    keys = keys or ["concept_id"]
    pairs, pool, sizes = _whole_set(features, positives, n_units, keys)
    pairs, sizes = materialize(pairs), materialize(sizes)
    others = untouched_best(pairs, pool, sizes, keys=keys, arms=["all"], select_arm="all")
    both = pairs.select(*keys, "feature_idx", "raw_all").unionByName(others.select(*keys, "feature_idx", "raw_all"))
    score = reflect(F.col("raw_all"))
    first = F.max(F.struct(F.round(score, 12).alias("a"), (-F.col("feature_idx")).alias("i"), score.alias("s"))).alias("_t")
    return both.groupBy(*keys).agg(first).select(
        *keys, (-F.col("_t.i")).alias("best_feature_idx"), F.col("_t.s").alias("single_feature_auroc")
    )


def score_levels(features: DataFrame, positives: DataFrame, n_units: int, keys: list[str]) -> DataFrame:
    """``max_auroc`` and ``mean_auroc`` over all stored features, per key.

    The sum over all features depends on a concept only through its number of negatives:
    it is taken from the totals of the profile, and the features that the concept does
    touch are exchanged for their real scores.
    """
    pairs, pool, sizes = _whole_set(features, positives, n_units, keys)
    pairs, sizes = materialize(pairs), materialize(sizes)
    tilt = F.abs(2 * F.col("_low_all") - F.col("_nz_all"))
    profile = materialize(pool_profile(pool, ["all"]).select("feature_idx", tilt.alias("_tilt")))
    silent = F.lit(0.5) + F.coalesce(F.col("_tilt") / (2 * F.nullif(F.col("n_neg_all"), F.lit(0))), F.lit(0.0))
    touched = pairs.join(profile, "feature_idx").groupBy(*keys).agg(
        F.max(reflect(F.col("raw_all"))).alias("_max"), F.sum(reflect(F.col("raw_all"))).alias("_sum"), F.sum(silent).alias("_silent")
    )
    others = untouched_best(pairs, pool, sizes, keys=keys, arms=["all"], select_arm="all")
    others = others.select(*keys, reflect(F.col("raw_all")).alias("_other"))
    totals = profile.agg(F.count(F.lit(1)).alias("d"), F.sum("_tilt").alias("t"))
    ready = sizes.join(touched, keys, "left").join(others, keys, "left").withColumns(
        {"_d": totals.select("d").scalar(), "_t": totals.select("t").scalar()}
    )
    everything = F.col("_d") * 0.5 + F.coalesce(F.col("_t") / (2 * F.nullif(F.col("n_neg_all"), F.lit(0))), F.lit(0.0))
    zero = F.lit(0.0)
    mean = (everything + F.coalesce("_sum", zero) - F.coalesce("_silent", zero)) / F.col("_d")
    return ready.select(*keys, F.greatest("_max", "_other").alias("max_auroc"), mean.alias("mean_auroc"))


def explicit_auroc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC over rows that carry their own flags ``(keys, score, pos, neg)``."""
    # the rows usually come out of joins, and ranking reads its input twice
    blocks = materialize(rows.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    ranked = running_totals(
        blocks.withColumn("_b", score_bucket(F.col("score"))),
        by=keys,
        bucket="_b",
        order=["score"],
        totals={"_below": F.col("neg")},
    )
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") * 0.5)).alias("_u"),
        F.sum("pos").cast("bigint").alias("n_pos"),
        F.sum("neg").cast("bigint").alias("n_neg"),
    )
    raw = F.try_divide(F.col("_u").cast("double"), (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return sums.select(*keys, "n_pos", "n_neg", raw.alias("raw_auroc"))


def average_precision(
    features: DataFrame, positives: DataFrame, n_units: int, keys: list[str] | None = None, *, every: bool = False
) -> DataFrame:
    """Average precision of every stored (concept, feature) pair; with ``every``, of every
    concept with every stored feature.

    Tied scores are one threshold (the usual definition), which makes the result
    independent of row order.
    """
    keys = keys or ["concept_id"]
    scope = [*keys, "feature_idx"]
    pool = pool_counts(features)
    above = running_totals(
        pool.withColumn("_b", score_bucket(F.col("score"))),
        by=["feature_idx"],
        bucket="_b",
        order=["score"],
        totals={"_higher": F.col("pool_all")},
        descending=True,
    ).drop("_b")
    hits = (
        positives.join(nonzero(features), "unit_id")
        .groupBy(*scope, F.col("act").alias("score"))
        .agg(F.count(F.lit(1)).alias("_tp"))
    )
    hits = running_totals(
        materialize(hits).withColumn("_b", score_bucket(F.col("score"))),
        by=scope,
        bucket="_b",
        order=["score"],
        totals={"_tp_higher": F.col("_tp")},
        descending=True,
    )
    profile = pool_profile(pool, ["all"])
    counts = positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos"))
    # the zero block sits between positive and negative scores
    blocks = hits.join(above, ["feature_idx", "score"]).join(profile, "feature_idx")
    negative = F.col("score") < 0
    pairs = hits.groupBy(*scope).agg(
        F.sum("_tp").alias("_tp_nz"), F.sum(F.when(~negative, F.col("_tp")).otherwise(_zero())).alias("_tp_up")
    )
    silent = F.lit(n_units).cast("bigint") - F.col("_nz_all")
    full = blocks.join(pairs, scope).join(counts, keys)
    silent_tp = F.col("n_pos") - F.col("_tp_nz")
    seen = F.col("_higher") + F.col("pool_all") + F.when(negative, silent).otherwise(_zero())
    found = F.col("_tp_higher") + F.col("_tp") + F.when(negative, silent_tp).otherwise(_zero())
    summed = full.groupBy(*scope, "n_pos").agg(
        F.sum(F.col("_tp") * found / seen).alias("_ap"),
        F.max(silent_tp).alias("_silent_tp"),
        F.max(F.col("_tp_up")).alias("_up_tp"),
        F.max(silent).alias("_silent"),
        F.max(F.col("_nz_all") - F.col("_low_all")).alias("_up"),
    )
    zero_block = F.when(
        F.col("_silent_tp") > 0,
        F.col("_silent_tp") * (F.col("_up_tp") + F.col("_silent_tp")) / (F.col("_up") + F.col("_silent")),
    ).otherwise(F.lit(0.0))
    told = summed.select(*scope, ((F.col("_ap") + zero_block) / F.col("n_pos")).alias("average_precision"))
    if not every:
        return told
    # silent on all positives: they all stand in the zero block, behind the positive scores
    behind = F.col("n_pos") / (F.col("_nz_all") - F.col("_low_all") + F.lit(n_units).cast("bigint") - F.col("_nz_all"))
    grid = every_pair(profile, materialize(counts)).select(*scope, behind.alias("_silent_ap"))
    return grid.join(told, scope, "left").select(*scope, F.coalesce("average_precision", "_silent_ap").alias("average_precision"))


def threshold_metrics(
    features: DataFrame,
    positives: DataFrame,
    n_units: int,
    *,
    threshold: float = 0.0,
    keys: list[str] | None = None,
    every: bool = False,
) -> DataFrame:
    """F1 and Matthews correlation at ``score > threshold`` (threshold >= 0); 0 when undefined.

    Of pairs with a hit; with ``every``, of every concept with every stored feature.
    """
    if threshold < 0:
        raise ValueError("absent values score 0, so the threshold must not be negative")
    keys = keys or ["concept_id"]
    scope = [*keys, "feature_idx"]
    fired = features.where(F.col("act") > F.lit(float(threshold)))
    hits = positives.join(fired, "unit_id").groupBy(*scope).agg(F.count(F.lit(1)).alias("tp"))
    counts = positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos"))
    if every:
        over = F.sum((F.col("act") > F.lit(float(threshold))).cast("bigint"))
        predicted = nonzero(features).groupBy("feature_idx").agg(over.alias("predicted"))
        grid = every_pair(predicted, materialize(counts))
        cells = grid.join(hits, scope, "left").withColumn("tp", F.coalesce("tp", _zero()))
    else:
        predicted = fired.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("predicted"))
        cells = hits.join(predicted, "feature_idx").join(counts, keys)
    tp, fp = F.col("tp").cast("double"), (F.col("predicted") - F.col("tp")).cast("double")
    fn = (F.col("n_pos") - F.col("tp")).cast("double")
    tn = F.lit(float(n_units)) - tp - fp - fn
    f1_base = 2 * tp + fp + fn
    mcc_base = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return cells.select(
        *scope,
        F.when(f1_base > 0, 2 * tp / f1_base).otherwise(0.0).alias("f1"),
        F.when(mcc_base > 0, (tp * tn - fp * fn) / mcc_base).otherwise(0.0).alias("mcc"),
    )


def _first_untouched(touched: DataFrame, profile: DataFrame, concepts: DataFrame, keys: list[str]) -> DataFrame:
    """Per concept the columns of the first feature of ``profile``, in the order of its
    ``_order`` and index, that ``touched(keys, feature_idx)`` does not list; none if it lists all.

    A concept's own places in that order are compared with their ranks; the first gap is the
    answer, so concepts x features is never built.
    """
    listed = running_totals(
        profile.withColumn("_b", score_bucket(F.col("_order"))), by=[], bucket="_b", order=["_order", "feature_idx"],
        totals={"_place": F.lit(1).cast("bigint")},
    )
    listed = materialize(listed.withColumn("_place", F.col("_place") + 1).drop("_b", "_order"))
    placed = materialize(touched.select(*keys, "feature_idx").join(listed.select("feature_idx", "_place"), "feature_idx"))
    seen = stable_rank(placed, by=keys, key="_place", rank="_at", bucket=F.floor(F.col("_place") / 65536))
    gap = seen.groupBy(*keys).agg((F.sum((F.col("_at") == F.col("_place")).cast("int")) + 1).alias("_place"))
    free = concepts.join(gap, keys, "left").withColumn("_place", F.coalesce(F.col("_place"), F.lit(1)).cast("bigint"))
    return free.join(listed, "_place").drop("_place", "feature_idx")


def precision_levels(features: DataFrame, positives: DataFrame, n_units: int, keys: list[str]) -> DataFrame:
    """``max_value`` and ``mean_value`` of average precision over all stored features, per key.

    The positives of a silent feature all stand in its zero block, behind its positive
    scores, so its value is n_pos / (units - units with a negative score): one number per
    feature, whose total covers the features a concept never touches.
    """
    told = materialize(average_precision(features, positives, n_units, keys))
    behind = F.coalesce(F.try_divide(F.lit(1.0), F.lit(n_units).cast("bigint") - F.col("_low_all")), F.lit(0.0))
    profile = materialize(
        pool_profile(pool_counts(features), ["all"]).select("feature_idx", behind.alias("_behind"), (-F.col("_low_all")).alias("_order"))
    )
    concepts = materialize(positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos")))
    value = F.col("average_precision")
    touched = told.join(profile, "feature_idx").groupBy(*keys).agg(
        F.max(value).alias("_max"), F.sum(value).alias("_sum"), F.sum("_behind").alias("_own")
    )
    free = _first_untouched(told, profile, concepts.select(*keys), keys).select(*keys, F.col("_behind").alias("_free"))
    totals = profile.agg(F.count(F.lit(1)).alias("d"), F.sum("_behind").alias("t"))
    ready = concepts.join(touched, keys, "left").join(free, keys, "left")
    ready = ready.withColumns({"_d": totals.select("d").scalar(), "_t": totals.select("t").scalar()})
    zero = F.lit(0.0)
    mean = (F.coalesce("_sum", zero) + F.col("n_pos") * (F.col("_t") - F.coalesce("_own", zero))) / F.col("_d")
    return ready.select(*keys, F.greatest("_max", F.col("n_pos") * F.col("_free")).alias("max_value"), mean.alias("mean_value"))


def threshold_levels(
    features: DataFrame, positives: DataFrame, n_units: int, keys: list[str], *, metric: str, threshold: float = 0.0
) -> DataFrame:
    """``max_value`` and ``mean_value`` of ``f1`` or ``mcc`` over all stored features, per key.

    Without a hit F1 is 0, and the correlation is -sqrt(n_pos / n_neg) times a number of the
    feature, sqrt(p / (units - p)) for p predictions; the best such feature predicts least.
    """
    told = materialize(threshold_metrics(features, positives, n_units, threshold=threshold, keys=keys))
    over = F.sum((F.col("act") > F.lit(float(threshold))).cast("bigint"))
    profile = nonzero(features).groupBy("feature_idx").agg(over.alias("_order"))
    odds = F.sqrt(F.coalesce(F.try_divide(F.col("_order").cast("double"), (n_units - F.col("_order")).cast("double")), F.lit(0.0)))
    profile = materialize(profile.withColumn("_odds", odds if metric == "mcc" else F.lit(0.0)))
    concepts = materialize(positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pos")))
    touched = told.join(profile, "feature_idx").groupBy(*keys).agg(
        F.max(metric).alias("_max"), F.sum(metric).alias("_sum"), F.sum("_odds").alias("_own")
    )
    free = _first_untouched(told, profile, concepts.select(*keys), keys).select(*keys, F.col("_odds").alias("_free"))
    totals = profile.agg(F.count(F.lit(1)).alias("d"), F.sum("_odds").alias("t"))
    ready = concepts.join(touched, keys, "left").join(free, keys, "left")
    ready = ready.withColumns({"_d": totals.select("d").scalar(), "_t": totals.select("t").scalar()})
    zero = F.lit(0.0)
    scale = F.sqrt(F.coalesce(F.try_divide(F.col("n_pos").cast("double"), (n_units - F.col("n_pos")).cast("double")), zero))
    mean = (F.coalesce("_sum", zero) - scale * (F.col("_t") - F.coalesce("_own", zero))) / F.col("_d")
    return ready.select(*keys, F.greatest("_max", -scale * F.col("_free")).alias("max_value"), mean.alias("mean_value"))
