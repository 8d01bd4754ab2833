"""Clustered bootstrap and regression, meta-analysis, multiplicity, equivalence, curves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import stats as ST
from attestor.functions import tails
from attestor.operators.ordering import hash_int, hash_rank, order_hash, running_totals, score_bucket, stable_rank
from attestor.session import materialize

Z95 = 1.959963984540054
THEORETICAL_SLOPE = -0.5


# ---------------------------------------------------------------- cluster bootstrap


def cluster_draws(clusters: DataFrame, *, keys: list[str], draws: int, seed) -> DataFrame:
    """Resampled clusters ``(keys, b, cluster_no)``: K draws with replacement per replicate.

    ``clusters`` carries ``cluster_no`` 0..K-1 and ``k`` per group. Draw j of replicate b is
    a hash, so the table is generated in parallel from the clusters themselves.
    """
    slots = clusters.select(*keys, F.col("cluster_no").alias("_j"), "k").withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    )
    pick = F.pmod(hash_int(order_hash(seed, F.col("b"), F.col("_j"))), F.col("k"))
    return slots.select(*keys, "b", pick.alias("cluster_no"))


DRAWN_IN_ROW = 1 << 20  # clusters (or cells) of a group that may travel as one array
SLICES = 64  # parts of the draws of a group, each of which carries that array once


def drawn_loads(clusters: DataFrame, *, keys: list[str], draws: int, seed) -> DataFrame:
    """``keys, b, _drawn``: the loads ``_load`` of the K clusters drawn in replicate ``b``.

    The draws are those of ``cluster_draws``. What is shuffled is the array of loads, once for
    each slice of the draws; every drawn load is looked up in the row of its replicate.
    """
    in_order = F.array_sort(F.collect_list(F.struct("cluster_no", "_load")))
    packed = clusters.groupBy(*keys).agg(F.transform(in_order, lambda c: c["_load"]).alias("_loads")).where(F.size("_loads") > 0)
    slices = min(SLICES, draws)
    spread = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced
    sliced = packed.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(spread, *keys, "_slice")
    rows = sliced.withColumn("b", F.explode(F.sequence(F.col("_slice"), F.lit(draws - 1), F.lit(slices))))
    k = F.size("_loads").cast("bigint")

    def load(j: Column) -> Column:
        return F.get("_loads", F.pmod(hash_int(order_hash(seed, F.col("b"), j)), k).cast("int"))

    return rows.select(*keys, "b", F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), load).alias("_drawn"))


def _drawn_means(clusters: DataFrame, *, keys: list[str], draws: int, seed) -> DataFrame:
    """``keys, b, _mean`` of every replicate; groups with too many clusters for a row are joined."""
    loads = clusters.withColumn("_load", F.struct(F.col("_s").cast("double").alias("s"), F.col("_n").alias("n")))
    drawn = drawn_loads(loads.where(F.col("k") <= DRAWN_IN_ROW), keys=keys, draws=draws, seed=seed)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))
    add = lambda t, c: F.struct((t["s"] + c["s"]).alias("s"), (t["n"] + c["n"]).alias("n"))
    means = drawn.select(*keys, "b", F.aggregate("_drawn", zero, add, lambda t: t["s"] / t["n"]).alias("_mean"))
    large = clusters.where(F.col("k") > DRAWN_IN_ROW)
    if large.isEmpty():
        return means
    joined = cluster_draws(large, keys=keys, draws=draws, seed=seed).join(large.select(*keys, "cluster_no", "_s", "_n"), [*keys, "cluster_no"])
    return means.unionByName(joined.groupBy(*keys, "b").agg((F.sum("_s").cast("double") / F.sum("_n")).alias("_mean")))


def number_clusters(clusters: DataFrame, *, keys: list[str]) -> DataFrame:
    """Add ``cluster_no`` (0-based, by numeric id or hash order) and the group's cluster count ``k``."""
    if clusters.schema["cluster"].dataType.simpleString() == "string":
        numbered = hash_rank(clusters, by=keys, seed="cluster", parts=["cluster"], rank="cluster_no")
    else:
        numbered = stable_rank(clusters, by=keys, key="cluster", rank="cluster_no")
    numbered = numbered.withColumn("cluster_no", F.col("cluster_no") - 1)
    counts = clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return numbered.join(counts, keys) if keys else numbered.withColumn("k", counts.select("k").scalar())


def bootstrap_mean(
    rows: DataFrame, *, keys: list[str], value: str, cluster: str, draws: int = 2000, confidence: float = 0.95, seed="42"
) -> DataFrame:
    """Mean with a percentile interval from resampling whole clusters, per group.

    Rows are reduced to one (sum, count) per cluster before anything is resampled.
    ``few_clusters`` warns below ten clusters; the interval is still computed.
    """
    clusters = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(cluster).alias("cluster")).agg(
        F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    clusters = materialize(number_clusters(materialize(clusters), keys=keys))
    means = _drawn_means(clusters, keys=keys, draws=draws, seed=seed)
    tail = (1.0 - confidence) / 2
    interval = means.groupBy(*keys).agg(
        F.percentile("_mean", tail).alias("ci_lo"),
        F.percentile("_mean", 1 - tail).alias("ci_hi"),
        F.count(F.lit(1)).alias("n_bootstrap"),
    )
    point = clusters.groupBy(*keys).agg(
        (F.sum("_s") / F.sum("_n")).alias("mean"),
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
    joined = _attach(point, interval, keys)
    return joined.withColumn("few_clusters", F.col("n_clusters") < 10)


# ---------------------------------------------------------------- logistic regression


def collapse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sufficient statistics of a logistic fit on log(x): one row per group and distinct x."""
    return rows.groupBy(*keys, F.log("x").alias("lx")).agg(
        F.sum("w").alias("n"),
        F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )


CELLS_IN_A_ROW = 4096  # distinct x of a group that may stand in one row; more are summed by Spark


def _step(b0: Column, b1: Column, s0: Column, s1: Column, s2: Column, r0: Column, r1: Column, tol: float) -> Column:
    """Next coefficients of a Newton step from the five sums, as a struct like ``_START``."""
    det = s0 * s2 - s1 * s1
    good = F.coalesce(~F.isnan(det) & (det > 1e-12 * F.greatest(F.lit(1.0), s0 * s2)), F.lit(False))
    d0, d1 = (s2 * r0 - s1 * r1) / det, (s0 * r1 - s1 * r0) / det
    clip = lambda c: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), c))
    none = F.lit(float("nan"))
    fields = {"b0": b0 + clip(d0), "b1": b1 + clip(d1), "i00": s2 / det, "i01": -s1 / det, "i11": s0 / det}
    moving = good & (F.greatest(F.abs(d0), F.abs(d1)) > tol)
    return F.struct(*[F.when(good, v).otherwise(none).alias(k) for k, v in fields.items()], moving.alias("live"))


def _start() -> Column:
    zero, none = F.lit(0.0), F.lit(float("nan"))
    return F.struct(zero.alias("b0"), zero.alias("b1"), *[none.alias(c) for c in ("i00", "i01", "i11")], F.lit(True).alias("live"))


def _sums(mu: Column, n: Column, sy: Column, lx: Column) -> dict[str, Column]:
    weight, residual = n * mu * (1 - mu), sy - n * mu
    return {"s0": weight, "s1": weight * lx, "s2": weight * lx * lx, "r0": residual, "r1": residual * lx}


def _fit_cells(cells: DataFrame, keys: list[str], max_iter: int, tol: float) -> DataFrame:
    """All Newton steps of every group inside its row: ``cells`` is the array of its distinct x."""
    zeros = F.struct(*[F.lit(0.0).alias(c) for c in ("s0", "s1", "s2", "r0", "r1")])

    def step(now: Column, _: Column) -> Column:
        def add(total: Column, cell: Column) -> Column:
            mu = 1 / (1 + F.exp(-(now["b0"] + now["b1"] * cell["lx"])))
            new = _sums(mu, cell["n"], cell["sy"], cell["lx"])
            return F.struct(*[(total[k] + v).alias(k) for k, v in new.items()])

        def finish(t: Column) -> Column:
            return _step(now["b0"], now["b1"], t["s0"], t["s1"], t["s2"], t["r0"], t["r1"], tol)

        return F.when(now["live"], F.aggregate("cells", zeros, add, finish)).otherwise(now)

    return cells.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), _start(), step).alias("_f"))


def _fit_tables(base: DataFrame, keys: list[str], max_iter: int, tol: float) -> DataFrame:
    """The same steps for groups of any size: an aggregation each, coefficients in stored tables."""
    base = materialize(base.withColumn("_g", F.lit(0)))
    by = [*keys, "_g"]
    coef = materialize(base.select(*by).distinct().withColumn("_f", _start()))
    for _ in range(max_iter):
        mu = 1 / (1 + F.exp(-(F.col("_f.b0") + F.col("_f.b1") * F.col("lx"))))
        parts = _sums(mu, F.col("n"), F.col("sy"), F.col("lx"))
        now = base.join(coef.where("_f.live"), by)
        sums = now.groupBy(*by).agg(F.first("_f").alias("_f"), *[F.sum(v).alias(k) for k, v in parts.items()])
        stepped = sums.select(*by, _step(F.col("_f.b0"), F.col("_f.b1"), *[F.col(k) for k in parts], tol).alias("_f"))
        coef = materialize(stepped.unionByName(coef.where("not _f.live")))
        if coef.where("_f.live").isEmpty():
            break
    return coef.drop("_g")


def grouped_logit(collapsed: DataFrame, keys: list[str], *, max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """Newton fit of ``y ~ 1 + log(x)`` for every group at once.

    Returns ``keys, b0, b1, i00, i01, i11, converged``: coefficients and inverse information,
    NaN for singular groups; ``converged`` is false for these and where a step still moved
    after ``max_iter``. A group of at most ``CELLS_IN_A_ROW`` distinct x runs all its steps
    in one expression over its row; groups with more reduce each step to five sums in an
    aggregation, so none is ever gathered.
    """
    base = materialize(collapsed.select(*keys, F.col("lx"), F.col("n").cast("double").alias("n"), F.col("sy").cast("double").alias("sy")))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    sizes = sizes if keys else sizes.where("_cells > 0")
    widest = sizes.agg(F.max("_cells")).first()[0] or 0
    cell = F.collect_list(F.struct("lx", "n", "sy")).alias("cells")
    if widest <= CELLS_IN_A_ROW:
        rows = base.groupBy(*keys).agg(cell)
        fits = _fit_cells(rows if keys else rows.where(F.size("cells") > 0), keys, max_iter, tol)
    elif not keys:
        fits = _fit_tables(base, keys, max_iter, tol)
    else:
        small = sizes.where(F.col("_cells") <= CELLS_IN_A_ROW).select(*keys)
        rows = base.join(small, keys, "left_semi").groupBy(*keys).agg(cell)
        large = _fit_tables(base.join(small, keys, "left_anti"), keys, max_iter, tol)
        fits = _fit_cells(rows, keys, max_iter, tol).unionByName(large)
    fits = materialize(fits)
    settled = ~F.col("_f.live") & ~F.isnan("_f.b1")
    return fits.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in ("b0", "b1", "i00", "i01", "i11")], settled.alias("converged"))


def _one_fit(row) -> tuple[float, float, np.ndarray]:
    return row["b0"], row["b1"], np.array([[row["i00"], row["i01"]], [row["i01"], row["i11"]]])


def _cluster_meat(rows: DataFrame, fits: DataFrame, keys: list[str]) -> dict:
    """Per model of the report: outer products of per-cluster score sums, cluster and row counts."""
    coef = fits.select(*keys, "b0", "b1")
    if keys:
        scored = rows.join(coef, keys)
    else:
        scored = rows.withColumns({c: coef.select(c).scalar() for c in ("b0", "b1")})
    lx = F.log("x")
    residual = F.col("y") - 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * lx)))
    per_cluster = scored.groupBy(*keys, "cluster").agg(
        F.sum(residual).alias("u0"), F.sum(residual * lx).alias("u1"), F.count(F.lit(1)).alias("n")
    )
    sums = per_cluster.groupBy(*keys).agg(
        F.sum(F.col("u0") * F.col("u0")).alias("m00"),
        F.sum(F.col("u0") * F.col("u1")).alias("m01"),
        F.sum(F.col("u1") * F.col("u1")).alias("m11"),
        F.count(F.lit(1)).alias("g"),
        F.sum("n").alias("n"),
    )
    return {
        tuple(r[k] for k in keys): (np.array([[r["m00"], r["m01"]], [r["m01"], r["m11"]]]), int(r["g"]), int(r["n"]))
        for r in sums.collect()
    }


def _drawn_cells(cells: DataFrame, clusters: DataFrame, *, keys: list[str], draws: int, seed) -> DataFrame:
    """Collapsed rows of every replicate; a task sums its replicates before anything is shuffled."""
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"))
    cells = _attach(cells, sizes, keys)
    small, large = cells.where(F.col("_cells") <= DRAWN_IN_ROW), cells.where(F.col("_cells") > DRAWN_IN_ROW)
    loads = small.groupBy(*keys, "cluster_no").agg(F.collect_list(F.struct("x", "y", "w")).alias("_load"))
    drawn = drawn_loads(loads, keys=keys, draws=draws, seed=seed)
    sample = drawn.select(*keys, "b", F.explode(F.flatten("_drawn")).alias("_c")).select(*keys, "b", "_c.*")
    out = collapse(sample, [*keys, "b"])
    if large.isEmpty():
        return out
    those = clusters.join(large.select(*keys, "cluster_no").distinct(), [*keys, "cluster_no"], "left_semi")
    weights = cluster_draws(those, keys=keys, draws=draws, seed=seed).groupBy(*keys, "b", "cluster_no").agg(F.count(F.lit(1)).alias("_times"))
    joined = weights.join(large.select(*keys, "cluster_no", "x", "y", "w"), [*keys, "cluster_no"])
    return out.unionByName(collapse(joined.withColumn("w", F.col("w") * F.col("_times")), [*keys, "b"]))


def _resampled_slopes(rows: DataFrame, *, keys: list[str], draws: int, seed) -> DataFrame:
    """``keys, b, slope`` of cluster-resampled refits.

    A replicate counts if its outcome varies and every group has a finite slope.
    """
    cells = rows.groupBy(*keys, "cluster", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    clusters = materialize(number_clusters(materialize(cells.select(*keys, "cluster").distinct()), keys=keys))
    numbered = materialize(cells.join(clusters, [*keys, "cluster"]))
    collapsed = materialize(_drawn_cells(numbered, clusters, keys=keys, draws=draws, seed=seed))
    fits = grouped_logit(collapsed, [*keys, "b"])
    n_groups = fits.select(*keys).distinct().count() if keys else 1
    varied = collapsed.groupBy("b").agg(F.min("y_min").alias("lo"), F.max("y_max").alias("hi")).where("lo <> hi")
    finite = F.coalesce(~F.isnan("b1") & (F.abs("b1") < float("inf")), F.lit(False))
    whole = fits.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.bool_and(finite).alias("ok")).where((F.col("n") == n_groups) & F.col("ok"))
    usable = fits.join(whole.select("b"), "b", "left_semi").join(varied.select("b"), "b", "left_semi")
    return materialize(usable.select(*keys, "b", F.col("b1").alias("slope")))


def _percentiles(value: str, confidence: float) -> list[Column]:
    tail = (1 - confidence) / 2
    return [F.percentile(value, tail).alias("lo"), F.percentile(value, 1 - tail).alias("hi"), F.count(F.lit(1)).alias("n")]


def fit_verified_rate(rows: DataFrame, *, draws: int = 2000, confidence: float = 0.95, seed="42") -> DataFrame:
    """Logistic fit of a verified rate on log(x) with clustered errors, one result row.

    ``rows`` has (x, y in [0, 1], cluster). The bootstrap needs ten clusters.
    """
    rows = materialize(rows.select(F.col("x").cast("double"), F.col("y").cast("double"), "cluster"))
    fits = grouped_logit(collapse(rows.withColumn("w", F.lit(1)), []), [])
    fitted = fits.first()
    b0, b1, bread = _one_fit(fitted) if fitted else (math.nan, math.nan, None)
    if not math.isfinite(b1):
        raise ValueError("singular fit: x does not vary, or there are no rows")
    meat, g, n = _cluster_meat(rows, fits, [])[()]
    factor = g / (g - 1) * (n - 1) / (n - 2) if g > 1 and n > 2 else float("nan")
    cov = factor * bread @ meat @ bread
    se0, se1 = (math.sqrt(v) if v >= 0 else float("nan") for v in (cov[0, 0], cov[1, 1]))
    z = tails.norm_ppf_value(0.5 + confidence / 2)
    p = 2 * (1 - tails.norm_cdf_value(abs(b1 / se1))) if se1 > 0 else float("nan")
    lo = hi = None
    successful = 0
    reason = "not asked for" if draws <= 0 else "fewer than ten clusters" if g < 10 else None
    if reason is None:
        told = _resampled_slopes(rows, keys=[], draws=draws, seed=seed).agg(*_percentiles("slope", confidence)).first()
        successful = told["n"]
        lo, hi = (told["lo"], told["hi"]) if successful else (float("nan"), float("nan"))
        reason = None if successful else "no usable draw"
    doubled = 1 / (1 + math.exp(-(b0 + b1 * math.log(2)))) - 1 / (1 + math.exp(-b0))
    return rows.sparkSession.createDataFrame(
        [(b0, b1, se0, se1, b1 - z * se1, b1 + z * se1, p, lo, hi, successful, n, g, doubled, bool(fitted["converged"]), reason)],
        "intercept double, slope double, intercept_se double, slope_se double, slope_lo double, slope_hi double,"
        " slope_p double, bootstrap_lo double, bootstrap_hi double, n_bootstrap int, n_rows bigint, n_clusters bigint,"
        " effect_per_doubling double, converged boolean, bootstrap_reason string",
    )


def fit_pooled_interaction(
    rows: DataFrame,
    *,
    reference: str | None = None,
    model_sizes: dict[str, float] | None = None,
    draws: int = 2000,
    confidence: float = 0.95,
    seed="42",
) -> tuple[DataFrame, DataFrame]:
    """Pooled fit with model x log(x) interaction: per-model slopes and one summary row.

    The interaction is saturated in the model, so the pooled estimate splits into one
    two-parameter fit per model; the clustered covariance is block-diagonal because a
    cluster belongs to one model, with the pooled small-sample factor. ``model_sizes``
    adds a precision-weighted trend of the slopes over log10(size).
    """
    spark = rows.sparkSession
    rows = materialize(rows.select("model", F.col("x").cast("double"), F.col("y").cast("double"), "cluster"))
    fits = grouped_logit(collapse(rows.withColumn("w", F.lit(1)), ["model"]), ["model"])
    fitted = fits.collect()  # one row per model of the report
    found, converged = {r["model"]: _one_fit(r) for r in fitted}, {r["model"]: r["converged"] for r in fitted}
    models = sorted(found)
    if len(models) < 2:
        raise ValueError(f"a pooled fit needs at least two models, got {models}")
    if reference is not None and reference not in models:
        raise ValueError(f"reference {reference!r} is not among {models}")
    reference = models[0] if reference is None else reference
    ordered = [reference, *[m for m in models if m != reference]]
    meats = _cluster_meat(rows, fits, ["model"])
    g_total = sum(m[1] for m in meats.values())
    n_total = sum(m[2] for m in meats.values())
    n_params = 2 * len(models)
    factor = g_total / (g_total - 1) * (n_total - 1) / (n_total - n_params)
    slope, var = {}, {}
    for m in ordered:
        _, slope[m], bread = found[m]
        var[m] = float((factor * bread @ meats[(m,)][0] @ bread)[1, 1])
        if not (math.isfinite(var[m]) and var[m] >= 0 and math.isfinite(slope[m])):
            raise ValueError(f"clustered standard error of {m!r} is not finite: near-separated data")
    others = ordered[1:]
    gap = np.array([slope[m] - slope[reference] for m in others])
    spread = np.full((len(others), len(others)), var[reference]) + np.diag([var[m] for m in others])
    wald = float(gap @ np.linalg.solve(spread, gap))
    z = tails.norm_ppf_value(0.5 + confidence / 2)
    trend = trend_lo = trend_hi = trend_p = None
    contrast = None
    if model_sizes is not None:
        lacking = set(ordered) - set(model_sizes)
        if lacking:
            raise ValueError(f"model_sizes lacks {sorted(lacking)}")
        if any(v <= 0 for v in model_sizes.values()):
            raise ValueError("model sizes must be positive")
        size = np.array([math.log10(model_sizes[m]) for m in ordered])
        weight = np.array([1 / var[m] for m in ordered])
        centered = size - np.sum(weight * size) / np.sum(weight)
        contrast = weight * centered / np.sum(weight * centered**2)
        trend = float(contrast @ np.array([slope[m] for m in ordered]))
    boot: dict = {}
    n_boot = 0
    reason = "not asked for" if draws <= 0 else "fewer than ten clusters" if any(meats[(m,)][1] < 10 for m in ordered) else None
    if reason is None:
        resampled = _resampled_slopes(rows, keys=["model"], draws=draws, seed=seed)
        boot = {r["model"]: (r["lo"], r["hi"], r["n"]) for r in resampled.groupBy("model").agg(*_percentiles("slope", confidence)).collect()}
        n_boot = max((x[2] for x in boot.values()), default=0)
        reason = None if boot else "no usable draw"
    if boot and contrast is not None:
        weights = spark.createDataFrame([(m, float(c)) for m, c in zip(ordered, contrast)], "model string, c double")
        trends = resampled.join(weights, "model").groupBy("b").agg(F.sum(F.col("c") * F.col("slope")).alias("v"))
        share = lambda cond: F.avg(cond.cast("double"))
        told = trends.agg(*_percentiles("v", confidence), share(F.col("v") <= 0).alias("down"), share(F.col("v") >= 0).alias("up")).first()
        trend_lo, trend_hi = told["lo"], told["hi"]
        trend_p = min(1.0, max(2 * min(told["down"], told["up"]), 1.0 / told["n"]))
    records = []
    for m in ordered:
        se = math.sqrt(var[m])
        lo, hi = boot[m][:2] if m in boot else (None, None)
        records.append(
            (m, slope[m], se, slope[m] - z * se, slope[m] + z * se,
             2 * (1 - tails.norm_cdf_value(abs(slope[m] / se))) if se > 0 else float("nan"), lo, hi, meats[(m,)][1], converged[m], reason)
        )
    slopes = spark.createDataFrame(
        records,
        "model string, slope double, slope_se double, slope_lo double, slope_hi double, slope_p double,"
        " bootstrap_lo double, bootstrap_hi double, n_clusters bigint, converged boolean, bootstrap_reason string",
    )
    summary = spark.createDataFrame(
        [(reference, wald, tails.chi2_sf_value(wald, len(others)), n_total, g_total, n_boot, trend, trend_lo, trend_hi, trend_p)],
        "reference string, wald double, interaction_p double, n_rows bigint, n_clusters bigint, n_bootstrap int,"
        " trend_slope double, trend_lo double, trend_hi double, trend_p double",
    )
    return slopes, summary


# ---------------------------------------------------------------- meta-analysis and tests


def random_effects(studies: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """DerSimonian-Laird pooling of ``(theta, se)`` with the floored Knapp-Hartung interval."""
    keys = keys or []
    w = 1 / (F.col("se") * F.col("se"))
    valid = F.when(F.col("se") > 0, w).otherwise(F.raise_error(F.lit("standard errors must be positive")).cast("double"))
    weighted = studies.withColumn("_w", valid)
    first = weighted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_w")).alias("_sww"),
        (F.sum(F.col("_w") * F.col("theta")) / F.sum("_w")).alias("theta_fixed"),
    )
    first = first.where(
        F.when(F.col("k") >= 2, F.lit(True)).otherwise(F.raise_error(F.lit("at least two studies are needed")).cast("boolean"))
    )
    joined = _attach(weighted, first, keys)
    second = joined.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("k", "_sw", "_sww", "theta_fixed")],
        F.sum(F.col("_w") * F.pow(F.col("theta") - F.col("theta_fixed"), 2)).alias("q_statistic"),
    )
    c = F.col("_sw") - F.col("_sww") / F.col("_sw")
    df = F.col("k") - 1
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q_statistic") - df) / c)).otherwise(F.lit(0.0))
    second = second.withColumn("tau_squared", tau2)
    third = _attach(studies, second, keys).withColumn("_ws", 1 / (F.col("se") * F.col("se") + F.col("tau_squared")))
    kept = ("k", "theta_fixed", "q_statistic", "tau_squared")
    pooled = third.groupBy(*keys).agg(
        *[F.first(x).alias(x) for x in kept],
        (F.sum(F.col("_ws") * F.col("theta")) / F.sum("_ws")).alias("theta_re"),
        F.sqrt(1 / F.sum("_ws")).alias("se_re"),
        F.sum(F.col("_ws") * F.col("theta") * F.col("theta")).alias("_a"),
        F.sum(F.col("_ws") * F.col("theta")).alias("_b"),
        F.sum("_ws").alias("_c"),
    )
    q_kh = F.greatest(F.lit(0.0), (F.col("_a") - F.col("_b") * F.col("_b") / F.col("_c")) / df)
    pooled = pooled.withColumn("se_kh", F.col("se_re") * F.sqrt(F.greatest(q_kh, F.lit(1.0))))
    pooled = pooled.withColumn("_t", tails.t_ppf(F.lit(0.975), F.col("k") - 1))
    return pooled.select(
        *keys,
        "k",
        "theta_re",
        "se_re",
        (F.col("theta_re") - Z95 * F.col("se_re")).alias("ci_lo"),
        (F.col("theta_re") + Z95 * F.col("se_re")).alias("ci_hi"),
        "se_kh",
        (F.col("theta_re") - F.col("_t") * F.col("se_kh")).alias("kh_lo"),
        (F.col("theta_re") + F.col("_t") * F.col("se_kh")).alias("kh_hi"),
        "theta_fixed",
        "tau_squared",
        "q_statistic",
        F.when(F.col("q_statistic") > 0, F.greatest(F.lit(0.0), (F.col("q_statistic") - df) / F.col("q_statistic") * 100))
        .otherwise(F.lit(0.0))
        .alias("i_squared"),
        tails.chi2_sf(F.col("q_statistic"), F.col("k") - 1).alias("q_p_value"),
    )


def _attach(rows: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Group values next to rows; without keys the single row comes as scalar subqueries."""
    if keys:
        return rows.join(per_group, keys)
    return rows.withColumns({c: per_group.select(c).scalar() for c in per_group.columns})


def adjust_fdr(tests: DataFrame, *, p: str = "p", family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family; NULL p stays NULL / false.

    Equal p-values share one adjusted value, so the work happens on distinct p-values:
    two-level ranks upwards and a two-level running minimum downwards.
    """
    family = family or []
    distinct = tests.where(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    distinct = materialize(distinct.withColumn("_b", score_bucket(F.col("_p"))))
    ranked = running_totals(distinct, by=family, bucket="_b", order=["_p"], totals={"_before": F.col("_n")})
    m = distinct.groupBy(*family).agg(F.sum("_n").alias("_m"))
    ranked = _attach(ranked, m, family)
    ranked = materialize(ranked.withColumn("_raw", F.col("_p") * F.col("_m") / (F.col("_before") + F.col("_n"))))
    floor = ranked.groupBy(*family, "_b").agg(F.min("_raw").alias("_bucket_min"))
    above = Window.partitionBy(*family).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    floor = floor.select(*family, "_b", F.min("_bucket_min").over(above).alias("_above"))
    inside = Window.partitionBy(*family, "_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = (
        ranked.withColumn("_run", F.min("_raw").over(inside))
        .join(floor, [*family, "_b"])
        .select(*family, "_p", F.least(F.lit(1.0), F.col("_run"), F.col("_above")).alias("p_adjusted"))
    )
    out = tests.withColumn("_p", F.col(p)).join(adjusted, [*family, "_p"], "left").drop("_p")
    return out.withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


def equivalence_test(
    rows: DataFrame, *, value: str, margin: float, keys: list[str] | None = None, alpha: float = 0.05
) -> DataFrame:
    """Two one-sided normal tests of a mean against +/- margin, with the binding p-value."""
    if margin <= 0:
        raise ValueError(f"margin must be positive, got {margin}")
    keys = keys or []
    sums = rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.stddev_samp(value).alias("_sd")
    )
    se = F.col("_sd") / F.sqrt("n")
    checked = F.when(F.col("n") < 2, F.raise_error(F.lit("equivalence needs at least two values")).cast("double")).when(
        se == 0, F.raise_error(F.lit("zero standard error")).cast("double")
    ).otherwise(se)
    out = sums.withColumn("se", checked).withColumns(
        {"z_lower": (F.col("mean") + margin) / F.col("se"), "z_upper": (F.lit(margin) - F.col("mean")) / F.col("se")}
    )
    out = out.withColumns(
        {"p_lower": tails.norm_cdf(-F.col("z_lower")), "p_upper": tails.norm_cdf(-F.col("z_upper"))}
    )
    binding = F.greatest("p_lower", "p_upper")
    return out.select(
        *keys,
        "n",
        "mean",
        "se",
        F.lit(float(margin)).alias("margin"),
        "z_lower",
        "z_upper",
        "p_lower",
        "p_upper",
        binding.alias("p_value"),
        (F.col("mean") - Z95 * F.col("se")).alias("ci_lo"),
        (F.col("mean") + Z95 * F.col("se")).alias("ci_hi"),
        (binding < 0.05).alias("equivalent_05"),
        (binding < alpha).alias("equivalent_alpha"),
    )


# ---------------------------------------------------------------- curves


def exclude_concepts(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Leverage check: drop listed concepts before a fit."""
    return rows.join(excluded.select("concept_id"), "concept_id", "left_anti")


def curve_points(rows: DataFrame, *, value: str = "auroc_inflation", draws: int = 2000, seed="42") -> DataFrame:
    """Mean and interval per (model, sweep point), with duplicate points marked."""
    from attestor.operators.registry import fingerprint_points

    points = bootstrap_mean(
        rows, keys=["model", "min_positives"], value=value, cluster="best_feature_idx", draws=draws, seed=seed
    )
    marks = fingerprint_points(rows.withColumn("auroc_inflation", F.col(value)))
    return points.join(marks, ["model", "min_positives"], "left")


def simple_ols(rows: DataFrame, *, x: Column, y: Column, keys: list[str] | None = None) -> DataFrame:
    """Grouped ``y ~ x`` with t-based 95% interval and p-value; needs three points."""
    keys = keys or []
    prepared = rows.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    sums = prepared.groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r_squared"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_count("_y", "_x").alias("n_points"),
    )
    df = F.col("n_points") - 2
    residual = F.greatest(F.lit(0.0), F.col("_syy") * (1 - F.col("r_squared")))
    se = F.sqrt(F.try_divide(residual, df.cast("double")) / F.nullif(F.col("_sxx"), F.lit(0.0)))
    out = sums.withColumn("slope_se", F.when(df > 0, se)).withColumn("_t", tails.t_ppf(F.lit(0.975), df))
    t_value = F.abs(F.try_divide(F.col("slope"), F.col("slope_se")))
    return out.select(
        *keys,
        "n_points",
        "slope",
        "intercept",
        "r_squared",
        "slope_se",
        (F.col("slope") - F.col("_t") * F.col("slope_se")).alias("ci_lo"),
        (F.col("slope") + F.col("_t") * F.col("slope_se")).alias("ci_hi"),
        (2 * tails.t_sf(t_value, df)).alias("p_value"),
    )


def usable_points(points: DataFrame) -> DataFrame:
    """First of each duplicate group, positive means only."""
    return points.where(F.col("duplicate_of").isNull() & (F.col("mean") > 0))


def _told(fit: DataFrame, needed: int, what: str) -> DataFrame:
    """Add ``reason`` to a fit; one with too few points or a constant x has no numbers."""
    n = F.coalesce("n_points", F.lit(0).cast("bigint"))
    reason = F.when(n < needed, F.lit(f"fewer than {needed} {what}")).when(F.col("slope").isNull(), F.lit("x does not vary"))
    fit = fit.withColumns({"n_points": n, "reason": reason})
    numbers = ("slope", "intercept", "r_squared", "slope_se", "ci_lo", "ci_hi", "p_value")
    return fit.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in numbers})


def log_log_fits(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fit per model, pooled fit) of log mean on log sweep point.

    ``reason`` says why a fit is not usable: a line needs three points whose x varies. Its
    numbers are NULL then, but the model keeps its row.
    """
    usable = usable_points(points)
    x, y = F.log(F.col("min_positives").cast("double")), F.log("mean")
    covers = (F.col("ci_lo") <= THEORETICAL_SLOPE) & (F.col("ci_hi") >= THEORETICAL_SLOPE)
    models = points.select("model").distinct()
    per_model = models.join(simple_ols(usable, x=x, y=y, keys=["model"]), "model", "left")
    return tuple(_told(fit, 3, "points").withColumn("covers_theory", covers) for fit in (per_model, simple_ols(usable, x=x, y=y)))


def pool_route(fits: DataFrame, *, keys: list[str] | None = None) -> DataFrame:
    """Random-effects slope over usable per-model fits, standard errors recovered from the intervals."""
    fits = fits.where("reason IS NULL") if "reason" in fits.columns else fits
    critical = tails.t_ppf(F.lit(0.975), F.col("n_points") - 2)
    staged = fits.withColumn("_t", critical)
    studies = staged.withColumns(
        {"theta": F.col("slope"), "se": ST.se_from_ci(F.col("ci_lo"), F.col("ci_hi"), F.col("_t"))}
    )
    pooled = random_effects(studies.select(*(keys or []), "theta", "se"), keys=keys)
    return pooled.withColumns(
        {
            "kh_covers": (F.col("kh_lo") <= THEORETICAL_SLOPE) & (F.col("kh_hi") >= THEORETICAL_SLOPE),
            "normal_covers": (F.col("ci_lo") <= THEORETICAL_SLOPE) & (F.col("ci_hi") >= THEORETICAL_SLOPE),
        }
    )


def hard_negative_gap(rows: DataFrame, *, draws: int = 2000, seed="42") -> DataFrame:
    """Held-out minus hard-negative score with clustered interval, per model and point."""
    paired = rows.withColumn("gap", F.col("held_out_auroc") - F.col("hard_negative_held_out_auroc"))
    return bootstrap_mean(
        paired, keys=["model", "min_positives"], value="gap", cluster="best_feature_idx", draws=draws, seed=seed
    )


def backfill_intervals(rows: DataFrame, summaries: DataFrame, *, draws: int = 2000, seed="42", tolerance: float = 1e-6) -> DataFrame:
    """Intervals for stored results; ``drifted`` marks a recomputed mean off the stored one."""
    fresh = bootstrap_mean(
        rows, keys=["model", "min_positives"], value="auroc_inflation", cluster="best_feature_idx", draws=draws, seed=seed
    )
    joined = fresh.join(summaries, ["model", "min_positives"], "left")
    return joined.withColumn("drifted", F.abs(F.col("mean") - F.col("stored_mean")) > tolerance)


def clean_curve(points: DataFrame) -> DataFrame:
    """Drop points equal in (n_paired, mean) to the previous point kept; flag thin ones.

    Consecutive equal points form a run, and only the first of a run differs from its
    predecessor, so comparing neighbours is the same as comparing with the last kept.
    """
    order = Window.partitionBy("model").orderBy("min_positives")  # a handful of sweep points
    same = (F.col("n_rows") == F.lag("n_rows").over(order)) & (F.col("mean") == F.lag("mean").over(order))
    return points.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same").withColumn(
        "reliable", F.col("n_clusters") >= 10
    )


def point_means(rows: DataFrame) -> DataFrame:
    """Mean single, multivariate and held-out scores per sweep point; only NULLs are skipped."""
    return rows.groupBy("min_positives").agg(
        F.avg("single_feature_auroc").alias("mean_single"),
        F.avg("multivariate_auroc").alias("mean_multivariate"),
        F.avg("held_out_auroc").alias("mean_held_out"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def theory_check(rows: DataFrame) -> DataFrame:
    """Measured over predicted inflation ``(n_positive, n_total, d, measured)`` per row."""
    n_neg = F.col("n_total") - F.col("n_positive")
    sigma = F.sqrt(ST.auroc_variance(F.lit(0.5), F.col("n_positive"), n_neg))
    out = rows.withColumn("sigma", sigma)
    for name, folded in (("folded", True), ("unfolded", False)):
        out = out.withColumn(f"theory_{name}", ST.expected_max_inflation(F.col("sigma"), F.col("d"), folded))
        out = out.withColumn(f"ratio_{name}", F.col("measured") / F.col(f"theory_{name}"))
    return out


def theory_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.avg("ratio_folded").alias("folded_mean"),
        F.stddev_samp("ratio_folded").alias("folded_sd"),
        F.avg("ratio_unfolded").alias("unfolded_mean"),
        F.stddev_samp("ratio_unfolded").alias("unfolded_sd"),
    )


def power_columns(effect: Column, sd: Column, n_per_arm: Column, power: float = 0.8, alpha: float = 0.05) -> dict[str, Column]:
    """Clusters per arm for a target power, and the power at a given number."""
    z_crit, z_beta = tails.norm_ppf_value(1 - alpha / 2), tails.norm_ppf_value(power)
    needed = 2 * F.pow(sd * (z_crit + z_beta) / effect, 2)
    z_effect = effect / (sd * F.sqrt(2 / n_per_arm))
    at_n = tails.norm_cdf(z_effect - z_crit) + tails.norm_cdf(-z_effect - z_crit)
    return {"required_clusters": needed, "power": at_n}


def inflation_ratio(d1: Column, d2: Column) -> Column:
    """Predicted growth of the expected maximum when the dictionary widens from d1 to d2."""
    one = F.lit(1.0)
    return ST.expected_max_inflation(one, d2) / ST.expected_max_inflation(one, d1)


def evidence_depth(annotations: DataFrame, *, experimental: list[str], min_terms: int = 10) -> DataFrame:
    """Regress the experimental share of each concept's annotations on log(count).

    One row; below ``min_terms`` concepts it has a ``reason`` and no numbers.
    """
    per_concept = annotations.groupBy("concept_id").agg(
        F.count_distinct("unit_id").alias("n_positive"),
        F.avg(F.col("evidence").isin(experimental).cast("double")).alias("share"),
    )
    fit = simple_ols(per_concept, x=F.log(F.col("n_positive").cast("double")), y=F.col("share"))
    mean = per_concept.agg(F.avg("share").alias("m")).scalar()
    return _told(fit, min_terms, "terms").withColumn("mean_share", mean)


def parse_stored_effects(rows: DataFrame) -> DataFrame:
    """Estimate, interval and R2 read back from legacy result text; reportable rows by estimate."""
    number = r"(-?[\d.]+)"
    effect = rf"ACME={number} \(95% CI \[{number}, {number}\]"
    fit = r"R²=([\d.]+)"

    def pick(column: str, pattern: str, group: int, what: str) -> Column:
        text = F.regexp_extract(column, pattern, group)
        missing = F.raise_error(F.concat(F.lit(f"no {what} in: "), F.col(column))).cast("double")
        return F.when(text == "", missing).otherwise(text.try_cast("double"))

    return rows.where("acme_reportable").withColumns(
        {
            "acme": pick("mediation_text", effect, 1, "effect"),
            "acme_lo": pick("mediation_text", effect, 2, "effect"),
            "acme_hi": pick("mediation_text", effect, 3, "effect"),
            "r_squared": F.when(F.col("baseline_text").isNotNull(), pick("baseline_text", fit, 1, "R²")),
        }
    ).orderBy("acme")
