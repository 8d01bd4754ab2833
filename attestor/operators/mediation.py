"""Per-locus mediation, sensitivity and baselines from one set of moments per locus.

Every regression here has an intercept, so means and pairwise covariances are enough.
They are built-in mergeable aggregates: a locus with very many samples is combined
map-side and never gathered. What reaches Python is one small matrix per locus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import tails
from attestor.functions.stats import acme_reportable, proportion_reportable
from attestor.operators.inference import adjust_fdr, equivalence_test
from attestor.operators.ordering import hash_int, order_hash
from attestor.session import materialize

RHO_GRID = [round(-0.9 + 0.05 * i, 2) for i in range(37)]


# ---------------------------------------------------------------- inputs


def align_samples(loci: DataFrame, dosage: DataFrame, expression: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): dosage ``t`` next to expression ``y`` on shared samples of each locus.

    ``loci`` has (locus, variant_id, gene_id). A locus whose gene or variant is absent, or
    without a shared sample, is reported with its reason.
    """
    calls = loci.join(dosage.select("variant_id", "sample_id", F.col("dosage").cast("double").alias("t")), "variant_id")
    rows = calls.join(
        expression.select("gene_id", "sample_id", F.col("value").alias("y")).where(F.col("y").isNotNull()),
        ["gene_id", "sample_id"],
    ).select("locus", "variant_id", "gene_id", "sample_id", "t", "y")
    genes = expression.select("gene_id").distinct().withColumn("_gene", F.lit(True))
    variants = dosage.select("variant_id").distinct().withColumn("_variant", F.lit(True))
    kept = rows.select("locus").distinct().withColumn("_kept", F.lit(True))
    marked = loci.join(genes, "gene_id", "left").join(variants, "variant_id", "left").join(kept, "locus", "left")
    reason = (
        F.when(F.col("_variant").isNull(), "variant not genotyped")
        .when(F.col("_gene").isNull(), "gene not in expression table")
        .otherwise("no shared samples")
    )
    skipped = marked.where(F.col("_kept").isNull()).select("locus", reason.alias("skip_reason"))
    return rows, skipped


def add_ancestry(rows: DataFrame, panel: DataFrame, *, strict: bool = True) -> DataFrame:
    """Attach ``superpopulation``; a sample missing from the panel is an error when strict."""
    joined = rows.join(panel.select("sample_id", "superpopulation"), "sample_id", "left")
    if not strict:
        return joined
    message = F.concat(F.lit("no population label for sample "), F.col("sample_id").cast("string"))
    value = F.col("superpopulation")
    return joined.withColumn(
        "superpopulation", F.when(value.isNull(), F.raise_error(message).cast("string")).otherwise(value)
    )


def ancestry_dummies(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    """Long 0/1 dummies of the levels present at each locus, first level dropped."""
    levels = rows.select(*keys, F.col("superpopulation").alias("level")).distinct()
    order = Window.partitionBy(*keys).orderBy("level")  # a handful of levels
    used = levels.withColumn("_r", F.row_number().over(order)).where(F.col("_r") > 1).drop("_r")
    return rows.join(used, keys).select(
        *keys, "sample_id", "level", (F.col("superpopulation") == F.col("level")).cast("int").alias("value")
    )


def population_counts(rows: DataFrame, *, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "superpopulation").agg(F.count(F.lit(1)).alias("n_samples"))


def hash_noise(*parts, seed) -> Column:
    """Standard normal noise that is a pure function of the row's ids."""
    scale = F.lit(4294967296.0)
    u1 = (hash_int(order_hash(f"{seed}:u", *parts)) + 0.5) / scale
    u2 = (hash_int(order_hash(f"{seed}:v", *parts)) + 0.5) / scale
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


# ---------------------------------------------------------------- moments


def moments(
    rows: DataFrame, *, keys: list[str], columns: list[str], numeric: list[str] | None = None, category: str | None = None
) -> DataFrame:
    """One row per group: ``n``, ``mu`` and flattened covariance ``s`` of the named columns.

    Column order: ``columns``, numeric covariates, then one dummy per category level seen
    anywhere; a group's absent and first-present levels are dropped by the solver.
    """
    numeric = numeric or []
    levels: list = []
    if category is not None:
        # a coding table: one column of the moment matrix per level
        levels = sorted(r[0] for r in rows.select(category).distinct().collect() if r[0] is not None)
    values = [F.col(c).cast("double") for c in [*columns, *numeric]]
    values += [(F.col(category) == F.lit(v)).cast("double") for v in levels]
    names = [f"v{i}" for i in range(len(values))]
    wide = rows.select(*keys, *[v.alias(n) for v, n in zip(values, names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    grouped = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(n) for n in names]).alias("mu"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("s"),
    )
    return grouped.withColumn("n_levels", F.lit(len(levels)))


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def _used(mu: np.ndarray, n_levels: int) -> list[int]:
    """Covariate positions to keep: every numeric one, and present levels but the first."""
    size = len(mu)
    present = [i for i in range(size - n_levels, size) if mu[i] > 0]
    return [*range(size - n_levels), *present[1:]]


def _ols(s: np.ndarray, n: int, y: int, xs: list[int]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coefficients, covariance, residual sum of squares, R2) of y on xs plus intercept."""
    sxx, sxy, syy = s[np.ix_(xs, xs)], s[xs, y], s[y, y]
    inverse = np.linalg.pinv(sxx, rcond=1e-12, hermitian=True)
    b = inverse @ sxy
    rss = max(0.0, float(n * (syy - b @ sxy)))
    rank = int(np.linalg.matrix_rank(sxx, tol=1e-12 * max(1e-300, float(np.max(np.abs(sxx)))), hermitian=True))
    dof = n - 1 - rank
    sigma2 = rss / dof if dof > 0 else float("nan")
    r2 = 1 - rss / (n * syy) if syy > 0 else float("nan")
    return b, sigma2 * inverse / n, rss, r2


def _solve(table: DataFrame, keys: list[str], out_schema: str, solver: Callable[[tuple, int, np.ndarray, np.ndarray, list[int]], list[tuple]]) -> DataFrame:
    key_schema = ", ".join(f"{k} {table.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.strip().split(" ")[0] for part in out_schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                mu = np.asarray(row.mu, dtype=float)
                s = _square(np.asarray(row.s, dtype=float), len(mu))
                for result in solver(key, int(row.n), mu, s, _used(mu, int(row.n_levels))):
                    records.append((*key, *result))
            yield pd.DataFrame(records, columns=[*keys, *names])

    return table.mapInPandas(run, f"{key_schema}, {out_schema}")


# ---------------------------------------------------------------- mediation


MEDIATION_SCHEMA = (
    "n_obs bigint, beta double, delta double, acme double, acme_lo double, acme_hi double, acme_p double,"
    " ade double, ade_lo double, ade_hi double, ade_p double, total double, total_lo double, total_hi double,"
    " total_p double, proportion double, mediator_sd double, sigma_1 double, sigma_2 double"
)


FIT_SCHEMA = (
    "n_obs bigint, beta double, delta double, acme double, ade double, total double, proportion double, mediator_sd double,"
    " sigma_1 double, sigma_2 double, var_beta double, var_ade double, cov_effects double, var_delta double"
)


def mediation(
    rows: DataFrame,
    *,
    keys: list[str],
    numeric: list[str] | None = None,
    category: str | None = None,
    n_rep: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Effects of ``t`` on ``y`` through ``m`` for every group at once.

    Point estimates are products of coefficients. Intervals and p-values come from ``n_rep``
    draws of the estimated coefficients: normals that are hashes of the group and the draw,
    correlated by a 2 x 2 Cholesky factor, all inside one row, so nothing is shuffled and any
    engine can replay them. They are NaN where a coefficient has no variance estimate.
    """
    base = moments(rows, keys=keys, columns=["t", "m", "y"], numeric=numeric, category=category)

    def solver(key, n, mu, s, used):
        extra = [i for i in used if i > 2]
        b1, c1, rss1, _ = _ols(s, n, 1, [0, *extra])
        b2, c2, rss2, _ = _ols(s, n, 2, [0, 1, *extra])
        beta, ade, delta = float(b1[0]), float(b2[0]), float(b2[1])
        total = beta * delta + ade
        proportion = beta * delta / total if total != 0 else float("nan")
        dof = max(1, n - 1)
        spread = (float(c1[0, 0]), float(c2[0, 0]), float(c2[0, 1]), float(c2[1, 1]))
        scales = (math.sqrt(max(0.0, s[1, 1])), math.sqrt(rss1 / dof), math.sqrt(rss2 / dof))
        return [(n, beta, delta, beta * delta, ade, total, proportion, *scales, *spread)]

    solved = _solve(base, keys, FIT_SCHEMA, solver)
    out = _simulated(solved, keys, n_rep, seed).select(*keys, *[c.split()[0] for c in MEDIATION_SCHEMA.split(", ")])
    return out.withColumns(
        {
            "acme_reportable": acme_reportable(F.col("mediator_sd")),
            "proportion_reportable": proportion_reportable(F.col("total_lo"), F.col("total_hi")),
        }
    )


def _simulated(fits: DataFrame, keys: list[str], n_rep: int, seed) -> DataFrame:
    """Add ``*_lo, *_hi, *_p`` of the three effects from draws of the coefficients."""

    def normal(name: str, draw: Column) -> Column:
        return hash_noise(*keys, draw, seed=f"{seed}:{name}")

    def root(value: Column) -> Column:
        return F.sqrt(F.greatest(value, F.lit(0.0)))

    first = root(F.col("var_ade"))
    across = F.when(first > 0, F.col("cov_effects") / first).otherwise(0.0)
    fits = fits.withColumns({"_l00": first, "_l10": across, "_l11": root(F.col("var_delta") - across * across), "_sb": root(F.col("var_beta"))})

    def draw(i: Column) -> Column:
        z = normal("ade", i)
        direct = F.col("ade") + F.col("_l00") * z
        through = (F.col("beta") + F.col("_sb") * normal("beta", i)) * (F.col("delta") + F.col("_l10") * z + F.col("_l11") * normal("delta", i))
        return F.struct(through.alias("acme"), direct.alias("ade"), (through + direct).alias("total"))

    finite = F.lit(True)
    for c in ("var_beta", "var_ade", "cov_effects", "var_delta"):
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    drawn = fits.withColumn("_draws", F.transform(F.sequence(F.lit(0), F.lit(n_rep - 1)), draw))
    nan = F.lit(float("nan"))
    added = {}
    for name in ("acme", "ade", "total"):
        values = F.col(f"_sorted_{name}")
        drawn = drawn.withColumn(f"_sorted_{name}", F.array_sort(F.col("_draws").getField(name)))

        def at(q: float, values=values) -> Column:
            place = q * (n_rep - 1)
            low, high = F.get(values, F.lit(math.floor(place))), F.get(values, F.lit(min(n_rep - 1, math.floor(place) + 1)))
            return low + (high - low) * (place - math.floor(place))

        above, below = (F.size(F.filter(values, test)) / n_rep for test in (lambda v: v > 0, lambda v: v < 0))
        added[f"{name}_lo"] = F.when(finite, at(0.025)).otherwise(nan)
        added[f"{name}_hi"] = F.when(finite, at(0.975)).otherwise(nan)
        added[f"{name}_p"] = F.when(finite, 2 * F.least(above, below)).otherwise(nan)
    return drawn.withColumns(added)


def negative_control(rows: DataFrame, *, keys: list[str], seed: int = 42, **options) -> DataFrame:
    """Mediation with an uninformative mediator; no effect should be found."""
    noisy = rows.withColumn("m", hash_noise(*keys, "sample_id", seed=seed))
    return mediation(noisy, keys=keys, seed=seed, **options)


def sensitivity_curve(effects: DataFrame, *, keys: list[str], grid: list[float] | None = None) -> DataFrame:
    """Mediated effect at each error correlation rho; needs the ``mediation`` columns."""
    rho = F.col("rho")
    curve = effects.select(
        *keys, "beta", "delta", "sigma_1", "sigma_2",
        F.explode(F.array(*[F.lit(r) for r in (grid or RHO_GRID)])).alias("rho"),
    )
    shift = rho * F.col("sigma_2") / (F.nullif(F.col("sigma_1"), F.lit(0.0)) * F.sqrt(1 - rho * rho))
    return curve.select(*keys, "rho", (F.col("beta") * (F.col("delta") - shift)).alias("acme_at_rho"))


def zero_crossing(curve: DataFrame, *, keys: list[str]) -> DataFrame:
    """First rho at which the curve changes sign, interpolated; NULL when it never does."""
    order = Window.partitionBy(*keys).orderBy("rho")  # one row per grid value
    y, x = F.col("acme_at_rho"), F.col("rho")
    steps = curve.withColumns({"_y1": F.lead("acme_at_rho").over(order), "_x1": F.lead("rho").over(order)})
    crossing = F.signum(F.col("_y1")) != F.signum(y)
    at = x + (0 - y) * (F.col("_x1") - x) / (F.col("_y1") - y)
    return steps.groupBy(*keys).agg(F.min_by(F.when(crossing, at), F.when(crossing, x)).alias("rho_star"))


def baseline_regression(
    rows: DataFrame,
    *,
    keys: list[str],
    predictor: str,
    method: str,
    numeric: list[str] | None = None,
    category: str | None = None,
) -> DataFrame:
    """``y ~ predictor (+ covariates)`` per group: R2, coefficient, p-value, n."""
    base = moments(rows, keys=keys, columns=[predictor, "y"], numeric=numeric, category=category)

    def solver(key, n, mu, s, used):
        xs = [0, *[i for i in used if i > 1]]
        b, cov, rss, r2 = _ols(s, n, 1, xs)
        dof = n - 1 - len(xs)
        se = math.sqrt(cov[0, 0]) if cov[0, 0] > 0 else float("nan")
        p = 2 * tails.t_sf_value(abs(float(b[0]) / se), dof) if se > 0 and dof > 0 else float("nan")
        return [(method, r2, float(b[0]), p, n)]

    return _solve(base, keys, "method string, r_squared double, coefficient double, p_value double, n_obs bigint", solver)


def distance_to_reference(samples: DataFrame, reference: DataFrame, *, keys: list[str]) -> DataFrame:
    """L2 distance of each sample's vector to its locus's reference vector."""
    from attestor.operators.vectors import l2_distance

    joined = samples.join(reference.select(*keys, F.col("vec").alias("_ref")), keys)
    return joined.withColumn("distance", l2_distance(F.col("vec"), F.col("_ref"))).drop("_ref")


def score_haplotypes(haplotypes: DataFrame, scorer: Callable[[DataFrame], DataFrame], *, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Score each distinct sequence once, then average a sample's haplotypes.

    ``haplotypes`` has (keys, sample_id, haplotype, sequence); ``scorer`` maps
    (sequence_id, sequence) to (sequence_id, feature_idx, act). Returns
    ``(keys, sample_id, feature_idx, m)`` and (n_unique, n_total) per group.
    """
    hashed = materialize(haplotypes.withColumn("sequence_id", F.sha2("sequence", 256)))
    unique = hashed.groupBy("sequence_id").agg(F.first("sequence").alias("sequence"))
    scored = scorer(unique)
    links = hashed.select(*keys, "sample_id", "haplotype", "sequence_id")
    copies = links.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("_n"))
    summed = links.join(scored, "sequence_id").groupBy(*keys, "sample_id", "feature_idx").agg(F.sum("act").alias("_sum"))
    per_sample = summed.join(copies, [*keys, "sample_id"]).select(
        *keys, "sample_id", "feature_idx", (F.col("_sum") / F.col("_n")).alias("m")
    )
    counts = links.groupBy(*keys).agg(
        F.count_distinct("sequence_id").alias("n_unique"), F.count(F.lit(1)).alias("n_total")
    )
    return per_sample, counts


# ---------------------------------------------------------------- across loci


def adjust_arms(results: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """FDR per arm over reportable loci only; the others get NULL and false."""
    tested = results.withColumn("_p", F.when(F.col("acme_reportable"), F.col("acme_p")))
    out = adjust_fdr(tested, p="_p", family=["arm"], alpha=alpha).drop("_p")
    return out.withColumnsRenamed({"p_adjusted": "acme_p_bh", "significant": "significant_after_bh"})


def proportion_equivalence(results: DataFrame, *, margin: float) -> DataFrame:
    """Equivalence of the mean reportable proportion to zero, with a repeated-gene flag."""
    kept = results.where(F.col("acme_reportable") & F.col("proportion_reportable"))
    excluded = results.where(F.col("acme_reportable") & ~F.col("proportion_reportable"))
    test = equivalence_test(kept, value="proportion", margin=margin)
    genes = kept.agg(F.count_distinct("gene_id").alias("g"))
    out = test.withColumns(
        {
            "n_distinct_genes": genes.select("g").scalar(),
            "n_excluded": excluded.agg(F.count(F.lit(1)).alias("n")).scalar(),
        }
    )
    return out.withColumn("repeated_genes", F.col("n_distinct_genes") < F.col("n"))


def attach_features(loci: DataFrame, naive: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Naive feature of each locus's gene, and the registry's verdict on that feature."""
    return loci.join(naive.select("gene_id", "feature_idx"), "gene_id", "left").join(
        verdicts.select("feature_idx", "status", "reason", "match_rate"), "feature_idx", "left"
    )
