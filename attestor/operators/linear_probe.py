"""Multivariate probe: one penalized logistic fit per concept over sparse features.

Every concept gets its own task with a bounded number of fitted rows; all concepts run in one
job. The held-out scores of all test units come from a join of features and coefficients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.auroc import explicit_auroc, nonzero
from attestor.session import materialize

FIT_ROWS = 20_000  # train rows a concept is fitted on, half of them positives where there are enough
FIT_VALUES = 1 << 25  # stored values of these rows, by the mean number of values of a unit
SCORE_DECIMALS = 10  # equal units have equal scores, in whatever order their sums are taken


class _Rows:
    """Sparse rows with weights; products with standardized rows are never written out."""

    def __init__(self, index: list, values: list, weight: np.ndarray):
        lengths = np.array([len(i) for i in index], np.int64)
        self.n = len(lengths)
        self.row = np.repeat(np.arange(self.n), lengths)
        flat = np.concatenate([np.asarray(i, np.int64) for i in index]) if len(self.row) else np.zeros(0, np.int64)
        self.value = np.concatenate([np.asarray(v, float) for v in values]) if len(self.row) else np.zeros(0)
        self.features, self.column = np.unique(flat, return_inverse=True)
        self.weight, total = weight, weight.sum()
        # A first pass takes the means, a second the squares around them, zeros included.
        share = weight[self.row] / total
        self.mean = self._columns(share * self.value)
        gap = self.value - self.mean[self.column]
        present = self._columns(share)
        variance = self._columns(share * gap * gap) + np.maximum(1 - present, 0) * self.mean**2
        scale = np.sqrt(variance)
        constant = scale <= 1e-12 * np.maximum(np.abs(self.mean), 1e-300)
        self.inverse = np.where(constant, 0.0, 1 / np.where(constant, 1.0, scale))

    def _columns(self, entries: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, entries, minlength=len(self.features))

    def times(self, w: np.ndarray, b: float) -> np.ndarray:
        v = w * self.inverse
        return np.bincount(self.row, self.value * v[self.column], minlength=self.n) + (b - self.mean @ v)

    def back(self, e: np.ndarray) -> tuple[np.ndarray, float]:
        total = e.sum()
        return (self._columns(self.value * e[self.row]) - self.mean * total) * self.inverse, total


def fit_logistic(rows: _Rows, y: np.ndarray, strength: float, max_iter: int, tolerance: float = 1e-8):
    """Weights, intercept and whether the gradient of ``|w|^2 / 2 + strength * loss`` vanished.

    Newton steps by conjugate gradients with halved steps where the value does not fall; the
    intercept is not penalized.
    """
    w, b = np.zeros(len(rows.features)), 0.0

    def value(w, m):
        return 0.5 * w @ w + strength * (rows.weight * (np.logaddexp(0, m) - y * m)).sum()

    margin = rows.times(w, b)
    current = value(w, margin)
    for _ in range(max_iter):
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        gw, gb = rows.back(rows.weight * (p - y))
        gw, gb = w + strength * gw, strength * gb
        size = np.sqrt(gw @ gw + gb * gb)
        if size <= tolerance * (1 + np.sqrt(w @ w + b * b)):
            return w, b, True
        curve = rows.weight * p * (1 - p)
        dw, db = np.zeros_like(w), 0.0
        rw, rb = -gw, -gb
        pw, pb = rw, rb
        left = rw @ rw + rb * rb
        for _ in range(200):
            tw, tb = rows.back(curve * rows.times(pw, pb))
            tw, tb = pw + strength * tw, strength * tb
            bend = pw @ tw + pb * tb
            if bend <= 0:
                break
            a = left / bend
            dw, db, rw, rb = dw + a * pw, db + a * pb, rw - a * tw, rb - a * tb
            fresh = rw @ rw + rb * rb
            if np.sqrt(fresh) <= min(0.1, np.sqrt(size)) * 1e-2 * size:
                break
            pw, pb, left = rw + fresh / left * pw, rb + fresh / left * pb, fresh
        step, slope = 1.0, gw @ dw + gb * db
        while step > 1e-10:
            trial_w, trial_b = w + step * dw, b + step * db
            trial_margin = rows.times(trial_w, trial_b)
            trial = value(trial_w, trial_margin)
            if trial <= current + 1e-4 * step * slope + 1e-14 * abs(current):
                break
            step /= 2
        else:
            return w, b, False
        w, b, margin, current = trial_w, trial_b, trial_margin, trial
    return w, b, False


def _fit_sets(parts: DataFrame, cuts: DataFrame, ranked: DataFrame, n_units: int, rows: int) -> DataFrame:
    """``concept_id, unit_id, y, weight``: train rows of every concept, first in the unit order.

    Each class gives up to half of ``rows``; weights restore its size. The unit order is a
    hash order, so what a bound leaves out is a random part. Ranks are dense, so the
    negatives are a stretch of ranks met by an equi-join.
    """
    half = max(1, rows // 2)
    train = parts.where("part = 'train'").select("concept_id", "unit_id", "unit_rank")
    order = Window.partitionBy("concept_id").orderBy("unit_rank")
    positives = train.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= half)
    positives = positives.select("concept_id", "unit_id", F.lit(1.0).alias("y"))
    # enough ranks for the share of negatives; a concept of more than 15/16 of all units gets fewer negatives
    ranks = half * F.least(F.lit(16), F.ceil(F.lit(2 * n_units) / F.col("n_neg")))
    last = F.least(F.lit(n_units).cast("bigint"), F.col("test_cut") + ranks)
    stretch = cuts.where(F.col("test_cut") < n_units).select("concept_id", F.explode(F.sequence(F.col("test_cut") + 1, last)).alias("unit_rank"))
    others = stretch.join(ranked.select("unit_rank", "unit_id"), "unit_rank").join(parts.select("concept_id", "unit_id"), ["concept_id", "unit_id"], "left_anti")
    others = others.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= half)
    both = positives.unionByName(others.select("concept_id", "unit_id", F.lit(0.0).alias("y")))
    both = materialize(both)
    taken = both.groupBy("concept_id").agg(F.sum("y").alias("_pos"), F.sum(1 - F.col("y")).alias("_neg"))
    have = parts.groupBy("concept_id").agg(F.sum((F.col("part") == "train").cast("bigint")).alias("_all_pos"))
    sizes = cuts.select("concept_id", (F.col("n_neg") - F.col("held_neg") - F.col("select_neg")).alias("_all_neg"))
    weighed = taken.join(have, "concept_id").join(sizes, "concept_id")
    weight = F.when(F.col("y") == 1, F.col("_all_pos") / F.col("_pos")).otherwise(F.col("_all_neg") / F.col("_neg"))
    return both.join(weighed, "concept_id").select("concept_id", "unit_id", "y", weight.alias("weight"))


def linear_models(
    features: DataFrame,
    ranked: DataFrame,
    split: tuple[DataFrame, DataFrame],
    n_units: int,
    *,
    strength: float = 0.01,
    max_iter: int = 500,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per concept: ``concept_id, n_fit, converged, reason, features, coefficients``.

    ``strength`` is the inverse penalty on standardized features (constant ones get no
    coefficient); coefficients are on the scale of the stored features. A concept is fitted
    on at most ``fit_rows`` train rows, fewer where ``FIT_VALUES`` asks for it; ``reason``
    says why a fit is missing ('one class') or stopped early ('no convergence').
    """
    parts, cuts = split
    features = nonzero(features)
    mean_size = features.count() / max(1, n_units)
    rows = int(max(2, min(fit_rows, FIT_VALUES / max(1.0, mean_size))))
    sets = materialize(_fit_sets(parts, cuts, ranked, n_units, rows))
    wanted = sets.select("unit_id").distinct()
    packed = features.join(wanted, "unit_id", "left_semi").groupBy("unit_id").agg(F.collect_list(F.struct("feature_idx", "act")).alias("_f"))
    packed = packed.select(
        "unit_id",
        F.transform("_f", lambda f: f["feature_idx"].cast("bigint")).alias("index"),
        F.transform("_f", lambda f: f["act"].cast("double")).alias("value"),
    )
    joined = sets.join(packed, "unit_id", "left").select("concept_id", "unit_id", "y", "weight", "index", "value")
    concept_type = sets.schema["concept_id"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit_id")
        y = pdf["y"].to_numpy()
        out = {"concept_id": pdf["concept_id"].iloc[:1].tolist(), "n_fit": [len(pdf)], "converged": [False], "reason": ["one class"], "features": [[]], "coefficients": [[]]}
        if 0 < y.sum() < len(y):
            empty: list = []
            index = [empty if i is None else i for i in pdf["index"]]
            rows = _Rows(index, [empty if v is None else v for v in pdf["value"]], pdf["weight"].to_numpy())
            w, _, done = fit_logistic(rows, y, strength, max_iter)
            out |= {"converged": [done], "reason": [None if done else "no convergence"]}
            out |= {"features": [rows.features.tolist()], "coefficients": [(w * rows.inverse).tolist()]}
        return pd.DataFrame(out)

    schema = f"concept_id {concept_type}, n_fit bigint, converged boolean, reason string, features array<bigint>, coefficients array<double>"
    return joined.groupBy("concept_id").applyInPandas(fit, schema)


def model_auroc(features: DataFrame, ranked: DataFrame, split: tuple[DataFrame, DataFrame], models: DataFrame) -> DataFrame:
    """``concept_id, multivariate_auroc`` of the models over all test units of their concepts.

    Scores are sums over the stored features of a unit; units without any share score zero
    and are counted, not written.
    """
    parts, cuts = split
    pairs = models.select("concept_id", F.explode(F.arrays_zip("features", "coefficients")).alias("_m"))
    pairs = pairs.select("concept_id", F.col("_m.features").alias("feature_idx"), F.col("_m.coefficients").alias("_w")).where("_w <> 0")
    widest = cuts.agg(F.max("test_cut").alias("c")).scalar()
    test_positives = parts.where("part <> 'train'").select("concept_id", "unit_id")
    units = ranked.where(F.col("unit_rank") <= widest).select("unit_id").unionByName(test_positives.select("unit_id")).distinct()
    units = units.join(ranked.select("unit_id", "unit_rank"), "unit_id")
    rows = nonzero(features).join(units, "unit_id").select("unit_id", "unit_rank", F.col("feature_idx").cast("bigint").alias("feature_idx"), "act")
    scored = rows.join(pairs, "feature_idx").groupBy("concept_id", "unit_id", "unit_rank").agg(F.sum(F.col("act") * F.col("_w")).alias("_s"))
    own = parts.select("concept_id", "unit_id", "part")
    scored = scored.join(own, ["concept_id", "unit_id"], "left").join(cuts.select("concept_id", "test_cut"), "concept_id")
    pos = F.coalesce(F.col("part") != "train", F.lit(False)).cast("bigint")
    neg = (F.col("part").isNull() & (F.col("unit_rank") <= F.col("test_cut"))).cast("bigint")
    flagged = scored.select("concept_id", (F.round("_s", SCORE_DECIMALS) + 0.0).alias("score"), pos.alias("pos"), neg.alias("neg"))
    flagged = materialize(flagged.where("pos + neg > 0").groupBy("concept_id", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    seen = flagged.groupBy("concept_id").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    sizes = test_positives.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_pos"))
    silent = models.where("reason is null or reason <> 'one class'").select("concept_id").join(cuts, "concept_id").join(sizes, "concept_id").join(seen, "concept_id", "left").select(
        "concept_id",
        F.lit(0.0).alias("score"),
        (F.col("_pos") - F.coalesce("_p", F.lit(0))).alias("pos"),
        (F.col("select_neg") + F.col("held_neg") - F.coalesce("_n", F.lit(0))).alias("neg"),
    )
    return explicit_auroc(flagged.unionByName(silent), ["concept_id"]).select("concept_id", F.col("raw_auroc").alias("multivariate_auroc"))
