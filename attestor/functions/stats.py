"""Closed-form statistics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329

# Numeric target and ordinal codes of the closed vocabularies.
STATUS_TARGET = {"confirmed": 1.0, "plausible": 0.5, "spurious": 0.0}
STATUS_ORDINAL = {"spurious": 0, "plausible": 1, "confirmed": 2}
CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
STATUSES = ["confirmed", "plausible", "spurious", "unverifiable"]
CONFIDENCES = ["high", "medium", "low"]


def _coded(value: Column, codes: dict) -> Column:
    out = None
    for key, code in codes.items():
        out = F.when(value == key, F.lit(code)) if out is None else out.when(value == key, F.lit(code))
    return out


def status_target(status: Column) -> Column:
    """1, 0.5 or 0; NULL (never 0) for anything not on the scale."""
    return _coded(status, STATUS_TARGET)


def status_ordinal(status: Column) -> Column:
    return _coded(status, STATUS_ORDINAL)


def confidence_rank(confidence: Column) -> Column:
    return _coded(confidence, CONFIDENCE_RANK)


def auroc_variance(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Hanley-McNeil (1982) variance of an empirical AUROC."""
    q1 = auc / (2 - auc)
    q2 = 2 * auc * auc / (1 + auc)
    spread = auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)
    return spread / (n_pos * n_neg)


def expected_max_inflation(sigma: Column, d: Column, folded: bool = True) -> Column:
    """Mean of the largest of d Gaussian errors (Gumbel-corrected); 2d when reflected."""
    log_n = F.log((2 * d if folded else d).cast("double"))
    a = F.sqrt(2 * log_n)
    b = a - (F.log(log_n) + math.log(4 * math.pi)) / (2 * a)
    return sigma * (b + EULER_GAMMA / a)


def logistic_prediction(intercept: Column, slope: Column, x: Column) -> Column:
    return 1 / (1 + F.exp(-(intercept + slope * F.log(x))))


def effect_per_doubling(intercept: Column, slope: Column) -> Column:
    one, two = F.lit(1.0), F.lit(2.0)
    return logistic_prediction(intercept, slope, two) - logistic_prediction(intercept, slope, one)


def se_from_ci(lo: Column, hi: Column, critical: Column) -> Column:
    """Standard error behind a symmetric interval built with ``critical``."""
    return (hi - lo) / 2 / critical


def acme_reportable(mediator_sd: Column) -> Column:
    return mediator_sd > 1e-8


def proportion_reportable(lo: Column, hi: Column) -> Column:
    """The ratio is only meaningful when the total effect's interval excludes zero."""
    return ~((lo <= 0) & (hi >= 0))
