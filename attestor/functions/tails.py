"""Normal, t and chi-square tails as Arrow-batched UDFs (Spark SQL has no erf)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf_value(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf_value(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf_value(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def t_ppf_value(p: float, df: float) -> float:
    """Quantile by bisection on the survival function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf_value(1 - p, df)
    hi = 1.0
    while t_sf_value(hi, df) > 1 - p:
        hi *= 2
    lo = 0.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_sf_value(mid, df) > 1 - p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_sf_value(x: float, df: float) -> float:
    """P(X > x) through the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    scale = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= half / k
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = half + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    out = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return scale * out


# ---------------------------------------------------------------- whole batches


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers: shifted up by recurrence, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = shift + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def _away(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) > 1e-300, v, 1e-300)


def _fraction(term, first: np.ndarray, rounds: int, start: float = 1.0) -> np.ndarray:
    """Continued fractions of a batch (modified Lentz): ``term(m, c, d)`` gives ``c, d, factor``."""
    c, d = np.full_like(first, start), 1 / _away(first)
    out, live = d.copy(), np.ones(len(first), dtype=bool)
    for m in range(1, rounds):
        c2, d2, factor = term(m, c, d)
        c, d = np.where(live, c2, c), np.where(live, d2, d)
        out = np.where(live, out * factor, out)
        live &= np.abs(c * d - 1) >= 1e-15
        if not live.any():
            break
    return out


def _beta_fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    def term(m, c, d):
        factor = np.ones_like(x)
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + step * d)
            c = 1 + step / _away(c)
            factor = factor * c * d
        return c, d, factor

    return _fraction(term, 1 - (a + b) * x / (a + 1), 500)


def _beta_incs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    inside = (x > 0) & (x < 1)
    x0 = np.where(inside, x, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x0) + b * np.log1p(-x0))
    left = x0 < (a + 1) / (a + b + 2)  # the side on which the fraction converges fast
    p, q, y = np.where(left, a, b), np.where(left, b, a), np.where(left, x0, 1 - x0)
    part = front * _beta_fractions(p, q, y) / p
    return np.where(inside, np.where(left, part, 1 - part), np.where(x <= 0, 0.0, 1.0))


def _t_sfs(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    half = 0.5 * _beta_incs(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0, half, 1 - half)


def _quantiles(sf, tail: np.ndarray) -> np.ndarray:
    """Where ``sf`` falls to ``tail`` (at most a half), by bisection of all rows at once."""
    lo, hi = np.zeros_like(tail), np.ones_like(tail)
    while (short := sf(hi) > tail).any():
        hi = np.where(short, hi * 2, hi)
    for _ in range(200):
        mid = (lo + hi) / 2
        if ((mid == lo) | (mid == hi)).all():
            break
        right = sf(mid) > tail
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return (lo + hi) / 2


def _signed(p: np.ndarray, sf) -> np.ndarray:
    """Quantiles of a symmetric law: infinite at 0 and 1, NaN beyond."""
    inside = (p > 0) & (p < 1)
    size = np.where(p == 0.5, 0.0, _quantiles(sf, np.where(inside, np.minimum(p, 1 - p), 0.25)))
    edge = np.where((p < 0) | (p > 1), np.nan, np.where(p == 0, -np.inf, np.inf))
    return np.where(inside, np.where(p < 0.5, -size, size), edge)


def _t_ppfs(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    return _signed(p, lambda t: _t_sfs(t, df))


def _chi2_sfs(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    a, half = df / 2, np.where(x > 0, x, 1.0) / 2
    scale = np.exp(-half + a * np.log(half) - _lgamma(a))
    low = half < a + 1
    term = np.where(low, 1 / a, 0.0)
    total, k = term.copy(), a.copy()
    while (np.abs(term) > 1e-17 * np.abs(total)).any():
        k = k + 1
        term = term * half / k
        total = total + term
    first = np.where(low, a + 3, half) + 1 - a  # rows of the series side get a fraction that converges

    def step(m, c, d):
        d = 1 / _away(first + 2 * m - m * (m - a) * d)
        c = first + 2 * m - m * (m - a) / _away(c)
        return c, d, c * d

    upper = scale * _fraction(step, first, 1000, start=1e300)
    return np.where(x <= 0, 1.0, np.where(low, np.maximum(0.0, 1 - scale * total), upper))


def _norm_sfs(z: np.ndarray) -> np.ndarray:
    """P(Z > z): half of what a chi-square of one degree has beyond z squared."""
    half = 0.5 * _chi2_sfs(z * z, np.ones_like(z))
    return np.where(z >= 0, half, 1 - half)


def _finite(fn, *series: pd.Series) -> pd.Series:
    """``fn`` over the rows whose values are all finite, NaN elsewhere."""
    values = [np.asarray(s, dtype=float) for s in series]
    good = np.logical_and.reduce([np.isfinite(v) for v in values])
    out = np.full(len(good), np.nan)
    if good.any():
        with np.errstate(over="ignore", under="ignore"):
            out[good] = fn(*[v[good] for v in values])
    return pd.Series(out)


def _cdf_batch(z: pd.Series) -> pd.Series:
    return _finite(lambda v: _norm_sfs(-v), z)


def _ppf_batch(p: pd.Series) -> pd.Series:
    return _finite(lambda v: _signed(v, _norm_sfs), p)


def _t_sf_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    return _finite(_t_sfs, t, df)


def _t_ppf_batch(p: pd.Series, df: pd.Series) -> pd.Series:
    return _finite(_t_ppfs, p, df)


def _chi2_batch(x: pd.Series, df: pd.Series) -> pd.Series:
    return _finite(_chi2_sfs, x, df)


def norm_cdf(z: Column) -> Column:
    return F.when(z.isNotNull(), F.pandas_udf(_cdf_batch, "double")(z.cast("double")))


def norm_ppf(p: Column) -> Column:
    return F.when(p.isNotNull(), F.pandas_udf(_ppf_batch, "double")(p.cast("double")))


def _with_df(fn, value: Column, df: Column) -> Column:
    return F.when(value.isNotNull() & (df > 0), F.pandas_udf(fn, "double")(value.cast("double"), F.greatest(df.cast("double"), F.lit(1.0))))


def t_sf(t: Column, df: Column) -> Column:
    return _with_df(_t_sf_batch, t, df)


def t_ppf(p: Column, df: Column) -> Column:
    return _with_df(_t_ppf_batch, p, df)


def chi2_sf(x: Column, df: Column) -> Column:
    return _with_df(_chi2_batch, x, df)


# Closed forms for SQL users, as SQL functions that Catalyst inlines; ``functions.stats`` has the columns.
SQL_FORMS = {
    "auroc_variance(a DOUBLE, p DOUBLE, n DOUBLE)":
        "(a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)",
    "expected_max_inflation(sigma DOUBLE, d DOUBLE)":
        "sigma * (sqrt(2 * ln(2 * d)) - (ln(ln(2 * d)) + ln(4 * pi())) / (2 * sqrt(2 * ln(2 * d))) + 0.5772156649015329D / sqrt(2 * ln(2 * d)))",
    "logistic_prediction(intercept DOUBLE, slope DOUBLE, x DOUBLE)":
        "1 / (1 + exp(-(intercept + slope * ln(x))))",
}


def register_sql(spark) -> None:
    """Expose the tails and closed forms to SQL users."""
    for name, fn in {"norm_cdf": _cdf_batch, "norm_ppf": _ppf_batch, "t_sf": _t_sf_batch, "chi2_sf": _chi2_batch}.items():
        spark.udf.register(name, F.pandas_udf(fn, "double"))
    for head, body in SQL_FORMS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
