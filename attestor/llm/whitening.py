"""Whitening of embeddings by incremental eigendecomposition.

Entries become integers (``floor(256 * entry)``), and the spectrum is fitted to the distinct
integer vectors. Every partition keeps the eigenvalues and eigenvectors of the scatter of the
rows it has seen; the next row, centred on their mean, is a rank-one update whose eigenvalues
solve the secular equation, after entries that change nothing are deflated. Spectra of
partitions are merged by one such update per eigenvector and one for the distance of the
means. A last pass over all rows projects them on the merged basis (Rayleigh-Ritz), so the
components are exact to rounding whatever the updates have lost.

A task holds one basis of ``d x d`` numbers and one batch; spectra meet a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import materialize

COMPONENTS = 4
SCALE = 256
FAN_IN = 16  # spectra merged by one task of the merging tree
EPS = np.finfo(float).eps
WIDTHS = (1, 2, 4, 8)


@lru_cache(maxsize=64)
def _masks(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, ones, and where pole ``i`` is at or left of root ``j``, as numbers and flags."""
    upper = np.ascontiguousarray(np.tri(k, dtype=bool).T)
    return np.arange(k), np.ones(k), upper.astype(float), upper


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All roots of ``1 + sum(weights / (poles - t)) = 0`` for rising poles, positive weights.

    Root ``j`` lies between pole ``j`` and the next one, the last within the sum of weights.
    Returns the matrix ``poles[i] - root[j]``, which is accurate even where a root is close
    to a pole, and the roots. Both sums left and right of a root are replaced by a pole with
    the same value and slope, steps that leave the bracket by bisection.
    """
    k = len(poles)
    left, ones, at_left, _ = _masks(k)
    right = np.minimum(left + 1, k - 1)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    half = (ends - poles) / 2
    wide = weights[:, None]
    share = wide / (poles[:, None] - (poles + half))
    near_left = 1 + ones @ share >= 0
    near_left[-1] = True
    origin = np.where(near_left, left, right)
    gaps = poles[:, None] - poles[origin]
    low, high = np.where(near_left, 0.0, -half), np.where(near_left, half, 0.0)
    high[-1] = ends[-1] - poles[-1]
    a, b = gaps[left, left], gaps[right, left]
    s, u = weights, weights[right].copy()
    u[-1] = 0.0
    c = 1 + ones @ share + (s - u) / half  # all but the two poles around the root, at the middle
    t, done = (low + high) / 2, np.zeros(k, bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            # c (a - t)(b - t) + s (b - t) + u (a - t) = 0, by the stable one of the two formulas
            mid, last = c * (a + b) + s + u, c * a * b + s * b + u * a
            root = np.sqrt(np.maximum(mid * mid - 4 * c * last, 0.0))
            step = np.where(mid > 0, 2 * last / (mid + root), (mid - root) / (2 * c))
            step[-1] = a[-1] + s[-1] / c[-1]
            inside = (step > low) & (step < high)
            step = np.where(inside, step, (low + high) / 2)
            done |= (step == low) | (step == high)
            t = np.where(done, t, step)
            away = gaps - t
            share = wide / away
            slope = share / away
            psi, psi_slope = ones @ (share * at_left), ones @ (slope * at_left)
            phi, phi_slope = ones @ share - psi, ones @ slope - psi_slope
            phi[-1] = phi_slope[-1] = 0.0
            value = 1 + psi + phi
            done |= np.abs(value) <= 4 * EPS * k * (1 - psi + phi)
            if done.all():
                break
            low, high = np.where(value < 0, t, low), np.where(value > 0, t, high)
            to_a, to_b = a - t, b - t
            s, u = psi_slope * to_a * to_a, phi_slope * to_b * to_b
            c = value - psi_slope * to_a - phi_slope * to_b
    return gaps - t, poles[origin] + t


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors of ``basis diag(values) basis' + weight vector vector'``."""
    z = basis.T @ vector
    size = weight * (z @ z)
    if size <= 0:
        return values, basis
    tolerance = 8 * EPS * max(abs(values[-1]), abs(values[0]), size)
    equal = np.flatnonzero(np.diff(values) <= tolerance)
    if len(equal):
        values, basis = values.copy(), basis.copy()
        for i in equal.tolist():  # turn two equal directions so that one of them is orthogonal to the vector
            length = np.hypot(z[i], z[i + 1])
            if length > 0:
                c, s = z[i + 1] / length, z[i] / length
                one, two = basis[:, i].copy(), basis[:, i + 1].copy()
                basis[:, i], basis[:, i + 1] = c * one - s * two, s * one + c * two
                z[i], z[i + 1] = 0.0, length
    active = np.flatnonzero(weight * z * z > tolerance * EPS)
    if len(active) == 0:  # lost in the rounding of what is there
        return values, basis
    keep = values[active]
    if len(keep) > 1 and (np.diff(keep) <= 0).any():  # equal values left apart by a deflated one
        keep = keep + np.arange(len(keep)) * tolerance * EPS
        keep = np.maximum.accumulate(keep)
    away, roots = secular_roots(keep, weight * z[active] ** 2)
    # Weights for which the roots are exact; eigenvectors made from them are orthogonal.
    k = len(active)
    below = keep[None, :] - keep[:, None]
    ratio = np.ones((k, k))
    if k > 1:
        shifted = np.hstack([below[:, 1:], np.ones((k, 1))])
        ratio = -away / np.where(_masks(k)[3], shifted, below)
    ratio[:, -1] = -away[:, -1]
    fitted = np.sqrt(np.abs(ratio.prod(axis=1))) * np.sign(z[active])
    turn = fitted[:, None] / away
    turn /= np.sqrt((turn * turn).sum(axis=0))
    if k == len(values):
        return roots, basis @ turn
    values, moved = values.copy(), basis.copy()
    values[active], moved[:, active] = roots, basis[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], moved[:, order]


@dataclass
class Spectrum:
    """Count, mean and the eigendecomposition of the scatter around the mean."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, row: np.ndarray) -> None:
        gap = row - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, gap, self.count / (self.count + 1))
        self.count += 1
        self.mean = self.mean + gap / self.count

    def merge(self, other: Spectrum) -> None:
        total = self.count + other.count
        if other.count == 0:
            return
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, value)
        gap = other.mean - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, gap, self.count * other.count / total)
        self.mean = self.mean + gap * (other.count / total)
        self.count = total

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.count], self.mean, self.values, self.basis.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, dim: int) -> Spectrum:
        flat = np.frombuffer(raw)
        return cls(int(flat[0]), flat[1 : dim + 1], flat[dim + 1 : 2 * dim + 1], flat[2 * dim + 1 :].reshape(dim, dim))


def _clean(df: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows whose entries are all finite and have an integer in 64 bits."""
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**54)))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return np.floor(SCALE * flat).astype(np.int64)


def _names(x: np.ndarray) -> list[bytes]:
    """One byte string per row, equal for equal rows only: entries in the least width that holds them."""
    out: list[bytes] = [b""] * len(x)
    least = np.zeros(len(x), np.int64)
    for width in WIDTHS[:-1]:
        bound = 1 << (8 * width - 1)
        least += ((x < -bound) | (x >= bound)).any(axis=1)
    for place, width in enumerate(WIDTHS):
        rows = np.flatnonzero(least == place)
        raw, size = x[rows].astype(f"<i{width}").tobytes(), x.shape[1] * width
        for i, row in enumerate(rows.tolist()):
            out[row] = raw[i * size : (i + 1) * size]
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    for i, raw in enumerate(rows):
        out[i] = np.frombuffer(raw, f"<i{len(raw) // dim}")
    return out


def _fan_in(parts: DataFrame, combine) -> bytes:
    """Combine ``part, state`` rows a few at a time in tasks until one state is left."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        states = pdf.sort_values("part")["state"]
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "state": [combine(list(states))]})

    parts = materialize(parts)
    while parts.count() > FAN_IN:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(run, parts.schema))
    rows = sorted(parts.collect(), key=lambda r: r["part"])  # at most FAN_IN states
    return combine([bytes(r["state"]) for r in rows])


def _sum_states(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s) for s in states], axis=0).tobytes()


def _per_partition(rows: DataFrame, start, step) -> DataFrame:
    """``part, state`` of every partition that has rows; ``step`` adds a batch to the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, seen = start(), 0
        for batch in batches:
            if batch.num_rows:
                state, seen = step(state, batch.column("name")), seen + batch.num_rows
        if seen:
            raw = state.to_bytes() if isinstance(state, Spectrum) else state.tobytes()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([raw], pa.binary())], ["part", "state"])

    return rows.mapInArrow(run, "part bigint, state binary")


@dataclass
class Whitening:
    """A fitted transform: integer vectors are centred, projected and divided by a deviation."""

    count: int
    sums: list[int]  # exact, per dimension
    components: np.ndarray  # rows are unit eigenvectors by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / count``; the division sees the exact remainder, so nothing cancels."""
        whole = np.array([s // self.count for s in self.sums], np.int64)
        rest = np.array([s % self.count for s in self.sums], float) / self.count
        return (x - whole) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.components.T / np.sqrt(self.values), np.nan)


def _dimension(rows: DataFrame) -> int:
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("v").alias("dim"))).alias("f")).first()["f"]
    return 0 if first is None else first["dim"]


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Fit to the distinct integer vectors of ``rows(vec_id, v)``, all ``dim`` long."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_names(_integers(batch.column(0), dim)), pa.binary())], ["name"])

    distinct = materialize(rows.select("v").mapInArrow(names, "name binary").distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = [0] * dim, 0
        for batch in batches:
            x = _vectors(batch.column(0), dim)
            # Two halves of each entry are summed apart: exact for any entries of 64 bits.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
            seen += batch.num_rows
        if seen:
            place = pa.array([-1, *range(dim)], pa.int32())
            yield pa.RecordBatch.from_arrays([place, pa.array([str(t) for t in [seen, *total]])], ["place", "total"])

    exact = distinct.mapInArrow(sums, "place int, total string")
    found = {r["place"]: int(r["s"]) for r in exact.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()}
    model = Whitening(found[-1], [found[i] for i in range(dim)], np.zeros((0, dim)), np.zeros(0), np.zeros(0), 0.0)

    def update(state: Spectrum, column: pa.Array) -> Spectrum:
        for row in _vectors(column, dim).astype(float):
            state.add(row)
        return state

    def merged(states: list[bytes]) -> bytes:
        first, *others = [Spectrum.from_bytes(s, dim) for s in states]
        for other in others:
            first.merge(other)
        return first.to_bytes()

    spectrum = Spectrum.from_bytes(_fan_in(_per_partition(distinct, lambda: Spectrum.empty(dim), update), merged), dim)
    basis = np.linalg.qr(spectrum.basis[:, ::-1])[0]

    def project(state: np.ndarray, column: pa.Array) -> np.ndarray:
        y = model.centred(_vectors(column, dim)) @ basis
        return state + y.T @ y

    gram = np.frombuffer(_fan_in(_per_partition(distinct, lambda: np.zeros((dim, dim)), project), _sum_states)).reshape(dim, dim)
    values, turn = np.linalg.eigh(gram / model.count)
    wanted = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(gram)) / model.count
    # A direction without variance is left with the rounding errors of the others.
    model.values = np.where(values[wanted] > trace * dim * EPS, values[wanted], 0.0)
    model.components = (basis @ turn[:, wanted]).T
    model.explained = model.values / trace if trace > 0 else np.full(len(wanted), np.nan)
    size = len(wanted)

    def moments(state: np.ndarray, column: pa.Array) -> np.ndarray:
        w = np.hstack([np.nan_to_num(model.project(_vectors(column, dim))), np.ones((len(column), 1))])
        return state + w.T @ w

    raw = _fan_in(_per_partition(distinct, lambda: np.zeros((size + 1, size + 1)), moments), _sum_states)
    second = np.frombuffer(raw).reshape(size + 1, size + 1) / model.count
    covariance = second[:size, :size] - np.outer(second[:size, size], second[:size, size])
    live = model.values > 0
    gaps = np.abs(covariance - np.eye(size))[np.ix_(live, live)]
    model.identity_error = float(gaps.max()) if gaps.size else 0.0
    return model


OUTPUT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``df(vec_id, embedding, ...)`` and leading component.

    ``deviation`` is the sum of ``(n x - S)^2`` over dimensions, exact; null where it exceeds
    64 bits. Rows whose vector is null, holds null or non-finite entries, or entries of 2^54
    and more, take no part, nor do rows whose vector is longer or shorter than that of the
    smallest id. Repeated rows and ids, also null ones, each give their own rows; the fit
    sees equal integer vectors once. Vectors with fewer dimensions than ``components`` give
    one row per dimension, empty vectors and an empty table none. A component without variance
    has null ``whitened``, and ``explained`` is null if no component has any. Equal
    eigenvalues leave the choice of their eigenvectors open, but it is the same for all rows.
    Other columns are not looked at.
    """
    rows = _clean(df)
    dim = _dimension(rows)
    if dim == 0:
        return df.sparkSession.createDataFrame([], OUTPUT)
    rows = rows.where(F.size("v") == dim)
    model = fit(rows, dim, components)
    n, sums = model.count, model.sums
    size, squared = len(model.values), sum(s * s for s in model.sums)
    small = all(abs(s) < 2**31 for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _integers(batch.column("v"), dim)
            exact = small and dim * int(np.abs(x).max()) < 2**31
            whole = x if exact else x.astype(object)
            own = (whole * whole).sum(axis=1).tolist()
            cross = (whole * np.array(sums, np.int64 if exact else object)).sum(axis=1).tolist()
            deviation = [n * n * a - 2 * n * b + squared for a, b in zip(own, cross, strict=True)]
            deviation = [v if v < 2**63 else None for v in deviation]
            y = model.project(x)
            count = len(x)
            pick = pa.array(np.repeat(np.arange(count), size))
            columns = [
                batch.column("vec_id").take(pick),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                pa.array(np.full(count * size, n)),
                pa.array(deviation, pa.int64()).take(pick),
                pa.array(y.ravel(), from_pandas=True),
                pa.array(np.tile(model.explained, count), from_pandas=True),
                pa.array(np.full(count * size, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUTPUT.split(", ")])

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v").mapInArrow(run, OUTPUT)
