"""Embedding whitening with a spectral divide-and-conquer of the covariance.

Entries are fixed-point numbers x = floor(64 c) + 1000000, so sums and products of all vectors are exact whole numbers
and no result depends on how rows are spread over tasks. The covariance is made of vectors centred at the rounded mean
before anything is multiplied, and corrected by what rounding left, exactly.

Its eigenvectors come from polar decompositions: QDWH (dynamically weighted Halley steps, each one QR factorisation) gives
the orthogonal polar factor U of V - shift I. (U + I) / 2 projects on the eigenvectors above the shift. Bases of the two sides
split V in two smaller matrices, which are split in the same way down to single components.
Only this works on the driver; it is as large as a vector is long, squared, whatever the number of rows. The components
found are sent to all tasks and every vector is projected where it lies.

Cases: null vectors and those with null or non-finite entries take no part; vectors of each length are a population of their
own; empty vectors have no components and no rows; repeated rows and ties count and get rows each; null ids stay; a component
without variance (one vector alone, constant entries) has explained 0 and whitened null, and no part in identity_error; an
entry of which x is no long is an error; deviations have 38 digits, enough for any count of vectors; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, SHIFT, MOST = 64, 1_000_000, 32
EPS = float(np.finfo(float).eps)


# ---- polar decomposition and splitting, on a matrix as wide as a vector is long

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QDWH."""
    n = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    low = EPS  # nothing is known about the least singular value
    for _ in range(12):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))
        new = (q / r) * x + ((p - q / r) / np.sqrt(r)) * (both[:n] @ both[n:].T)
        low, gone, x = min(1.0, low * (p + q * low**2) / (1 + r * low**2)), np.linalg.norm(new - x), new
        if gone <= np.cbrt(5 * EPS) * np.linalg.norm(x) and abs(1 - low) < 10 * EPS:
            break
    return x


def _sides(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Orthonormal bases of the invariant subspaces above and below the shift, and what is left between them."""
    n = len(a)
    u = polar(a - shift * np.eye(n))
    p = ((u + u.T) / 2 + np.eye(n)) / 2
    k = round(float(np.trace(p)))
    if not 0 < k < n:
        return None
    basis, _ = np.linalg.qr(p @ rng.normal(size=(n, k)))
    full, _ = np.linalg.qr(p @ basis, mode="complete")
    return full[:, :k], full[:, k:], float(np.linalg.norm(full[:, k:].T @ a @ full[:, :k]))


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    n, rng = len(v), np.random.default_rng(0)
    size = np.linalg.norm(v)
    vectors, todo = np.empty((n, 0)), [(v, np.eye(n))]
    while todo:
        a, basis = todo.pop()
        m = len(a)
        off = a - np.diag(np.diag(a))
        if m == 1 or np.linalg.norm(off) <= 0.1 * EPS * size:
            vectors = np.column_stack([vectors, basis])
            continue
        diagonal = np.sort(np.diag(a))
        middle = diagonal[(m - 1) // 2 : m // 2 + 1].mean()
        spread = np.linalg.norm(a - np.trace(a) / m * np.eye(m)) / np.sqrt(m)
        # A shift that meets an eigenvalue leaves a rest; another one then does better.
        tries = []
        for step in (0, 0.3, -0.3, 0.7, -0.7, 0.13, -0.13, 1.1, -1.1):
            sides = _sides(a, middle + step * spread, rng)
            if sides:
                tries.append(sides)
                if sides[2] <= 4 * EPS * size:
                    break
        above, below, _ = min(tries, key=lambda s: s[2])
        for side in (above, below):
            part = side.T @ a @ side
            todo.append(((part + part.T) / 2, basis @ side))
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return values[order], vectors


# ---- exact sums over all vectors

class Fit(NamedTuple):
    """What is known about the vectors of one length: exact sums, and the components that have variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    error: float | None = None

    @property
    def center(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what rounding the mean left."""
        return np.array([s - self.n * int(c) for s, c in zip(self.sums, self.center)], np.int64)

    @property
    def whitener(self) -> np.ndarray:
        good = self.values > 0
        return self.vectors[:, good] / np.sqrt(self.values[good])


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Runs of rows whose vectors have one length, as whole numbers."""
    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for d in np.unique(lengths):
            part = batch.filter(pa.array(lengths == d)) if (lengths != d).any() else batch
            c = np.asarray(part.column("vector").flatten(), float).reshape(-1, d) if d else np.zeros((part.num_rows, 0))
            x = np.floor(SCALE * c) + SHIFT
            if d and np.abs(x).max() >= 2.0**63:
                raise OverflowError("an entry times 64 is no long")
            if d:
                yield int(d), x.astype(np.int64), part


def _sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python numbers, exact at any size."""
    small = float(np.abs(x).max(initial=0)) * len(x) < 2.0**62
    return x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)


def _products(y: np.ndarray) -> np.ndarray:
    """y.T @ y as Python numbers. Doubles are exact below 2^53, so rows go in runs that stay below."""
    most = float(np.abs(y).max(initial=0)) ** 2
    if most >= 2.0**53:
        y = y.astype(object)
        return y.T @ y
    step = max(1, int(2.0**53 / max(most, 1.0)))
    f = y.astype(float)
    return sum((f[i : i + step].T @ f[i : i + step]).astype(np.int64).astype(object) for i in range(0, len(f), step))


_SUMS = "width int, i int, v array<decimal(38,0)>, n long"


def _summed(rows: DataFrame, what, kind: str = _SUMS) -> dict[int, tuple[int, dict[int, list[int]]]]:
    """For every length: rows, and the sums over all tasks of the lines that `what(d, x)` gives for a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for d, x, _ in by_length(batches):
            lines, n = what(d, x), len(x)
            total[d] = [total[d][0] + lines, total[d][1] + n] if d in total else [lines, n]
        for d, (lines, n) in total.items():
            values = [[Decimal(int(a)) for a in line] for line in lines] if lines.dtype == object else lines.tolist()
            inner = pa.decimal128(38, 0) if lines.dtype == object else pa.float64()
            yield pa.record_batch([pa.array([d] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                                   pa.array(values, pa.list_(inner)), pa.array([n] * len(values), pa.int64())], ["width", "i", "v", "n"])

    parts = rows.mapInArrow(run, kind).select("width", "i", "n", F.posexplode("v").alias("j", "v"))
    out: dict[int, tuple[int, dict[int, list]]] = {}
    for r in parts.groupBy("width", "i", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        out.setdefault(r.width, (r.n, {}))[1].setdefault(r.i, {})[r.j] = r.v
    return {d: (n, {i: [line[j] for j in range(len(line))] for i, line in lines.items()}) for d, (n, lines) in out.items()}


def fitted(rows: DataFrame, most: int = MOST) -> dict[int, Fit]:
    """The components of every length: two passes for sums and products, one to measure the whitened covariance."""
    fits = {d: Fit(n, [int(v) for v in lines[0]], np.zeros(0), np.zeros((d, 0)), np.zeros(0))
            for d, (n, lines) in _summed(rows, lambda d, x: _sum(x)[None, :]).items()}
    centers = {d: f.center for d, f in fits.items()}
    for d, (n, lines) in _summed(rows, lambda d, x: _products(x - centers[d])).items():
        rest = [int(r) for r in fits[d].rest]
        v = np.array([[(int(lines[i][j]) * n - rest[i] * rest[j]) / n**2 for j in range(d)] for i in range(d)])
        values, vectors = components(v)
        # What rounding leaves of a zero eigenvalue is no variance.
        values = np.where(values > 4 * d * EPS * max(values[0], 0), values, 0.0)
        trace = float(np.trace(v))
        fits[d] = fits[d]._replace(values=values[:most], vectors=vectors[:, :most], explained=values[:most] / trace if trace > 0 else values[:most] * 0)
    scales = {d: (f.center, f.rest / f.n, f.whitener) for d, f in fits.items() if (f.values > 0).any()}

    def square(d: int, x: np.ndarray) -> np.ndarray:
        if d not in scales:
            return np.zeros((0, 0))
        center, rest, whitener = scales[d]
        w = ((x - center) - rest) @ whitener  # its mean is that of x - S/n, 0
        return w.T @ w

    for d, (n, lines) in _summed(rows, square, "width int, i int, v array<double>, n long").items() if scales else ():
        cov = np.array([lines[i] for i in range(len(lines))]) / n
        fits[d] = fits[d]._replace(error=float(np.abs(cov - np.eye(len(cov))).max()))
    return fits


def deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """Of every vector: the sum over entries of (n x - S) squared, exact, as a decimal of 38 digits."""
    y = x - fit.center
    if (float(np.abs(y).max(initial=0)) * fit.n + fit.n) ** 2 * x.shape[1] < 2.0**62:
        return pa.array(((fit.n * y - fit.rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((fit.n * y.astype(object) - fit.rest.astype(object)) ** 2).sum(axis=1)
    return pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every vector and its first `most` components."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(complete(F.col("vector")))
    fits = fitted(rows.select("vector"), most)
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, part in by_length(batches):
            fit = fits[d]
            k, good = len(fit.values), fit.values > 0
            values = np.full((len(x), k), np.nan)
            values[:, good] = ((x - fit.center) - fit.rest / fit.n) @ fit.whitener
            each = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch([
                part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(each), fit.n)), deviations(x, fit).take(pa.array(each)),
                pa.array(values.ravel(), mask=np.tile(~good, len(x))), pa.array(np.tile(fit.explained, len(x))),
                pa.array([fit.error] * len(each), pa.float64())],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id)
