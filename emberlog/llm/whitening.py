"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed: its product with a few vectors is one pass over the rows, C'(C B) with C the centred rows,
summed over tasks. All components that are still open share each pass. A round takes Ritz pairs from the search space,
locks those whose residual is at rounding level, and solves the correction equations of the others by inner MINRES,
projected against what is locked and the Ritz vectors themselves; the corrections widen the search space. A last
Rayleigh-Ritz step over what is locked orders the components.

Entries are used as integers, floor(64 * c) + 1000000, so sums and centring are exact: n * x - S is a whole number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, summed

_EPS = float(np.finfo(np.float64).eps)
_ROWS = 2048  # rows that are multiplied together

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to ``bases``, whose columns are orthonormal."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        for b in bases:
            new = new - b @ (b.T @ new)
    if not new.shape[1]:
        return new
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-10]
    for b in bases:
        u = u - b @ (b.T @ u)
    return np.linalg.qr(u)[0]


def minres(product: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of ``product(x) = b``, column by column but in lockstep, by at most ``steps`` steps of the
    minimal-residual method for symmetric operators; a column stops once its residual falls by ``tolerance``."""
    beta = np.linalg.norm(b, axis=0)
    first, eta = beta.copy(), beta.copy()
    x, w, w_before, v_before = (np.zeros_like(b) for _ in range(4))
    hat = b.copy()
    cos = cos_before = np.ones(b.shape[1])
    sin = sin_before = np.zeros(b.shape[1])
    for _ in range(steps):
        go = (np.abs(eta) > tolerance * first) & (beta > _EPS * first)
        if not go.any():
            break
        v = np.where(go, hat / np.where(beta > 0, beta, 1), 0)
        av = product(v)
        alpha = (v * av).sum(axis=0)
        hat = av - alpha * v - beta * v_before
        beta_next = np.linalg.norm(hat, axis=0)
        delta = cos * alpha - cos_before * sin * beta
        r1 = np.hypot(delta, beta_next)
        r2 = sin * alpha + cos_before * cos * beta
        r3 = sin_before * beta
        safe = np.where(r1 > 0, r1, 1)
        go &= r1 > 0
        w_next = np.where(go, (v - r3 * w_before - r2 * w) / safe, 0)
        cos_before, sin_before = cos, sin
        cos, sin = delta / safe, beta_next / safe
        x = x + np.where(go, cos * eta, 0) * w_next
        eta = np.where(go, -sin * eta, 0)
        w_before, w, v_before, beta = w, w_next, v, beta_next
    return x


def jacobi_davidson(product: Product, size: int, wanted: int, scale: float, inner: int = 6, most_rounds: int = 100, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their orthonormal eigenvectors (columns) of a symmetric operator
    on vectors of ``size`` that is positive semidefinite, and of which only products are known. ``scale`` is a bound of
    the greatest eigenvalue, such as the trace; residuals are brought to 8 units of rounding of it."""
    wanted = min(wanted, size)
    goal = 8 * _EPS * scale
    spare = min(size, wanted + 4)
    most = min(size, 3 * wanted + 16)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((size, spare)))
    image = product(space)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    worst = np.inf
    for _ in range(most_rounds):
        theta, y = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        open_ = min(wanted - locked.shape[1], len(theta))
        ritz = space @ y[:, :open_]
        residual = image @ y[:, :open_] - ritz * theta[:open_]
        residual -= locked @ (locked.T @ residual)
        size_of = np.linalg.norm(residual, axis=0)
        # in order: a later pair may still be overtaken while an earlier one isn't settled
        settled = int(np.argmax(np.append(size_of > goal, True)))
        worst = float(size_of[settled:].max(initial=0.0))
        if settled:
            locked, values = np.hstack([locked, ritz[:, :settled]]), np.append(values, theta[:settled])
            space, image = space @ y[:, settled:], image @ y[:, settled:]
            y, ritz, residual, theta = np.eye(space.shape[1]), ritz[:, settled:], residual[:, settled:], theta[settled:]
            open_ -= settled
        if locked.shape[1] >= wanted:
            break
        if space.shape[1] + locked.shape[1] + open_ > most and space.shape[1] > open_ + 4:
            keep = min(open_ + 4, space.shape[1])
            space, image = space @ y[:, :keep], image @ y[:, :keep]
        fixed = np.hstack([locked, ritz])

        def projected(x: np.ndarray, fixed: np.ndarray = fixed, shift: np.ndarray = theta[:open_]) -> np.ndarray:
            x = x - fixed @ (fixed.T @ x)
            out = product(x) - x * shift
            return out - fixed @ (fixed.T @ out)

        inside = size > fixed.shape[1]
        step = minres(projected, -residual, min(inner, size - fixed.shape[1]), 1e-3) if inside else residual
        more = _orthonormal(step, locked, space)
        if not more.shape[1]:
            # the space is whole, or rounding hides what could widen it: products anew, and a goal that allows for more rounding
            space = _orthonormal(space, locked)
            image = product(space)
            goal *= 2
            continue
        space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    if locked.shape[1] < wanted:
        raise RuntimeError(f"{wanted - locked.shape[1]} of {wanted} components did not settle; the greatest residual is {worst:.3g}")
    locked = np.linalg.qr(locked)[0]
    image = product(locked)
    theta, y = np.linalg.eigh((locked.T @ image + image.T @ locked) / 2)
    worst = float(np.linalg.norm(image @ y - (locked @ y) * theta, axis=0).max(initial=0.0))
    if worst > 512 * _EPS * scale:
        raise RuntimeError(f"the greatest residual is {worst:.3g} after the last step, of {scale:.3g}")
    return theta[::-1], locked @ y[:, ::-1]


@dataclass
class Fit:
    """What is known of the fit list: its rows, per-dimension sums, trace, components (columns) and eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, x array<long>) of the vectors that take part: not null, without null or non-finite entries or such that
    64 times them a long can't hold, of the commonest length (ties: the least)."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**56)
    rows = vectors.select(F.col(id_col).alias(id_col), v.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", bad) & (F.size("x") > 0))
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (common[0]["n"] if common else 0)).withColumn("x", F.transform("x", lambda c: F.floor(c * 64).cast("long") + 1_000_000))


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            yield part, part.column(at).flatten().to_numpy().reshape(part.num_rows, -1)


def _whole(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in Python's integers where 64 bits don't hold it."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return n * x - sums if 2 * n * most < 1 << 62 else n * x.astype(object) - sums.astype(object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Sums of squares by row; null where a long can't hold it."""
    most = float(np.abs(y).max()) if y.size else 0.0
    if y.dtype != object and most * most * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    total = [sum(int(c) * int(c) for c in row) for row in y.tolist()]
    return [t if t < 1 << 63 else None for t in total]


def _over_rows(rows: DataFrame, tasks: int, n: int, sums: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``work`` of the centred rows, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0):
            part = work(_whole(x, n, sums).astype(np.float64) / n)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()])], ["v"])

    return summed(rows.select("x").mapInArrow(run, "v binary"), tasks)


def fit(rows: DataFrame, components: int = 32) -> Fit:
    """Fit to ``prepared`` rows, which should be a written table: every product reads them. Components beyond the numerical
    rank are left out; without rows, or if all rows are the same, there are none."""
    tasks = rows.rdd.getNumPartitions()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for _, x in _blocks(batches, 0):
            n += len(x)
            small = np.abs(x).max() < 1 << 50
            part = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
            held = part if held is None else held + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(held)), pa.int32()), pa.array([str(n), *map(str, held)])], ["dim", "s"])

    found = rows.select("x").mapInArrow(totals, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    if not found:
        return Fit(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n, exact = int(found[0]["s"]), [int(r["s"]) for r in found[1:]]
    sums = np.array(exact, np.int64 if max(map(abs, exact)) < 1 << 62 else object)
    trace = float(_over_rows(rows, tasks, n, sums, lambda c: np.array([(c * c).sum()]))[0] / n)
    size = len(sums)
    if trace <= 0:
        return Fit(n, exact, 0.0, np.zeros(0), np.zeros((size, 0)))
    product = lambda b: _over_rows(rows, tasks, n, sums, lambda c: c.T @ (c @ b)).reshape(size, -1) / n
    values, vectors = jacobi_davidson(product, size, components, trace)
    rank = values > 16 * size * _EPS * trace
    return Fit(n, exact, trace, values[rank], vectors[:, rank])


def whiten(rows: DataFrame, found: Fit, id_col: str = "vec_id") -> DataFrame:
    """(``id_col``, component, n, deviation, whitened, explained, identity_error): a row for each of ``prepared`` rows and
    component; ``deviation`` is the exact sum of (n * x - S) ** 2, null where a long can't hold it."""
    k = len(found.values)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    n, tasks = found.n, rows.rdd.getNumPartitions()
    sums = np.array(found.sums, np.int64 if max(map(abs, found.sums)) < 1 << 62 else object)
    turn = found.vectors / np.sqrt(found.values)
    mean = _over_rows(rows, tasks, n, sums, lambda c: (c @ turn).sum(axis=0)) / n

    def covariance(c: np.ndarray) -> np.ndarray:
        w = c @ turn - mean
        return w.T @ w

    error = float(np.abs(_over_rows(rows, tasks, n, sums, covariance).reshape(k, k) / n - np.eye(k)).max())
    share = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            y = _whole(x, n, sums)
            of = pa.array(np.repeat(np.arange(len(x)), k))
            white = (y.astype(np.float64) / n) @ turn
            m = len(x) * k
            columns = [part.column(0).take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), pa.array(_squares(y), pa.int64()).take(of), pa.array(white.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(id_col, "x").mapInArrow(run, schema)


def whitened(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``whiten`` by a fit to all rows of ``vectors`` that take part. Repeated ids and null ids are rows like others."""
    rows = materialize(prepared(vectors, id_col, vector_col), "vectors")
    return whiten(rows, fit(rows, components), id_col)
