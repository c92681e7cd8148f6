"""Estimators without a matrix of all unknowns: every step is one pass over stored blocks of the points.

The driver holds vectors of the unknowns only, for some epochs at a time, and the matrices of single orders, by which the
unknowns hang together most: those are what the iterations are preconditioned with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.geo import FOUR_PI
from orbweave.functions.kernels import columns, waves
from orbweave.operators import analysis
from orbweave.operators.blocks import Block, blocks_in
from orbweave.operators.synthesis import SENT


def order_slices(nmax: int) -> list[tuple[int, int, slice]]:
    """(part, order, places in a flat solution) of each order's cosines and sines."""
    out, at = [], 0
    for part in (0, 1):
        for m in range(part, nmax + 1):
            out.append((part, m, slice(at, at + nmax - m + 1)))
            at += nmax - m + 1
    return out


def order_matrices(points: DataFrame, nmax: int) -> list[np.ndarray]:
    """For each of ``order_slices`` the sums of w times basis times basis over the places of all epochs, by the number of
    epochs: about a third of nmax cubed numbers twice, which tasks add up and Spark sums."""
    slices = order_slices(nmax)

    def of(block: Block) -> np.ndarray:
        w = block.w * (~np.isnan(block.vals)).sum(1)
        lats, i = np.unique(block.lat, return_inverse=True)
        cos, sin = waves(block.lon, nmax)
        flat = {}
        for m, p in columns(lats, nmax):
            for part, wave in ((0, cos), (1, sin)):
                if m >= part:
                    flat[part, m] = ((p * np.bincount(i, weights=w * wave[m] ** 2, minlength=len(lats))) @ p.T).ravel()
        return np.concatenate([flat[part, m] for part, m, _ in slices])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks_in(batches):
            for k in range(0, len(block.lat), 20_000):
                part = slice(k, k + 20_000)
                mine = of(Block(block.lat[part], block.lon[part], block.w[part], block.epochs, block.vals[part]))
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "v"])

    rows = points.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    epochs = points.select(F.explode("epochs").alias("e")).distinct().count()
    sizes = [s.stop - s.start for _, _, s in slices]
    flat = np.zeros(sum(n * n for n in sizes))
    flat[rows.column("k").to_numpy()] = rows.column("v").to_numpy() / max(1, epochs)
    cuts = np.cumsum([n * n for n in sizes])[:-1]
    return [v.reshape(n, n) for v, n in zip(np.split(flat, cuts), sizes)]


@dataclass
class Done:
    """What iterations came to: solutions by epoch, steps, and the spread of the preconditioned system's eigenvalues."""

    x: dict[int, np.ndarray] = field(default_factory=dict)
    steps: int = 0
    condition: float = 1.0


def solve(points: DataFrame, nmax: int, ridge: np.ndarray | None = None, rtol: float = 1e-10, most: int = 500) -> Done:
    """(A'WA + diag(ridge**2)) x = A'Wf of all epochs of stored blocks, by preconditioned conjugate gradients, as many epochs
    side by side as may be sent to tasks. Each epoch's own points count."""
    size, slices = (nmax + 1) ** 2, order_slices(nmax)
    lift = np.zeros(size) if ridge is None else ridge**2
    inverses = []
    for (_, _, at), g in zip(slices, order_matrices(points, nmax)):
        g = g + np.diag(lift[at])
        floor = max(float(np.trace(g)) / len(g), 1e-300) * 1e-13
        inverses.append(np.linalg.inv(g + floor * np.eye(len(g))))

    def eased(r: np.ndarray) -> np.ndarray:
        return np.concatenate([m @ r[at] for (_, _, at), m in zip(slices, inverses)])

    def applied(p: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        got = analysis._passed(points, nmax, p, lambda block, v: np.where(np.isnan(block.vals), 0.0, v) * block.w[:, None])
        return {e: FOUR_PI * got[e] + lift * v for e, v in p.items()}

    out = Done()
    epochs = sorted(r[0] for r in points.select(F.explode("epochs")).distinct().collect())  # one number an epoch
    for k in range(0, len(epochs), max(1, SENT // (4 * size))):
        some = epochs[k : k + max(1, SENT // (4 * size))]
        rhs = {e: FOUR_PI * b for e, b in analysis.flat(analysis.quadrature(points, nmax).where(F.col("epoch_id").isin(some)), nmax).items()}
        x, r = {e: np.zeros(size) for e in rhs}, dict(rhs)
        z = {e: eased(v) for e, v in r.items()}
        p, rz = dict(z), {e: float(r[e] @ z[e]) for e in r}
        first, steps = dict(rz), {e: [] for e in r}
        n = 0
        while n < most and (open_ := [e for e in r if rz[e] > rtol**2 * first[e]]):
            ap = applied({e: p[e] for e in open_})
            n += 1
            for e in open_:
                step = rz[e] / float(p[e] @ ap[e])
                x[e], r[e] = x[e] + step * p[e], r[e] - step * ap[e]
                z[e] = eased(r[e])
                new = float(r[e] @ z[e])
                steps[e].append((step, new / rz[e]))
                p[e], rz[e] = z[e] + new / rz[e] * p[e], new
        out.x |= x
        out.steps = max(out.steps, n)
        out.condition = max([out.condition, *(_spread(s) for s in steps.values() if s)])
    return out


def _spread(steps: list[tuple[float, float]]) -> float:
    """Root of the ratio of the extreme Ritz values of conjugate gradients with these steps and improvements."""
    a, b = np.array(steps).T
    diagonal = 1 / a + np.append(0.0, b[:-1] / a[:-1])
    beside = np.sqrt(b[:-1]) / a[:-1]
    lam = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    return float(np.sqrt(lam[-1] / lam[0])) if lam[0] > 0 else float("inf")


def concentrated(points: DataFrame, nmax: int, wanted: int, shannon: float, tolerance: float = 1e-10, cycles: int = 30, depth: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of A'WA / 4 pi of one set of points, falling, and their functions: block Lanczos
    with full orthogonalisation, restarted with the best functions so far until these are exact to ``tolerance``. A step
    is one pass for a whole block of functions. About as many eigenvalues as the Shannon number are nearly equal, so the
    block reaches past them, to where eigenvalues have fallen."""
    size = (nmax + 1) ** 2
    width = min(size, max(wanted, int(shannon + 4 * np.sqrt(max(shannon, 0.0)))) + 10)
    if size * width > SENT:
        raise ValueError(f"{width} functions of {size} unknowns are more than {SENT} numbers; ask for fewer")

    def applied(v: np.ndarray) -> np.ndarray:
        return _to_all(points, nmax, v)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(cycles):
        basis, images, fresh = q, np.zeros((size, 0)), q
        for k in range(depth):
            image = applied(fresh)
            images = np.concatenate([images, image], 1)
            if k + 1 == depth or basis.shape[1] >= size:
                break
            for _twice in range(2):
                image = image - basis @ (basis.T @ image)
            u, s, _ = np.linalg.svd(image, full_matrices=False)
            fresh = u[:, s > 1e-13 * max(1.0, s[0])][:, : size - basis.shape[1]]
            if not fresh.shape[1]:
                break
            basis = np.concatenate([basis, fresh], 1)
        inner = basis[:, : images.shape[1]].T @ images
        lam, v = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-lam)[:width]
        lam, v = lam[order], v[:, order]
        q = basis[:, : images.shape[1]] @ v
        off = np.linalg.norm(images @ v - q * lam, axis=0)[:wanted]
        if (off <= tolerance).all():
            break
        q = np.linalg.qr(q)[0]
    return lam[:wanted], q[:, :wanted]


def _to_all(points: DataFrame, nmax: int, v: np.ndarray) -> np.ndarray:
    """A'WA / 4 pi times each column, over the places that the first epoch has values for."""
    part, n, m = analysis.spots(nmax)
    sets = np.zeros((2, nmax + 1, nmax + 1, v.shape[1]))
    sets[part, n, m] = v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks_in(batches):
            here = ~np.isnan(block.vals[:, 0])
            block = Block(block.lat[here], block.lon[here], block.w[here], np.arange(v.shape[1]), np.zeros((int(here.sum()), 0)))
            if len(block.lat):
                mine = analysis.analysed(block, nmax, analysis.synthesised(block, sets) * block.w[:, None])
                total = mine if total is None else total + mine
        if total is not None:
            sums = analysis._Sums(nmax)
            sums.add(np.arange(v.shape[1]), total)
            yield from sums.drain()

    out = np.zeros_like(v)
    for k, x in analysis.flat(analysis._total(points.mapInArrow(run, analysis.COEFFS)), nmax).items():
        out[:, k] = x
    return out
