"""Fully normalised (4 pi) associated Legendre functions without Condon-Shortley phase, for whole batches of latitudes.

``columns`` runs along the degree for one order at a time, so only one order's values are alive.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np


def _step(n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the recurrence in n for order m."""
    a = np.sqrt((2 * n - 1) * (2 * n + 1) / ((n - m) * (n + m)))
    b = np.sqrt(np.maximum(0.0, (2 * n + 1) * (n + m - 1) * (n - m - 1) / np.maximum(1.0, (2 * n - 3) * (n + m) * (n - m))))
    return a, b


def _column(seed: np.ndarray, t: np.ndarray, m: int, nmax: int) -> np.ndarray:
    out = np.zeros((nmax - m + 1, len(t)))
    out[0] = seed
    if nmax > m:
        a, b = _step(np.arange(m + 1.0, nmax + 1.0), m)
        out[1] = a[0] * t * out[0]
        for k in range(2, nmax - m + 1):
            out[k] = a[k - 1] * t * out[k - 1] - b[k - 1] * out[k - 2]
    return out


def columns(lat: np.ndarray, nmax: int, orders: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(m, values of degrees m..nmax by point) for m = 0, 1, ...; lat in degrees."""
    phi = np.radians(np.asarray(lat, float))
    t, u = np.sin(phi), np.cos(phi)
    seed = np.ones(len(t))
    for m in range((nmax if orders is None else min(nmax, orders)) + 1):
        if m:
            seed = seed * u * (np.sqrt(3.0) if m == 1 else np.sqrt((2 * m + 1) / (2 * m)))
        yield m, _column(seed, t, m, nmax)


def over_sine(lat: np.ndarray, nmax: int) -> Iterator[tuple[int, np.ndarray]]:
    """(m, P / sin(colatitude)) for m = 1, 2, ..., by the same recurrence from a seed with one factor less, hence exact
    at the poles, where only m = 1 is left."""
    phi = np.radians(np.asarray(lat, float))
    t, u = np.sin(phi), np.where(np.abs(np.cos(phi)) < 1e-12, 0.0, np.cos(phi))
    seed = np.full(len(t), np.sqrt(3.0))
    for m in range(1, nmax + 1):
        if m > 1:
            seed = seed * u * np.sqrt((2 * m + 1) / (2 * m))
        yield m, _column(seed, t, m, nmax)


def triangle(lat: np.ndarray, nmax: int) -> np.ndarray:
    """P as points x (nmax+1) x (nmax+1), zero where m > n."""
    out = np.zeros((len(np.atleast_1d(lat)), nmax + 1, nmax + 1))
    for m, p in columns(np.atleast_1d(lat), nmax):
        out[:, m:, m] = p.T
    return out


def slopes(lat: np.ndarray, nmax: int) -> Iterator[tuple[int, np.ndarray]]:
    """(m, dP / d(colatitude) of degrees m..nmax by point) for m = 0, 1, ..., from the neighbouring orders; three orders are
    alive at a time."""
    lat = np.atleast_1d(lat)
    before, here = None, None
    for m, p in chain(columns(lat, nmax), [(nmax + 1, np.zeros((0, len(lat))))]):
        if here is not None:
            yield m - 1, _slope(m - 1, nmax, before, p)
        before, here = here, p


def _slope(m: int, nmax: int, before: np.ndarray | None, after: np.ndarray) -> np.ndarray:
    """From the orders m - 1 and m + 1."""
    n = np.arange(m, nmax + 1.0)[:, None]
    if m == 0:
        out = np.zeros((nmax + 1, after.shape[1]))
        out[1:] = -np.sqrt(n[1:] * (n[1:] + 1) / 2) * after
        return out
    out = 0.5 * np.sqrt((n + m) * (n - m + 1) * (2.0 if m == 1 else 1.0)) * before[1:]
    out[1:] -= 0.5 * np.sqrt((n[1:] - m) * (n[1:] + m + 1)) * after
    return out


def waves(lon: np.ndarray, nmax: int) -> tuple[np.ndarray, np.ndarray]:
    """cos(m lon) and sin(m lon), m by point; lon in degrees."""
    x = np.radians(np.asarray(lon, float))[None, :] * np.arange(nmax + 1)[:, None]
    return np.cos(x), np.sin(x)


def ordinals(nmax: int) -> list[tuple[str, int, int]]:
    """The (part, n, m) of a flat solution: all cosines by order and degree, then the sines of m > 0."""
    nm = [(n, m) for m in range(nmax + 1) for n in range(m, nmax + 1)]
    return [("c", n, m) for n, m in nm] + [("s", n, m) for n, m in nm if m]


def design(lat: np.ndarray, lon: np.ndarray, nmax: int) -> np.ndarray:
    """The basis at each point in the order of ``ordinals``: points x (nmax+1)**2."""
    cos, sin = waves(lon, nmax)
    both = [(p * cos[m], p * sin[m]) for m, p in columns(lat, nmax)]
    return np.concatenate([c for c, _ in both] + [s for _, s in both[1:]]).T
