"""Epochs side by side: blocks of places with a vector of epochs each.

A block has the places of some rows (lat, lon, weight) and, for all of its epochs, their values, NaN where a place has none.
A basis is then evaluated once for the places of a block and serves all epochs as one product of matrices. Where the
places of a block lie on a lattice, whatever its steps, the product parts in two: waves along each latitude, then
Legendre functions along the latitudes.

Tasks form blocks from the rows that they have, so nothing is shuffled. ``blocked`` keeps them as a table for what passes over
the points several times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.functions.kernels import columns, waves

#: Rows that a task gathers into a block.
ROWS = 1 << 20
#: Places of a stored block.
PLACES = 1 << 12
#: How many empty fields a dense block may have for each filled one.
SPARE = 4
#: Fields that it may have in any case.
SLACK = 1000
BLOCK = "lat array<double>, lon array<double>, w array<double>, epochs array<int>, vals array<double>"
_NAMES = [c.split(" ")[0] for c in BLOCK.split(", ")]


@dataclass
class Block:
    lat: np.ndarray
    lon: np.ndarray
    w: np.ndarray
    epochs: np.ndarray
    vals: np.ndarray  # places x epochs

    @cached_property
    def lattice(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Latitudes, longitudes, and each place's row and column, if these are few next to the places."""
        lats, i = np.unique(self.lat, return_inverse=True)
        lons, j = np.unique(self.lon, return_inverse=True)
        return (lats, lons, i, j) if len(lats) * len(lons) <= SPARE * len(self.lat) and len(lats) > 1 else None

    def weighted(self) -> np.ndarray:
        """Weight times value, 0 where there is none."""
        return np.where(np.isnan(self.vals), 0.0, self.vals) * self.w[:, None]


def _factors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and which of them each is."""
    known = np.unique(x[: 1 << 16])
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    if (known[at] == x).all():
        return known, at
    return np.unique(x, return_inverse=True)


def block_of(lat: np.ndarray, lon: np.ndarray, w: np.ndarray, value: np.ndarray, epoch: np.ndarray) -> Iterator[Block]:
    """Rows as a block; as one block an epoch where the epochs have hardly a place in common. A place that an epoch has
    twice, or with another weight, is another place."""
    epochs, e = _factors(epoch)
    if len(epochs) == 1:
        yield Block(lat, lon, w, epochs, value[:, None])
        return
    lats, i = _factors(lat)
    lons, j = _factors(lon)
    key, cells = i * len(lons) + j, len(lats) * len(lons)
    if cells <= SPARE * len(lat):
        there = np.bincount(key, minlength=cells) > 0
        place, n = (np.cumsum(there) - 1)[key], int(there.sum())
    else:
        names, place = np.unique(key, return_inverse=True)
        n = len(names)
    if n * len(epochs) <= SPARE * len(lat) + SLACK:
        own = np.zeros(n)
        own[place] = w
        if (own[place] != w).any() or np.bincount(place * len(epochs) + e, minlength=n * len(epochs)).max() > 1:
            place, n = _told_apart(place, w, e)
    if n * len(epochs) > SPARE * len(lat) + SLACK:
        order = np.argsort(e, kind="stable")
        cuts = np.searchsorted(e[order], np.arange(len(epochs) + 1))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            mine = order[a:b]
            yield Block(lat[mine], lon[mine], w[mine], epochs[k : k + 1], value[mine][:, None])
        return
    out = Block(np.empty(n), np.empty(n), np.empty(n), epochs, np.full((n, len(epochs)), np.nan))
    out.lat[place], out.lon[place], out.w[place], out.vals[place, e] = lat, lon, w, value
    yield out


def _told_apart(place: np.ndarray, w: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, int]:
    def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        return order, new

    order, new = runs(place, w, e)
    heads = np.flatnonzero(new)
    again = np.empty(len(order), np.int64)
    again[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    order, new = runs(place, w, again)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of rows (lat, lon, w, value, epoch_id), or of stored blocks."""
    held, n = [], 0
    for b in batches:
        if "vals" in b.schema.names:
            for k in range(b.num_rows):
                lat, lon, w, epochs, vals = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in _NAMES)
                yield Block(lat, lon, w, epochs, vals.reshape(len(lat), len(epochs)))
            continue
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "w", "value", "epoch_id")])
        n += b.num_rows
        if n >= ROWS:
            yield from block_of(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        yield from block_of(*(np.concatenate(x) for x in zip(*held)))


def blocked(rows: DataFrame) -> DataFrame:
    """BLOCK: rows (lat, lon, w, value, epoch_id, none of them null) as blocks of PLACES places at most, and of no more
    numbers than that of rows in ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            order = np.lexsort((block.lon, block.lat))  # a stored block is a stretch of latitudes, a lattice if all are
            for k in range(0, len(order), PLACES):
                at = order[k : k + PLACES]
                cols = [[block.lat[at]], [block.lon[at]], [block.w[at]], [block.epochs.astype(np.int32)], [block.vals[at].ravel()]]
                kinds = [pa.list_(pa.float64())] * 3 + [pa.list_(pa.int32()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=_NAMES)

    return rows.select("lat", "lon", "w", "value", "epoch_id").mapInArrow(run, BLOCK)


def _parts(n: int, nmax: int) -> Iterator[slice]:
    step = max(64, min(20_000, 1_000_000 // (nmax + 1)))
    return (slice(k, k + step) for k in range(0, n, step))


def _even(block: Block, circle: tuple[float, int] | None) -> np.ndarray | None:
    """Each place's column on a circle of nlon longitudes from the first one on, if a fair part of these are there."""
    if circle is None or block.lattice is None or SPARE * len(block.lattice[1]) < circle[1]:
        return None
    return np.rint((block.lon - circle[0]) / (360.0 / circle[1])).astype(np.int64) % circle[1]


def analysed(block: Block, nmax: int, vals: np.ndarray | None = None, circle: tuple[float, int] | None = None) -> np.ndarray:
    """Sums of vals (by default weight times value) times the basis over the places: 2 (cos, sin) x degrees x orders x
    epochs. circle: all longitudes are a first one plus whole steps of a part of the circle; then waves along a latitude are
    an FFT, where a block has enough of them."""
    f = block.weighted() if vals is None else vals
    out = np.zeros((2, nmax + 1, nmax + 1, f.shape[1]))
    if block.lattice is not None:
        lats, lons, i, j = block.lattice
        col = _even(block, circle)
        wide, cell = (len(lons), i * len(lons) + j) if col is None else (circle[1], i * circle[1] + col)
        cube = np.zeros((len(lats) * wide, f.shape[1]))
        if len(np.unique(cell)) == len(cell):
            cube[cell] = f
        else:
            np.add.at(cube, cell, f)
        cube = cube.reshape(len(lats), wide, -1)
        if col is None:
            rows = np.concatenate(waves(lons, nmax)) @ cube  # all cosines, then all sines
        else:
            z = np.fft.rfft(cube, axis=1)[:, : nmax + 1] * np.exp(-1j * np.radians(circle[0]) * np.arange(nmax + 1))[:, None]
            rows = np.concatenate([z.real, -z.imag], axis=1)
        for m, p in columns(lats, nmax):
            out[0, m:, m], out[1, m:, m] = p @ rows[:, m], p @ rows[:, nmax + 1 + m]
        return out
    for part in _parts(len(block.lat), nmax):
        cos, sin = waves(block.lon[part], nmax)
        for m, p in columns(block.lat[part], nmax):
            out[0, m:, m] += (p * cos[m]) @ f[part]
            out[1, m:, m] += (p * sin[m]) @ f[part]
    return out


def synthesised(block: Block, coeffs: np.ndarray) -> np.ndarray:
    """The field of coeffs (2 x degrees x orders x epochs) at the places: places x epochs."""
    nmax, n = coeffs.shape[1] - 1, coeffs.shape[3]
    if block.lattice is not None:
        lats, lons, i, j = block.lattice
        rows = np.empty((len(lats), 2 * nmax + 2, n))
        for m, p in columns(lats, nmax):
            rows[:, m], rows[:, nmax + 1 + m] = p.T @ coeffs[0, m:, m], p.T @ coeffs[1, m:, m]
        field = np.concatenate(waves(lons, nmax)).T @ rows
        return field.reshape(-1, n)[i * len(lons) + j]
    out = np.zeros((len(block.lat), n))
    for part in _parts(len(block.lat), nmax):
        cos, sin = waves(block.lon[part], nmax)
        for m, p in columns(block.lat[part], nmax):
            out[part] += (p * cos[m]).T @ coeffs[0, m:, m] + (p * sin[m]).T @ coeffs[1, m:, m]
    return out
